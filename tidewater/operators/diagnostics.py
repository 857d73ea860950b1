"""What a cleaning run converted, and samples of what it couldn't."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import is_blank, type_rules
from .infer import _c


@dataclass
class ColumnDiagnostics:
    column_name: str
    original_type: str
    converted_type: str
    total_count: int
    null_count: int
    converted_count: int
    failed_count: int
    success_rate: float
    failed_samples: list[str] = field(default_factory=list)


def conversion_diagnostics(original: DataFrame, cleaned: DataFrame, sample_failed_values: int = 5) -> dict[str, ColumnDiagnostics]:
    """Counts for each column that both tables have: one job a table, and one per column with failures for samples.

    Blank text counts as null, not as failed. The rate is 100 where nothing was to convert.
    """
    shared = [c for c in original.columns if c in cleaned.columns]
    if not shared:
        return {}
    before = original.agg(F.count(F.lit(1)).alias("t"), *[F.count_if(~is_blank(_c(c))).alias(f"v{i}") for i, c in enumerate(shared)], *[F.count(_c(c)).alias(f"n{i}") for i, c in enumerate(shared)]).first()
    after = cleaned.agg(*[F.count(_c(c)).alias(f"n{i}") for i, c in enumerate(shared)]).first()
    old, new, out = dict(original.dtypes), dict(cleaned.dtypes), {}
    for i, c in enumerate(shared):
        valid = before[f"v{i}"] if new[c] != "string" else before[f"n{i}"]
        failed = max(0, valid - after[f"n{i}"])
        rate = round(100 * (valid - failed) / valid, 2) if valid else 100.0
        samples = failed_values(original, c, new[c], sample_failed_values) if failed and sample_failed_values else []
        out[c] = ColumnDiagnostics(c, old[c], new[c], before["t"], before["t"] - before[f"n{i}"], valid - failed, failed, rate, samples)
    return out


def failed_frame(original: DataFrame, column: str, spark_type: str) -> DataFrame:
    """Distinct values of a column that don't convert to a type; read off the original, no join of row numbers."""
    rule = next((r for r in type_rules() if r.spark_type == spark_type), None)
    if rule is None:
        return original.select(_c(column).cast("string").alias("value")).limit(0)
    return original.where(~is_blank(_c(column)) & rule.parse(_c(column)).isNull()).select(_c(column).cast("string").alias("value")).distinct()


def failed_values(original: DataFrame, column: str, spark_type: str, limit: int = 3) -> list[str]:
    return [r["value"] for r in failed_frame(original, column, spark_type).limit(limit).collect()]
