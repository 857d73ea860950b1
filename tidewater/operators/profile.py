"""Profiling: uniqueness, emptiness, categories and per-column metadata.

Distinct counts are estimated in one aggregation first; only columns or pairs that the
estimate leaves possible are counted exactly, one narrow shuffle each. An estimate rules a
unique column out only if it is more than ten standard deviations off.
"""

from __future__ import annotations

from itertools import combinations
from math import floor, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import parse_float, parse_integer
from .infer import _c, infer_types, string_columns

#: Deviation of the estimates, and the share of the needed count below which one rules a candidate out: more than ten deviations off.
DEVIATION, SLACK = 0.02, 0.75


def _exactly(df: DataFrame, key: Column) -> int:
    """Distinct values, null as one of them."""
    return df.select(key.alias("k")).groupBy("k").agg(F.lit(1).alias("one")).count()


def _unique(df: DataFrame, keys: dict, rows: int) -> list:
    if not keys or not rows:
        return list(keys)
    row = df.agg(*[F.approx_count_distinct(F.xxhash64(k), DEVIATION).alias(f"d{i}") for i, k in enumerate(keys.values())]).first()
    return [name for i, (name, k) in enumerate(keys.items()) if row[f"d{i}"] >= SLACK * rows and _exactly(df, k) == rows]


def unique_columns(df: DataFrame) -> list[str]:
    """Columns with as many distinct values (null is one) as rows; all columns of an empty table."""
    return _unique(df, {c: _c(c) for c in df.columns}, df.count())


def unique_column_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs that identify rows, of columns that don't alone. Values are compared as pairs, not joined text."""
    rows = df.count()
    alone = set(_unique(df, {c: _c(c) for c in df.columns}, rows))
    rest = [c for c in df.columns if c not in alone]
    return _unique(df, {(a, b): F.struct(_c(a), _c(b)) for a, b in combinations(rest, 2)}, rows)


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value; one job."""
    row = df.agg(*[F.count(_c(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first() if df.columns else []
    return [c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0]


def categorical_columns(df: DataFrame, unique_threshold: float = 1, approximate: bool = False) -> list[str]:
    """Columns whose share of distinct among non-null values is at most the threshold; empty columns are left out."""
    if not 0 <= unique_threshold <= 1:
        raise ValueError("unique_threshold must lie between 0 and 1")
    if not df.columns:
        return []
    row = df.agg(*[a for i, c in enumerate(df.columns) for a in (F.count(_c(c)).alias(f"n{i}"), F.approx_count_distinct(_c(c)).alias(f"d{i}"))]).first()
    out = []
    for i, c in enumerate(df.columns):
        n, d = row[f"n{i}"], row[f"d{i}"]
        if not n:
            continue
        if not approximate and unique_threshold < 1 and abs(d - unique_threshold * n) <= 0.25 * max(d, unique_threshold * n):
            d = _exactly(df.where(_c(c).isNotNull()), _c(c))
        if unique_threshold == 1 or d <= unique_threshold * n:
            out.append(c)
    return out


METADATA = "column_name string, data_type string, is_id boolean, is_unique boolean, is_empty boolean, max_str_size int, float_precision int, decimal_places int, biggest_num double, smallest_num double"


def column_metadata(df: DataFrame, primary_key: str | None = None, unique: list[str] | None = None, decimal_places: int = 2) -> list[dict]:
    """Type and size of each column, three jobs at most; [] for a table without rows.

    Typed columns have their own type, text columns the inferred one. `float_precision` is
    the digits before the point of the value largest by magnitude, plus `decimal_places` for
    floats. Numbers outside 0 and 1 that are typed stay numbers; typed 0/1 integers are boolean.
    """
    if not df.columns or df.isEmpty():
        return []
    kinds = {c: _logical(f.dataType) for c, f in zip(df.columns, df.schema, strict=True)}
    kinds |= infer_types(df, columns=string_columns(df))
    aggs = []
    for i, c in enumerate(df.columns):
        number = _numeric(_c(c), df.schema[c].dataType, kinds[c])
        aggs += [F.count(_c(c)).alias(f"n{i}"), F.min(number).alias(f"l{i}"), F.max(number).alias(f"h{i}"), F.count_if(number != F.floor(number)).alias(f"f{i}")]
        aggs.append(F.max(F.length(_c(c).cast("string"))).alias(f"s{i}") if kinds[c] == "string" and not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.lit(None).cast("int").alias(f"s{i}"))
    row, out = df.agg(*aggs).first(), []
    for i, c in enumerate(df.columns):
        kind, lo, hi, empty = kinds[c], row[f"l{i}"], row[f"h{i}"], row[f"n{i}"] == 0
        if kind == "float" and not empty and row[f"f{i}"] == 0:
            kind = "integer"
        if kind == "integer" and lo is not None and not isinstance(df.schema[c].dataType, T.StringType) and 0 <= lo and hi <= 1:
            kind = "boolean"
        number = kind in ("integer", "float") and lo is not None
        size = max(abs(lo), abs(hi)) if number else 0
        digits = (floor(log10(size)) + 1 if size >= 1 else 1) if number else None
        out.append({
            "column_name": c, "data_type": None if empty else kind, "is_id": c == primary_key, "is_unique": c in (unique or ()), "is_empty": empty,
            "max_str_size": row[f"s{i}"] if kind == "string" else None, "float_precision": digits + decimal_places * (kind == "float") if number else None, "decimal_places": decimal_places if kind == "float" else None,
            "biggest_num": float(hi) if number and kind == "integer" else None, "smallest_num": float(lo) if number and kind == "integer" else None,
        })
    return out


def metadata_frame(df: DataFrame, **options) -> DataFrame:
    """`column_metadata` as a table with one row per column."""
    return df.sparkSession.createDataFrame([tuple(m.values()) for m in column_metadata(df, **options)], METADATA)


def _logical(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    return "datetime" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def _numeric(c: Column, t: T.DataType, kind: str) -> Column:
    if kind not in ("integer", "float"):
        return F.lit(None).cast("double")
    if isinstance(t, T.StringType):
        return (parse_integer if kind == "integer" else parse_float)(c).cast("double")
    return c.cast("double")
