"""Type inference in one or two aggregations, whatever the number of columns.

Columns are turned into rows of (column number, text): text is trimmed and stripped once,
each check is compiled once for all columns, and one aggregation counts them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import TypeRule, strip_numeric, trimmed, type_rules
from ..log import get_logger

#: What a type broadens to where values don't fit, in order; fixed values.
BROADER = {"boolean": ("integer", "float"), "integer": ("float",), "float": (), "datetime": (), "string": ()}


@dataclass(frozen=True)
class Sampling:
    """Inference on a sample; the inferred types are then checked on all rows."""

    enabled: bool = False
    fraction: float = 0.1
    min_rows: int = 1000
    max_rows: int = 100_000
    seed: int | None = None


def _c(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" or t.startswith(("varchar", "char"))]


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it lies in fewer partitions, as a table of one file does; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def match_counts(df: DataFrame, wanted: dict[str, list[TypeRule]], profile: str = "spark") -> dict[str, dict[str, int]]:
    """Per column: non_null, non_blank and the matches of each of its rules; one job."""
    if not wanted:
        return {}
    names, rules = list(wanted), {r.name: r for some in wanted.values() for r in some}
    cells = spread(df).select(F.posexplode(F.array(*[_c(c).cast("string") for c in names])).alias("i", "v")).where("v IS NOT NULL")
    cells = cells.select("i", trimmed(F.col("v"), profile).alias("t")).select("i", "t", strip_numeric(F.col("t")).alias("n"))
    blank = F.col("t") == ""
    aggs = [F.count(F.lit(1)).alias("non_null"), F.count_if(~blank).alias("non_blank")]
    for k, (name, rule) in enumerate(rules.items()):
        where = [i for i, c in enumerate(names) if any(r.name == name for r in wanted[c])]
        check = blank | rule.looks(F.col("t"), F.col("n"))
        aggs.append(F.count_if(check if len(where) == len(names) else F.when(F.col("i").isin(where), check)).alias(f"r{k}"))
    found = {r["i"]: r for r in cells.groupBy("i").agg(*aggs).collect()}
    count = lambda i, key: found[i][key] if i in found else 0  # noqa: E731 - no rows, no groups
    number = {name: k for k, name in enumerate(rules)}
    return {c: {"non_null": count(i, "non_null"), "non_blank": count(i, "non_blank")} | {r.name: count(i, f"r{number[r.name]}") for r in wanted[c]} for i, c in enumerate(names)}


def type_counts(df: DataFrame, rules: list[TypeRule] | None = None, columns: list[str] | None = None, profile: str = "spark") -> dict[str, dict[str, int]]:
    """Per column: non_null, non_blank and the matches of each rule; dates are only tried where no cheaper rule fits.

    Two jobs at most, one where the rules know no dates or no column is left for them.
    """
    rules = rules or type_rules(profile=profile)
    columns = columns if columns is not None else string_columns(df)
    cheap, dear = [r for r in rules if r.name != "datetime"], [r for r in rules if r.name == "datetime"]
    out = match_counts(df, dict.fromkeys(columns, cheap), profile)
    open_ = [c for c in columns if out[c]["non_blank"] and not any(out[c][r.name] == out[c]["non_null"] for r in cheap)] if dear else []
    later = match_counts(df, dict.fromkeys(open_, dear), profile)
    return {c: out[c] | later.get(c, {r.name: 0 for r in dear}) for c in columns}


def first_fit(counts: dict[str, int], rules: list[TypeRule]) -> str:
    """First type that every non-null value fits; "string" where none does or no value isn't blank."""
    return next((r.name for r in rules if counts["non_blank"] and counts[r.name] == counts["non_null"]), "string")


def most_matches(counts: dict[str, int], rules: list[TypeRule]) -> str:
    """The type that most values fit, the first of equals, if they all do: boolean, number, date.

    A number is an integer where all numbers are whole, else a float.
    """
    best = max((r.name for r in rules if r.name != "float"), key=lambda name: counts["float" if name == "integer" else name])
    kind = "float" if best == "integer" and counts["integer"] < counts["float"] else best
    return kind if counts["non_blank"] and counts[kind] == counts["non_null"] else "string"


def infer_types(df: DataFrame, rules: list[TypeRule] | None = None, columns: list[str] | None = None, profile: str = "spark") -> dict[str, str]:
    """Type of each text column: `first_fit`, or `most_matches` under the profile "polars"."""
    rules = rules or type_rules(profile=profile)
    pick = most_matches if profile == "polars" else first_fit
    return {c: pick(n, rules) for c, n in type_counts(df, rules, columns, profile).items()}


def conversion_failures(df: DataFrame, types: dict[str, str], rules: list[TypeRule] | None = None, profile: str = "spark") -> dict[str, int]:
    """Non-blank values of each column that don't fit its type; one job."""
    by = {r.name: r for r in rules or type_rules(profile=profile)}
    counts = match_counts(df, {c: [by[t]] for c, t in types.items() if t in by}, profile)
    return {c: counts[c]["non_null"] - counts[c][t] if c in counts else 0 for c, t in types.items()}


def broadened(df: DataFrame, types: dict[str, str], rules: list[TypeRule] | None = None, profile: str = "spark") -> dict[str, str]:
    """The types, each broadened until all rows fit it; one job for all columns and steps."""
    by = {r.name: r for r in rules or type_rules(profile=profile)}
    tries = {c: (t, *BROADER[t]) for c, t in types.items() if t != "string"}
    counts, out = match_counts(df, {c: [by[t] for t in ts] for c, ts in tries.items()}, profile), dict(types)
    for c, ts in tries.items():
        out[c] = next((t for t in ts if counts[c][t] == counts[c]["non_null"]), "string")
        if out[c] != types[c]:
            get_logger().warning("fallback: column %s from %s to %s, %d values don't fit", c, types[c], out[c], counts[c]["non_null"] - counts[c][types[c]])
    return out


def sampled(df: DataFrame, config: Sampling) -> DataFrame | None:
    """The sample to infer from, or None where sampling is off or the table small."""
    if not config.enabled:
        return None
    rows = df.count()
    if rows < config.min_rows:
        return None
    return df.sample(False, min(config.fraction, config.max_rows / rows), config.seed)
