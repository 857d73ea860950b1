"""Cleaning: every operation is one projection, fed by a constant number of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import TypeRule, parse_boolean, parse_date, parse_float, parse_integer, type_rules
from .infer import Sampling, _c, broadened, first_fit, infer_types, most_matches, sampled, spread, string_columns, type_counts

#: Typed columns that `clean_all_types` widens; all others keep their type.
WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def clean_series(df: DataFrame, column: str, fn: Callable[[Column], Column]) -> DataFrame:
    """One column through a Column function."""
    return df.withColumn(column, fn(_c(column)))


def _mapped(df: DataFrame, columns: list[str] | None, fn: Callable[[Column], Column]) -> DataFrame:
    chosen = set(string_columns(df) if columns is None else columns)
    return df.select(*[fn(_c(c)).alias(c) if c in chosen else _c(c) for c in df.columns])


def clean_numbers(df: DataFrame, columns: list[str] | None = None, errors: str = "null", whole: bool = True) -> DataFrame:
    """Numbers of text columns; those whose values are all whole become bigint if `whole` (one job)."""
    chosen = string_columns(df) if columns is None else columns
    ints: set[str] = set()
    if whole and chosen:
        row = df.agg(*[F.count_if(parse_float(_c(c)).isNotNull() & parse_integer(_c(c)).isNull()).alias(f"f{i}") for i, c in enumerate(chosen)]).first()
        ints = {c for i, c in enumerate(chosen) if row[f"f{i}"] == 0}
    return df.select(*[((parse_integer if c in ints else parse_float)(_c(c), errors=errors)).alias(c) if c in chosen else _c(c) for c in df.columns])


def clean_dates(df: DataFrame, columns: list[str] | None = None, errors: str = "null", source_timezone: str = "UTC") -> DataFrame:
    return _mapped(df, columns, lambda c: parse_date(c, source_timezone, errors=errors))


def clean_bools(df: DataFrame, columns: list[str] | None = None, errors: str = "null") -> DataFrame:
    return _mapped(df, columns, lambda c: parse_boolean(c, errors=errors))


def clean_all_types(df: DataFrame, source_timezone: str = "UTC", sampling: Sampling | None = None, profile: str = "spark", dayfirst: bool = False) -> DataFrame:
    """Text columns as the type that all their values fit; narrow numbers widened; others unchanged.

    One job, or two if dates must be tried; with sampling one more that checks all rows and
    broadens types that don't hold. Nested columns are left alone. Profiles: "spark" trims
    spaces; "pandas" trims all white space; "polars" does so too, takes the type that most
    values fit (see `most_matches`), and narrows whole numbers instead of widening them (one
    more job).
    """
    rules = type_rules(source_timezone, profile, dayfirst)
    part = sampled(df, sampling) if sampling else None
    types = infer_types(df if part is None else part, rules, string_columns(df), profile)
    if part is not None:
        types = broadened(df, types, rules, profile)
    return _typed(df, types, rules, profile)


def _typed(df: DataFrame, types: dict[str, str], rules: list[TypeRule], profile: str) -> DataFrame:
    by, out = {r.name: r for r in rules}, []
    for c, t in df.dtypes:
        if types.get(c, "string") != "string":
            out.append(by[types[c]].parse(_c(c)).alias(c))
        else:
            out.append(_c(c).cast(WIDER[t]).alias(c) if t in WIDER and profile != "polars" else _c(c))
    done = (spread(df) if types else df).select(*out) if out else df
    return optimize_dtypes(done) if profile == "polars" else done


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all") if df.columns else df


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one job."""
    if not df.columns:
        return df
    row = df.agg(*[F.count(_c(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[_c(c) for i, c in enumerate(df.columns) if row[f"n{i}"]])


def clean_df(df: DataFrame, source_timezone: str = "UTC", sampling: Sampling | None = None, profile: str = "spark") -> DataFrame:
    """Empty rows, then empty columns dropped, then `clean_all_types`; the profile "polars" keeps empty rows.

    Without sampling the counts that types are inferred from also tell which text columns are
    empty, so only other columns cost a job of their own.
    """
    rows = df if profile == "polars" else drop_empty_rows(df)
    if sampling is not None and sampling.enabled:
        return clean_all_types(drop_empty_columns(rows), source_timezone, sampling, profile)
    rules, texts = type_rules(source_timezone, profile), string_columns(rows)
    counts = type_counts(rows, rules, texts, profile)
    other = [c for c in rows.columns if c not in texts]
    full = set(drop_empty_columns(rows.select(*[_c(c) for c in other])).columns if other else []) | {c for c in texts if counts[c]["non_null"]}
    pick = most_matches if profile == "polars" else first_fit
    types = {c: pick(counts[c], rules) for c in texts if c in full}
    return _typed(rows.select(*[_c(c) for c in rows.columns if c in full]), types, rules, profile)


def hash_column(df: DataFrame, columns: list[str], target: str, sep: str = "", null_as: str | None = None) -> DataFrame:
    """SHA-1 of the columns' texts side by side; any null gives null unless `null_as` stands for it."""
    if not columns:
        raise ValueError("no columns to hash")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns to hash are missing: {missing}")
    if target in df.columns:
        raise ValueError(f"column {target} is already there")
    texts = [_c(c).cast("string") if null_as is None else F.coalesce(_c(c).cast("string"), F.lit(null_as)) for c in columns]
    parts = [x for t in texts for x in (F.lit(sep), t)][1:] if sep else texts
    return df.withColumn(target, F.sha1(F.concat(*parts).cast("binary")))


def coalesce_columns(df: DataFrame, columns: list[str], target: str, drop: bool = False) -> DataFrame:
    """First non-null of the columns, left to right; `drop` removes them, but for the target."""
    out = df.withColumn(target, F.coalesce(*[_c(c) for c in columns]))
    return out.drop(*[c for c in columns if c != target]) if drop else out


def optimize_dtypes(df: DataFrame) -> DataFrame:
    """Bigint columns in the narrowest signed type that holds them; one job."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    if not longs:
        return df
    row = df.agg(*[a for i, c in enumerate(longs) for a in (F.min(_c(c)).alias(f"l{i}"), F.max(_c(c)).alias(f"h{i}"))]).first()
    kinds = {}
    for i, c in enumerate(longs):
        lo, hi = row[f"l{i}"], row[f"h{i}"]
        if lo is not None:
            kinds[c] = next((k for k, b in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(1 << b) <= lo and hi < 1 << b), "bigint")
    return df.select(*[_c(c).cast(kinds[c]).alias(c) if c in kinds else _c(c) for c in df.columns])
