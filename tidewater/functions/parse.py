"""Parsers and predicates over dirty text: Column in, Column out, no Python UDFs.

Blank means null or only spaces; under the profiles "pandas" and "polars" any whitespace
counts as space. Parsers give null for blanks and for text they can't read; with ``errors="raise"``
the latter fails the query instead. Dates are dispatched by the text's mask, brought into
ISO order and cast once, so no format is tried in vain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
TRUTHY = ("y", "yes", "t", "true", "on", "1")
FALSY = ("n", "no", "f", "false", "off", "0")
NUMERIC = r"^-?[0-9]+\.?[0-9]*$"
WHOLE = r"^-?[0-9]+(\.0*)?$"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Date texts are told apart by their masks, in which digits are 9 and letters a. Fixed values.
_DAY = "9999-99-99"
_CLOCKS = ("99:99:99", "99:99:99.9", "99:99:99.99", "99:99:99.999")
_ZONES = ("a", "+99:99", "-99:99")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def trimmed(c: Column, profile: str = "spark") -> Column:
    return F.btrim(c.cast("string"), F.lit(" \t\n\x0b\f\r")) if profile in ("pandas", "polars") else F.trim(c.cast("string"))


def is_blank(c: Column, profile: str = "spark") -> Column:
    return c.isNull() | (trimmed(c, profile) == "")


def strip_numeric(c: Column) -> Column:
    """Text without ``$``, ``%`` and ``,``."""
    return F.translate(c.cast("string"), "$%,", "")


def _number(c: Column, profile: str) -> Column:
    return strip_numeric(trimmed(c, profile))


def _strict(value: Column, c: Column, kind: str, errors: str, profile: str) -> Column:
    if errors != "raise":
        return value
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), c.cast("string")))
    return F.when(is_blank(c, profile) | value.isNotNull(), value).otherwise(bad)


def parse_boolean(c: Column, errors: str = "null", profile: str = "spark") -> Column:
    low = F.lower(trimmed(c, profile))
    return _strict(F.when(low.isin(*TRUTHY), F.lit(True)).when(low.isin(*FALSY), F.lit(False)), c, "boolean", errors, profile)


def parse_integer(c: Column, errors: str = "null", profile: str = "spark") -> Column:
    """Exact whole numbers that fit a bigint; ``100.00`` is whole, ``1.5`` is not."""
    n = _number(c, profile)
    return _strict(F.when(n.rlike(WHOLE), F.substring_index(n, ".", 1).try_cast("bigint")), c, "integer", errors, profile)


def parse_float(c: Column, errors: str = "null", profile: str = "spark") -> Column:
    return _strict(_number(c, profile).try_cast("double"), c, "float", errors, profile)


def parse_date(c: Column, source_timezone: str = "UTC", errors: str = "null", profile: str = "spark", dayfirst: bool = False) -> Column:
    """UTC timestamp of a date text; only text without a zone is taken to be in `source_timezone`."""
    t = trimmed(c, profile)
    mask = F.translate(t, "0123456789" + _LETTERS, "9" * 10 + "a" * len(_LETTERS))
    aware = mask.isin(*[f"{_DAY}a{k}{z}" for k in _CLOCKS for z in _ZONES])
    value = _iso(t, mask, aware, dayfirst).try_cast("timestamp")
    if source_timezone != "UTC":
        value = F.when(aware, value).otherwise(F.to_utc_timestamp(value, source_timezone))
    return _strict(value, c, "date", errors, profile)


def _iso(t: Column, mask: Column, aware: Column, dayfirst: bool) -> Column:
    """The date text in ISO order, by its mask; null for other masks.

    Where day and month can't be told apart the month comes first, or the day with
    `dayfirst`, unless the number in the month's place is over 12.
    """
    part = lambda at, n: F.substring(t, at, n)
    date = lambda year, month, day: F.concat(year, F.lit("-"), month, F.lit("-"), day)
    number = lambda at: F.lpad(at.cast("string"), 2, "0")
    first, second = part(1, 2), part(4, 2)
    as_first, as_second = date(part(7, 4), first, second), date(part(7, 4), second, first)
    either = F.when(second <= "12", as_second).otherwise(as_first) if dayfirst else F.when(first <= "12", as_first).otherwise(as_second)

    def short(at: int) -> Column:
        place = F.position(F.lower(part(at, 3)), F.lit("".join(m[:3] for m in _MONTHS)))
        return F.when(place % 3 == 1, number(((place + 2) / 3).cast("int")))

    size = F.length(t)
    long = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(t, F.lit(1), size - 9)))
    utc = ~mask.endswith("a") | t.endswith("Z")
    return (
        F.when(mask.isin(_DAY, *[f"{_DAY} {k}" for k in _CLOCKS]), t)
        .when(mask.isin(*[f"{_DAY}a{k}" for k in _CLOCKS]) | (aware & utc), F.when(part(11, 1) == "T", t))
        .when(mask.isin("99/99/9999", "99-99-9999"), either)
        .when(mask == "99/99/9999 99:99:99", F.concat(as_first, F.lit(" "), part(12, 8)))
        .when(mask == "9999/99/99", F.translate(t, "/", "-"))
        .when(mask == "99999999", date(part(1, 4), part(5, 2), part(7, 2)))
        .when(mask == "aaa 99, 9999", date(part(9, 4), short(1), part(5, 2)))
        .when(mask == "99 aaa 9999", date(part(8, 4), short(4), first))
        .when(mask.isin(*["a" * n + " 99, 9999" for n in range(4, 10)]) & (long > 0), date(F.substring(t, size - 3, F.lit(4)), number(long), F.substring(t, size - 7, F.lit(2))))
    )


def parse_free_date(c: Column) -> Column:
    """Opt-in: any date text that dateutil reads, missing parts from 2000-01-01; Arrow batches in Python."""
    @F.pandas_udf(T.TimestampType())
    def read(s: pd.Series) -> pd.Series:
        from datetime import datetime

        from dateutil import parser

        def one(v: str | None) -> datetime | None:
            try:
                return parser.parse(v, default=datetime(2000, 1, 1)) if v and v.strip() else None
            except (ValueError, OverflowError):
                return None

        return pd.Series(pd.to_datetime([one(v) for v in s], utc=True))

    return read(c.cast("string"))


def looks_boolean(text: Column, number: Column) -> Column:
    """Whether trimmed text that isn't blank reads as a type; `number` is the text without ``$``, ``%`` and ``,``."""
    return F.lower(text).isin(*TRUTHY, *FALSY)


def looks_float(text: Column, number: Column) -> Column:
    return number.rlike(NUMERIC)


def looks_integer(text: Column, number: Column) -> Column:
    short = (F.length(number) < 19) & ~number.contains(".")  # most numbers: fits a bigint whatever its digits
    return number.rlike(NUMERIC) & F.when(short, True).otherwise(number.rlike(WHOLE) & F.substring_index(number, ".", 1).try_cast("bigint").isNotNull())


def looks_date(text: Column, number: Column) -> Column:
    return parse_date(text).isNotNull()


def _check(looks: Callable[[Column, Column], Column], c: Column, profile: str) -> Column:
    """Checks are false for null and true for blank text, which fits every type."""
    return F.when(c.isNull(), False).when(is_blank(c, profile), True).otherwise(F.coalesce(looks(trimmed(c, profile), _number(c, profile)), F.lit(False)))


def is_boolean(c: Column, profile: str = "spark") -> Column:
    return _check(looks_boolean, c, profile)


def is_integer(c: Column, profile: str = "spark") -> Column:
    return _check(looks_integer, c, profile)


def is_float(c: Column, profile: str = "spark") -> Column:
    return _check(looks_float, c, profile)


def is_date(c: Column, profile: str = "spark") -> Column:
    return _check(looks_date, c, profile)


def sha1_of(c: Column) -> Column:
    """SHA-1 hex of a value's text."""
    return F.sha1(c.cast("string").cast("binary"))


@dataclass(frozen=True)
class TypeRule:
    """One inferable type: its check of prepared text (see `looks_boolean`), its parser and the Spark type it gives."""

    name: str
    looks: Callable[[Column, Column], Column]
    parse: Callable[[Column], Column]
    spark_type: str


def type_rules(source_timezone: str = "UTC", profile: str = "spark", dayfirst: bool = False) -> list[TypeRule]:
    """The types in order of preference."""
    return [
        TypeRule("boolean", looks_boolean, lambda c: parse_boolean(c, profile=profile), "boolean"),
        TypeRule("integer", looks_integer, lambda c: parse_integer(c, profile=profile), "bigint"),
        TypeRule("float", looks_float, lambda c: parse_float(c, profile=profile), "double"),
        TypeRule("datetime", looks_date, lambda c: parse_date(c, source_timezone, profile=profile, dayfirst=dayfirst), "timestamp"),
    ]


def parser_for(name: str, rules: list[TypeRule]) -> Callable[[Column], Column] | None:
    return next((r.parse for r in rules if r.name == name), None)
