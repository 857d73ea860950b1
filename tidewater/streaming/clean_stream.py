"""Row-local cleaning on streams. Types are given or learnt from a static table: a stream can't be inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.parse import type_rules
from ..operators.infer import _c, infer_types


def learn_types(static: DataFrame) -> dict[str, str]:
    """Column types of a static table of the same source."""
    return infer_types(static)


def apply_types(stream: DataFrame, types: dict[str, str], source_timezone: str = "UTC") -> DataFrame:
    """The stream (or table) with its text columns parsed; text that doesn't fit becomes null."""
    by = {r.name: r for r in type_rules(source_timezone)}
    return stream.select(*[by[types[c]].parse(_c(c)).alias(c) if types.get(c) in by else _c(c) for c in stream.columns])
