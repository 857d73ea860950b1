"""Column-name normalisation. Names are metadata: pure driver-side functions and one `toDF`."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

#: Characters that vanish, that become words, that become underscores.
DROPPED = "?()\\,/'"
WORDS = {"#": "Num", "$": "Dollars", "&": "And"}
BREAKS = ".: -"


def snake_name(name: str) -> str:
    """snake_case of a column name; `Total$Amount` becomes `total_dollars_amount`."""
    text = name.strip().translate({ord(c): None for c in DROPPED} | {ord(c): w for c, w in WORDS.items()})
    text = re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", text)
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text).lower()
    text = text.translate({ord(c): "_" for c in BREAKS})
    return text.replace("___", "_").replace("__", "_").strip("_")


def pascal_name(name: str) -> str:
    """PascalCase of a column name; letters after digits are capitals too."""
    return snake_name(name).title().replace("_", "")


def _renamed(df: DataFrame, names: list[str], on_clash: str) -> DataFrame:
    clash = [n for n, c in Counter(names).items() if c > 1]
    if clash and on_clash == "raise":
        raise ValueError(f"columns collide after renaming: {clash}")
    if clash:
        seen: Counter = Counter()
        out = []
        for n in names:
            seen[n] += 1
            out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
        names = out
    return df.toDF(*names)


def snake_columns(df: DataFrame, on_clash: str = "raise") -> DataFrame:
    """All columns in snake_case; `on_clash` is "raise" or "suffix"."""
    return _renamed(df, [snake_name(c) for c in df.columns], on_clash)


def pascal_columns(df: DataFrame, on_clash: str = "raise") -> DataFrame:
    """All columns in PascalCase; `on_clash` is "raise" or "suffix"."""
    return _renamed(df, [pascal_name(c) for c in df.columns], on_clash)
