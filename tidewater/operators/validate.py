"""Validation of a table against a target's column information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .infer import _c
from .profile import column_metadata

#: Database type families; fixed values.
FAMILIES = {
    "integer": ("bigint", "int", "smallint", "tinyint", "mediumint", "integer"),
    "float": ("decimal", "numeric", "float", "double"),
    "string": ("varchar", "nvarchar", "char", "nchar", "string"),
    "boolean": ("bit", "bool", "boolean"),
    "datetime": ("date", "datetime", "datetime2", "time", "timestamp", "smalldatetime", "year"),
}
#: Families that a type may go into besides its own; strings take everything.
ALSO = {"integer": ("float",), "boolean": ("integer", "float")}
INFO = "COLUMN_NAME string, DATA_TYPE string, CHARACTER_MAXIMUM_LENGTH int, NUMERIC_PRECISION int"


class ExtraColumnsError(Exception):
    """The table has columns that the target lacks; carries them and their metadata."""

    def __init__(self, extra: DataFrame):
        self.extra_columns = extra
        self.metadata = column_metadata(extra, decimal_places=0)
        detail = {"string": ("max_size", "max_str_size"), "float": ("float_precision", "float_precision"), "integer": ("biggest_number", "biggest_num")}
        lines = []
        for m in self.metadata:
            line = f"name: {m['column_name']} \t type: {m['data_type']}"
            if m["data_type"] in detail:
                label, key = detail[m["data_type"]]
                line += f" \t {label}: {m[key]}"
            if m["data_type"] == "integer":
                line += f" \t smallest_number: {m['smallest_num']}"
            lines.append(line)
        super().__init__("The following columns need to be added:\n " + "\n".join(lines))


class ColumnDataError(Exception):
    """Values of some columns don't fit the target."""


def target_info(df: DataFrame) -> DataFrame:
    """Column information of a Spark table, in the shape of an information schema."""
    rows = []
    for f in df.schema:
        t, length, precision = f.dataType, None, None
        if isinstance(t, T.StringType):
            kind, length = "string", -1
        elif isinstance(t, T.DecimalType):
            kind, precision = "decimal", t.precision
        else:
            kind = {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}.get(t.simpleString(), t.simpleString())
            precision = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19, "double": 53, "float": 24}.get(kind)
        rows.append((f.name, kind, length, precision))
    return df.sparkSession.createDataFrame(rows, INFO)


def extra_columns(df: DataFrame, info: DataFrame) -> list[str]:
    """Sorted names that the target lacks, case-sensitive."""
    return sorted(set(df.columns) - {r["COLUMN_NAME"] for r in info.collect()})


def _mismatch(kind: str, db_type: str) -> bool:
    family = next((f for f, ts in FAMILIES.items() if db_type in ts), None)
    return not (family in (None, "string", kind) or family in ALSO.get(kind, ()))


def violations(df: DataFrame, info: DataFrame) -> DataFrame:
    """``column_name, kind, df_type, db_type, required, allowed``: extra, type, precision or length; one row per problem."""
    target = {r["COLUMN_NAME"]: r for r in info.collect()}
    rows = [(c, "extra", None, None, None, None) for c in extra_columns(df, info)]
    for m in column_metadata(df.select(*[_c(c) for c in df.columns if c in target])):
        t, kind = target[m["column_name"]], m["data_type"]
        if m["is_empty"]:
            continue
        if _mismatch(kind, t["DATA_TYPE"]):
            rows.append((m["column_name"], "type", kind, t["DATA_TYPE"], None, None))
            continue
        need, have, what = (m["max_str_size"], t["CHARACTER_MAXIMUM_LENGTH"], "length") if kind == "string" else (m["float_precision"], t["NUMERIC_PRECISION"], "precision")
        if need is not None and have not in (None, -1) and need > have:
            rows.append((m["column_name"], what, kind, t["DATA_TYPE"], need, have))
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string, df_type string, db_type string, required int, allowed int")


def fits(df: DataFrame, info: DataFrame) -> DataFrame:
    """``column_name, fits`` of each column of the table: whether `violations` has nothing against it."""
    bad = {r["column_name"] for r in violations(df, info).collect()}
    return df.sparkSession.createDataFrame([(c, c not in bad) for c in df.columns], "column_name string, fits boolean")


def validate(df: DataFrame, info: DataFrame) -> None:
    """Raises `ExtraColumnsError`, else `ColumnDataError` naming every problem, else nothing."""
    if extra := extra_columns(df, info):
        raise ExtraColumnsError(df.select(*[_c(c) for c in extra]))
    said = []
    for v in violations(df, info).collect():
        if v["kind"] == "type":
            said.append(f"{v['column_name']} in dataframe is of type {v['df_type']} while the database expects a type of {v['db_type']}")
        else:
            said.append(f"{v['column_name']} needs a minimum of {v['required']} {'size' if v['kind'] == 'length' else 'precision'} to be inserted")
    if said:
        raise ColumnDataError("\n".join(said))
