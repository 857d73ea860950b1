"""CREATE TABLE text from column metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.profile import column_metadata


@dataclass(frozen=True)
class SqlDialect:
    """Quoting, types and constraint texts of a database; ``{t}`` and ``{c}`` stand for table and column."""

    name: str
    opening: str
    closing: str
    datetime_type: str
    boolean_type: str
    max_varchar: int | None
    identity: str
    primary_key: str
    unique_key: str
    placeholder: str
    comment: str

    def escape(self, identifier: str) -> str:
        return f"{self.opening}{identifier.replace(self.closing, self.closing * 2)}{self.closing}"


    def named(self, identifier: str) -> str:
        """The identifier, escaped where it isn't a plain word."""
        return identifier if re.fullmatch(r"\w+", identifier) else self.escape(identifier)


#: Fixed values.
MSSQL = SqlDialect("mssql", "[", "]", "datetime2", "bit", None, "id int identity constraint pk_{t}_id primary key", " constraint pk_{t}_{c} primary key", " constraint ak_{t}_{c} unique", "?", "--")
MARIADB = SqlDialect("mariadb", "`", "`", "datetime", "bit", 21844, "id int auto_increment, constraint pk_{t}_id primary key (id)", ", constraint pk_{t}_{c} primary key ({c})", ", constraint ak_{t}_{c} unique ({c})", "%s", "#")
POSTGRES = SqlDialect("postgres", '"', '"', "timestamptz", "boolean", 10485760, "id serial constraint pk_{t}_id primary key", " constraint pk_{t}_{c} primary key", " constraint ak_{t}_{c} unique", "%s", "--")
SPARK = SqlDialect("spark", "`", "`", "timestamp", "boolean", 2**31 - 1, "id bigint", "", "", "?", "--")
DIALECTS = {d.name: d for d in (MSSQL, MARIADB, POSTGRES, SPARK)}
#: Integer types by the magnitude in bits that they hold.
_RANGES = (("smallint", 15), ("int", 31), ("bigint", 63))


def column_type(meta: dict, dialect: SqlDialect, varchar_padding: int = 20, float_precision: int = 10) -> str | None:
    """SQL type of one column; None where the dialect leaves the column out."""
    kind = meta["data_type"]
    if meta["is_empty"]:
        return "nvarchar(max)" if dialect.name == "mssql" else None
    if kind == "datetime":
        return dialect.datetime_type
    if kind == "boolean":
        return dialect.boolean_type
    if kind == "float":
        return f"decimal({max(float_precision, meta['float_precision'])}, {meta['decimal_places']})"
    if kind == "integer":
        lo, hi = meta["smallest_num"], meta["biggest_num"]
        tiny = {"mssql": (0, 255), "mariadb": (-128, 127), "spark": (-128, 127)}.get(dialect.name)
        if tiny and tiny[0] <= lo and hi <= tiny[1]:
            return "tinyint"
        return next(t for t, bits in _RANGES if (-(2.0**bits) <= lo and hi < 2.0**bits) or bits == 63)
    size = (meta["max_str_size"] or 0) + varchar_padding
    if dialect.name == "spark":
        return "string"
    if dialect.max_varchar is None:
        return "nvarchar(max)" if size >= 4000 else f"nvarchar({size})"
    return f"varchar({size})" if size <= dialect.max_varchar else None


def create_table(df: DataFrame, schema: str, table: str, dialect: SqlDialect, primary_key: str | None = None, unique: list[str] | None = None, history: bool = False, varchar_padding: int = 20, float_precision: int = 10, decimal_places: int = 2, identity: bool = False, compat: bool = False) -> str:
    """CREATE TABLE for a table's data; "" where no column is left.

    `history` adds SQL Server's system versioning. `compat` spells its default as older
    generators did (``sysutcdataetime``).
    """
    metas = column_metadata(df, primary_key, unique, decimal_places)
    parts = [dialect.identity.format(t=table)] if identity and metas else []
    for m in metas:
        if (kind := column_type(m, dialect, varchar_padding, float_precision)) is None:
            continue
        keys = dialect.primary_key * m["is_id"] + dialect.unique_key * m["is_unique"]
        parts.append(f"{dialect.escape(m['column_name'])} {kind}{keys.format(t=table, c=m['column_name'])}")
    if not parts:
        return ""
    place = f"{dialect.named(schema)}.{dialect.named(table)}"
    head = f"create table {place}\n(\n\t" if not (history and dialect.name == "mssql") else f"create table {place}\n(\n"
    body = ",\n\t".join(parts)
    if not (history and dialect.name == "mssql"):
        return f"{head}{body}\n)" + (" using parquet;" if dialect.name == "spark" else ";")
    now = {"start": "sysutcdatetime", "end": "sysutcdataetime" if compat else "sysutcdatetime"}
    periods = "".join(f"\tsystem_record_{k} datetime2 generated always as row {k}\n\t\tconstraint df_{table}_system_record_{k}\n\t\tdefault {f}() not null,\n" for k, f in now.items())
    return f"{head}{body},\n{periods}\t\tperiod for system_time(system_record_start, system_record_end)\n) with \n(\tsystem_versioning = on (history_table = {dialect.named(schema)}.{dialect.escape(table + '_history')})\n);"


@dataclass(frozen=True)
class Creator:
    """Stored arguments of `create_table`; `sql` gives the text for a dialect."""

    df: DataFrame
    schema: str
    table: str
    primary_key: str | None = None
    unique: list[str] | None = None
    history: bool = False
    varchar_padding: int = 20
    float_precision: int = 10
    decimal_places: int = 2
    identity: bool = False

    def sql(self, dialect: SqlDialect) -> str:
        return create_table(self.df, self.schema, self.table, dialect, self.primary_key, self.unique, self.history, self.varchar_padding, self.float_precision, self.decimal_places, self.identity)


def ddl_types(df: DataFrame, dialect: SqlDialect) -> DataFrame:
    """``column_name, sql_type`` of each column, null where the dialect leaves it out."""
    rows = [(m["column_name"], column_type(m, dialect)) for m in column_metadata(df)]
    return df.sparkSession.createDataFrame(rows, "column_name string, sql_type string")
