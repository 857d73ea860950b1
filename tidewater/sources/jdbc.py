"""JDBC connections and loads. Options are built here; Spark's JDBC source moves the data."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.infer import _c, string_columns
from ..plans.ddl import SqlDialect

#: Bound parameters of one batched statement.
PARAMETERS = 100_000
#: Texts longer than this become unbounded types; fixed values.
LONG_TEXT, LONG_TEXT_BY_DIALECT = 256, {"mariadb": 255}


@dataclass(frozen=True)
class JdbcSource:
    """Where a database is; each method gives the options of one kind of connection."""

    host: str
    database: str
    port: int | None = None
    instance: str | None = None
    username: str | None = None
    password: str | None = None

    def _login(self) -> dict[str, str]:
        return {"user": self.username or "", "password": self.password or ""}

    def _mssql(self) -> str:
        place = f"{self.host}\\{self.instance}" if self.instance else self.host
        return f"jdbc:sqlserver://{place};databaseName={self.database};encrypt=true;trustServerCertificate=true"

    def trusted_mssql(self) -> dict[str, str]:
        return {"url": self._mssql() + ";integratedSecurity=true", "driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver"}

    def user_mssql(self) -> dict[str, str]:
        return {"url": self._mssql(), "driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", **self._login()}

    def user_postgres(self) -> dict[str, str]:
        return {"url": f"jdbc:postgresql://{self.host}:{self.port or 5432}/{quote(self.database)}?reWriteBatchedInserts=true", "driver": "org.postgresql.Driver", **self._login()}

    def user_mysql(self) -> dict[str, str]:
        return {"url": f"jdbc:mysql://{self.host}/{quote(self.database)}?characterEncoding=UTF-8&connectionCollation=utf8mb4_unicode_ci&rewriteBatchedStatements=true", "driver": "com.mysql.cj.jdbc.Driver", **self._login()}


def read_table(spark: SparkSession, options: dict[str, str], table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table or query; `partition` is (column, lower, upper, parts) for a parallel read."""
    reader = spark.read.format("jdbc").options(**options)
    reader = reader.option("query", query) if query else reader.option("dbtable", table)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def information_query(schema: str, table: str | None = None) -> str:
    """Information-schema query for base tables, or for a table's columns; literals are escaped."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    if table is None:
        return f"select TABLE_NAME from INFORMATION_SCHEMA.TABLES where TABLE_TYPE = 'BASE TABLE' and TABLE_SCHEMA = {lit(schema)}"
    return f"select COLUMN_NAME, DATA_TYPE, CHARACTER_MAXIMUM_LENGTH, NUMERIC_PRECISION from INFORMATION_SCHEMA.COLUMNS where TABLE_SCHEMA = {lit(schema)} and TABLE_NAME = {lit(table)}"


def column_list(df: DataFrame, dialect: SqlDialect) -> str:
    return ", ".join(dialect.escape(c) for c in df.columns)


def text_lengths(df: DataFrame) -> dict[str, int]:
    """Longest text of each string column; one job."""
    cols = string_columns(df)
    if not cols:
        return {}
    row = df.agg(*[F.max(F.length(_c(c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] or 0 for i, c in enumerate(cols)}


def _long(dialect: SqlDialect) -> int:
    return LONG_TEXT_BY_DIALECT.get(dialect.name, LONG_TEXT)


def placeholders(df: DataFrame, dialect: SqlDialect, long_text: int | None = None) -> list[str]:
    """Bind markers per column; long texts are cast to the dialect's unbounded type."""
    kind = "nvarchar(max)" if dialect.name == "mssql" else "varchar(21844)"
    size, long_text = text_lengths(df), long_text or _long(dialect)
    return [f"cast ( {dialect.placeholder} as {kind})" if size.get(c, 0) > long_text else dialect.placeholder for c in df.columns]


def insert_sql(df: DataFrame, schema: str, table: str, dialect: SqlDialect) -> str:
    return f"INSERT INTO {dialect.named(schema)}.{dialect.named(table)} ({column_list(df, dialect)}) VALUES ({', '.join(placeholders(df, dialect))})"


def union_rows(df: DataFrame) -> DataFrame:
    """Rows as a UNION of row selects loads them: exact duplicates once."""
    return df.distinct()


def load(df: DataFrame, options: dict[str, str], table: str, dialect: SqlDialect | None = None, batch_rows: int | None = None, dedupe: bool = False, atomic: bool = False) -> None:
    """Appends the table. NaN becomes null; duplicates stay unless `dedupe`.

    Each partition is a transaction of its own; `atomic` sends all rows through one task
    and so one transaction, for tables small enough for that.
    """
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    rows = df.withColumns({c: F.when(~F.isnan(_c(c)), _c(c)) for c in floats}) if floats else df
    rows = union_rows(rows) if dedupe else rows
    rows = rows.coalesce(1) if atomic else rows
    writer = rows.write.format("jdbc").options(**options).option("dbtable", table)
    writer = writer.option("batchsize", batch_rows or max(1, PARAMETERS // max(1, len(df.columns))))
    if dialect is not None and (size := text_lengths(df)):
        kind = lambda n: ("nvarchar(max)" if dialect.max_varchar is None else f"varchar({dialect.max_varchar})") if n > _long(dialect) else f"varchar({max(n, 1)})"
        if "derby" not in options.get("url", ""):
            writer = writer.option("createTableColumnTypes", ", ".join(f"`{c.replace('`', '``')}` {kind(n)}" for c, n in size.items()))
    if types := options.get("createTableColumnTypes"):
        writer = writer.option("createTableColumnTypes", types)
    writer.mode("append").save()


def load_fast(df: DataFrame, options: dict[str, str], table: str, batch_size: int = 1000) -> None:
    """`load` in small fixed batches; a failure raises RuntimeError, and that task's transaction is rolled back."""
    try:
        load(df, options, table, batch_rows=batch_size)
    except Exception as error:
        raise RuntimeError(f"loading {table} failed") from error
