"""Catalog lookups on Spark's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.infer import _c


def list_tables(spark: SparkSession, schema: str) -> list[str]:
    """Base tables of a schema, no views, sorted."""
    return sorted(t.name for t in spark.catalog.listTables(schema) if t.tableType in ("MANAGED", "EXTERNAL"))


def column_types(df: DataFrame) -> DataFrame:
    """``column_name, data_type`` in column order."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.where(_c(column).isNotNull()).select(_c(column).alias(column)).distinct()
