"""Column overlap between tables: one unpivot, one distinct and one join for all column pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .infer import _c

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def _values(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct ``t, c, d, v``: table, column, type and non-null value as text."""
    out = None
    for name, df in tables.items():
        fields = [f for f in df.schema if not isinstance(f.dataType, _NESTED)]
        if not fields:
            continue
        cells = F.explode(F.array(*[F.struct(F.lit(f.name).alias("c"), F.lit(f.dataType.simpleString()).alias("d"), _c(f.name).cast("string").alias("v")) for f in fields]))
        part = df.select(F.lit(name).alias("t"), cells.alias("x")).select("t", "x.c", "x.d", "x.v").where("v IS NOT NULL")
        out = part if out is None else out.union(part)
    return out.distinct()


def similarities(tables: dict[str, DataFrame], threshold: float = 0.8) -> DataFrame:
    """Similar columns of every pair of tables, in the order of `tables`.

    ``source_table, source_column, target_table, target_column, data_type, similarity``:
    columns of one type whose shared distinct values make up at least `threshold` of either
    side's. Columns without values are similar to nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = "source_table string, source_column string, target_table string, target_column string, data_type string, similarity double"
    if len(tables) < 2:
        return spark.createDataFrame([], schema)
    order = F.create_map(*[x for k, n in enumerate(tables) for x in (F.lit(n), F.lit(k))])
    values = _values(tables)
    sizes = values.groupBy("t", "c").agg(F.count(F.lit(1)).alias("n"))
    a, b = values.alias("a"), values.alias("b")
    shared = a.join(b, (F.col("a.d") == F.col("b.d")) & (F.col("a.v") == F.col("b.v")) & (order[F.col("a.t")] < order[F.col("b.t")]))
    pairs = shared.groupBy(F.col("a.t").alias("st"), F.col("a.c").alias("sc"), F.col("b.t").alias("tt"), F.col("b.c").alias("tc"), F.col("a.d").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    left, right = sizes.toDF("st", "sc", "sn"), sizes.toDF("tt", "tc", "tn")
    rated = pairs.join(left, ["st", "sc"]).join(right, ["tt", "tc"]).withColumn("similarity", F.col("k") / F.least("sn", "tn"))
    return rated.where(F.col("similarity") >= threshold).select(*[F.col(x).alias(y) for x, y in zip(("st", "sc", "tt", "tc", "d"), ("source_table", "source_column", "target_table", "target_column", "data_type"), strict=True)], "similarity")


def same_names(tables: dict[str, DataFrame]) -> DataFrame:
    """``source_table, target_table, column_name`` of every pair of tables; metadata only."""
    spark, names = next(iter(tables.values())).sparkSession, list(tables)
    rows = [(a, b, c) for i, a in enumerate(names) for b in names[i + 1 :] for c in tables[a].columns if c in tables[b].columns]
    return spark.createDataFrame(rows, "source_table string, target_table string, column_name string")


def unshared(tables: dict[str, DataFrame], similar: DataFrame) -> DataFrame:
    """``table_name, column_name`` of columns that are similar to none."""
    spark: SparkSession = similar.sparkSession
    every = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns], "table_name string, column_name string")
    hit = similar.select(F.col("source_table").alias("table_name"), F.col("source_column").alias("column_name")).union(similar.select("target_table", "target_column")).distinct()
    return every.join(hit, ["table_name", "column_name"], "left_anti")


def table_similarities(source: tuple[str, DataFrame], target: tuple[str, DataFrame], threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Similar columns, same names and unshared columns of two tables."""
    tables = dict([source, target])
    similar = similarities(tables, threshold)
    return similar, same_names(tables), unshared(tables, similar)


def schema_similarities(tables: dict[str, DataFrame], threshold: float = 0.8) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Same names, similar and unshared columns over all pairs; three None for fewer than two tables."""
    if len(tables) < 2:
        return None, None, None
    similar = similarities(tables, threshold)
    return same_names(tables), similar, unshared(tables, similar)
