"""Jump consistent hashing: stable keys to shards without a ring table.

Lamping and Veach's jump hash gives key -> shard in [0, n). Going from n to n+1
shards moves a key only into the new shard, and about 1/(n+1) of the keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import named
from .textcore import U64, mix

#: Rows that one numbering task is meant to sort.
RUN_ROWS = 500_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys step together until none jumps."""
    key, at = keys.copy(), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    jump = np.zeros(len(keys), np.int64)
    while len(live):
        at[live] = jump[live]
        k = key[live] * U64(2862933555777941757) + U64(1)
        key[live] = k
        jump[live] = ((at[live] + 1) * (float(1 << 31) / ((k >> U64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[jump[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a 64-bit integer key column; null is a key of its own."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf(T.IntegerType())
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix(k.to_numpy(np.int64).view(U64) + U64(0x9E3779B97F4A7C15)), shards).astype(np.int32))

    return run(F.coalesce(key.cast("long"), F.lit(-(1 << 63))))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows: int | None = None) -> DataFrame:
    """Adds `out`, gapless from 0 within each group, without one task per group.

    Each group is cut into runs by a hash of the order columns; run sizes are counted,
    their prefix sums give each run's first number, and rows are numbered within runs.
    """
    spark: SparkSession = df.sparkSession
    n = rows if rows is not None else df.count()
    runs = max(1, -(-n // RUN_ROWS)) * 4
    cut = df.withColumn("__run", F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int"))
    sizes = cut.groupBy(*group, "__run").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__run").alias("__r"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__base"))
    same = F.col("__run") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy(*group, "__run").orderBy(*order)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = cut.repartition(width, *group, "__run").withColumn("__k", F.row_number().over(within) - 1)
    return (
        ranked.join(bases, same)
        .withColumn(out, (F.col("__base") + F.col("__k")).cast("long"))
        .drop("__run", "__r", "__base", "__k", *[f"__g{i}" for i in range(len(group))])
    )


def assign_shards(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16, carry: bool = False) -> DataFrame:
    """Shard, slot and grown shard of each row.

    Returns ``key, size, text_crc32, law, shard, slot, grown_shard``, one row per input
    row. `law` is ``key``: the key and the shard count alone decide, so adding a shard
    takes rows only into it (`grown_shard`). `size` is the text's UTF-8 bytes plus
    `overhead`; `slot` numbers a shard's rows from 0 without gaps.

    Null text has no bytes (crc32 0). A null key is one more key: such rows share a
    shard. Repeated rows share a shard and have slots of their own. An empty table gives
    no rows; further columns are ignored, whatever their names. With `carry` the input row
    comes along as a struct ``row``.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(key_col).alias("key"),
        (F.octet_length(body).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *([F.struct(*[named(c).alias(c) for c in df.columns]).alias("row")] if carry else []),
    )
    rows = rows.withColumns({"law": F.lit("key"), "shard": shard_of(F.col("key"), shards), "grown_shard": shard_of(F.col("key"), shards + 1)})
    return numbered(rows, ["shard"], ["key", "size", "text_crc32"], "slot", df.select(key_col).count()).select("key", "size", "text_crc32", "law", "shard", "slot", "grown_shard", *(["row"] if carry else []))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs).withColumnRenamed("key", "doc_id")
