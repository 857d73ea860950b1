"""Session helpers: the shared folder, checkpoints and partition counts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Input text that one Python group or one reduce task is meant to hold.
SLICE_BYTES = 24 << 20


#: Paths written by `saved` within the open `scratch` blocks, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new, unused path under ``spark.checkpoint.dir``.

    Where the session names no such folder, the checkpoint folder set on its context is
    taken, and on a local master, as in tests, a temporary one; on a cluster that raises,
    since other machines couldn't read it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidewater-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends there.

    The files go when the innermost open `scratch` block ends, or with `keep` when the one
    around it does; without such a block they stay, since the result is read later.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    owners = _open[:-1] if keep else _open
    if owners:
        owners[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the files that `saved` wrote in it; what leaves the block must not read them."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def release() -> None:
    """Give freed memory back to the system where the C library can; after a fit the driver would keep its peak."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a worker, which is used again, gives its freed memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def named(name: str) -> Column:
    """The top-level column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`run` over whole Arrow batches, whose rows it may only leave out. Columns stand by position, so any names will do."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    kinds = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(df.schema.fields)])
    return plain.mapInArrow(freeing(run), kinds).toDF(*df.columns)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column; one column-pruned scan."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def slices_for(spark: SparkSession, n_bytes: int, target: int = SLICE_BYTES) -> int:
    """How many groups keep each near `target` bytes, at least the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // target), 1)
