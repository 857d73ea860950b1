"""Mixing sources to target weights over fixed-length token blocks.

Each source's documents form one stream, cut into blocks of `block` words. How many of its
slots each source fills is drawn for every output shard from a multinomial held to the
sources' quotas: shards are halved again and again, the draw of each half has a seed of its
own, and so any task can draw the counts of its shards alone. A source's k-th slot goes
through a keyed permutation of its block numbers, and blocks are joined to slots by number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import freeing, saved
from .sharding import RUN_ROWS, numbered
from .textcore import U64, buffers, mix, slices, word_bounds


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Target of each source: shares by weight, none above `cap` times its size.

    Sources stand in code-point order, null last, and take the weights in turn. What a
    capped source can't take is shared again among the others by weight.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in names}


def _drawn(left: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """`want` slots from a multinomial over what is left of the quotas; counts above a remainder are cut to it and drawn again."""
    got = np.zeros(len(left), np.int64)
    while want:
        rest = left - got
        more = np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
        got, want = got + more, want - int(more.sum())
    return got


def draws(quota: Sequence[int], shard_slots: int, seed: int, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the shards from `lo` up to `hi`: how many slots each source fills, and how many it fills in all shards before.

    All shards are full but the last, and all counts of a source make up its quota.
    """
    every = np.array(quota, np.int64)
    todo = [(0, -(-int(every.sum()) // shard_slots), every, np.zeros(len(every), np.int64))]
    while todo:
        a, b, own, before = todo.pop()
        if b <= lo or a >= hi or a >= b:
            continue
        if b - a == 1:
            yield a, own, before
            continue
        mid = (a + b) // 2
        left = _drawn(own, (mid - a) * shard_slots, np.random.default_rng([seed, a, b]))
        todo += [(mid, b, own - left, before + left), (a, mid, left, before)]


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed bijection of [0, n): Feistel rounds over the next even power of two, walked back into range."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.int64) + 1) // 2).astype(U64)
    low = (U64(1) << bits) - U64(1)
    x, live = k.astype(U64), np.arange(len(k))
    while len(live):
        b, m, v, kk = bits[live], low[live], x[live], key[live]
        left, right = v >> b, v & m
        for r in range(rounds):
            left, right = right, left ^ (mix(right + kk * U64(2 * r + 1) + U64(r)) & m)
        x[live] = (left << b) | right
        live = live[x[live] >= n[live].astype(U64)]
    return x.astype(np.int64)


def _key(seed: int, source: str | None) -> int:
    """A signed 64-bit key of a source."""
    text = f"{seed}|{'n' if source is None else 's' + source}".encode()
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


class Mix:
    """Plan of one mixture. `taken` counts words per document, `texts` builds the mixed texts.

    Null text has no words; a null source is a source of its own. Sources without words
    have target 0. Ids may be null or repeated, and rows may be equal: each row is a document
    of its own. An empty table gives an empty mixture. Further columns are ignored by `taken`
    and kept by `texts`, for which the rows must be carried along (`carry`). Columns of map
    type don't help to tell rows apart.

    One row per source (name, size, target) is held on the driver; documents, blocks, slots
    and shards never are.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, shard_slots: int = 8192, seed: int = 17, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, carry: bool = False):
        self.spark, self.block, self.shard_slots, self.seed, self.carry = df.sparkSession, block, shard_slots, seed, carry
        self.names, self.text_at = df.columns, df.columns.index(text_col)
        plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
        at = lambda c: F.col(f"c{df.columns.index(c)}")  # noqa: E731 - by position: any names will do
        told = [f.name for f in plain.schema if "map<" not in f.dataType.simpleString()]
        others = [c for k, c in enumerate(plain.columns) if k != self.text_at] if carry else []
        rows = plain.select(at(id_col).alias("doc_id"), at(source_col).alias("source"), F.xxhash64(F.coalesce(at(text_col).cast("string"), F.lit("")), at(id_col)).alias("tie"), F.xxhash64(*told).alias("rank"), at(text_col).cast("string").alias("text"), *others)
        self.rows = saved(counted(rows, carry).withColumn("rid", F.monotonically_increasing_id()))
        self.docs = self._told_apart(self.rows.select("rid", "doc_id", "source", "tie", "rank", "size"))
        per = self.docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        self.sizes = {r["source"]: int(r["size"]) for r in per}
        self.n_rows = sum(r["n"] for r in per)
        self.targets = targets(self.sizes, weights, share, cap)
        names = list(self.targets)
        blocks = {s: -(-self.sizes[s] // block) for s in names}
        self.quota = [self._quota(self.targets[s], self.sizes[s], cap) for s in names]
        self.about = [(s, self.sizes[s], float(self.targets[s]), blocks[s], _key(seed, s)) for s in names]

    @staticmethod
    def _told_apart(docs: DataFrame) -> DataFrame:
        """Adds ``twin``, which numbers equal rows from 0: the order of documents then depends on no row number of a run."""
        keys = ["doc_id", "source", "tie", "rank"]
        several = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*[F.col(k).alias(f"k_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
        twins = saved(docs.join(several, same, "left_semi"))
        if twins.isEmpty():
            return docs.withColumn("twin", F.lit(0).cast("long"))
        twins = numbered(twins, keys, ["rid"], "twin").select("rid", "twin")
        return saved(docs.join(twins, "rid", "left").withColumn("twin", F.coalesce("twin", F.lit(0).cast("long"))))

    def _quota(self, target: float, size: int, cap: float) -> int:
        """Slots whose words come nearest the target; the last block of a pass is short."""
        if not size:
            return 0
        per_pass = -(-size // self.block)
        whole, rest = divmod(target, size)
        slots = int(whole) * per_pass + min(per_pass, int(rest / self.block + 0.5))
        return min(slots, int(cap * per_pass))

    def sources(self) -> DataFrame:
        return self.spark.createDataFrame([a[:3] for a in self.about], "source string, source_size long, target double")

    def slots(self) -> DataFrame:
        """``out_shard, slot, source, pass, block``: the mixture's order, drawn and permuted where a shard's number lies."""
        quota, width, seed, names = self.quota, self.shard_slots, self.seed, [a[0] for a in self.about]
        n_blocks, keys = np.array([a[3] for a in self.about], np.int64), np.array([a[4] for a in self.about], np.int64).view(U64)
        shards = -(-sum(quota) // width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column("id"))
                for run_ in np.split(ids, np.flatnonzero(np.diff(ids) != 1) + 1):
                    if not len(run_):
                        continue
                    for shard, own, before in draws(quota, width, seed, int(run_[0]), int(run_[-1]) + 1):
                        j = np.repeat(np.arange(len(own)), own)
                        at = np.arange(len(j))
                        k = before[j] + at - (np.cumsum(own) - own)[j]
                        turn, n = k // n_blocks[j], n_blocks[j]
                        block = permute(k % n, n, mix(keys[j] + turn.view(U64)))
                        cols = [pa.array(np.full(len(j), shard, np.int32)), pa.array(shard * width + at), pa.array(names, pa.string()).take(pa.array(j)), pa.array(turn.astype(np.int32)), pa.array(block)]
                        yield pa.RecordBatch.from_arrays(cols, ["out_shard", "slot", "source", "pass", "block"])

        parts = min(max(1, shards), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self.spark.range(0, shards, 1, parts).mapInArrow(freeing(run), "out_shard int, slot long, source string, pass int, block long")

    def streams(self) -> DataFrame:
        """``rid, source, size, at``: each document's first word in its source's stream."""
        runs = max(1, -(-self.n_rows // RUN_ROWS)) * 4
        order = ["doc_id", "tie", "rank", "twin"]
        cut = self.docs.withColumn("run", F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int"))
        sums = cut.groupBy("source", "run").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("source", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        placed = cut.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
        placed = placed.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
        return placed.select("rid", "source", "size", (F.col("base") + F.col("own")).alias("at"))

    def pieces(self) -> DataFrame:
        """One row per document and block it lies in: ``lo, hi`` are its words there. Documents without words have none."""
        b = self.block
        docs = self.streams().where("size > 0")
        first, last = F.floor(F.col("at") / b).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / b).cast("long")
        each = docs.withColumn("block", F.explode(F.sequence(first, last)))
        lo = F.greatest(F.col("block") * b - F.col("at"), F.lit(0))
        hi = F.least((F.col("block") + 1) * b - F.col("at"), F.col("size"))
        return each.select("rid", "source", "block", lo.alias("lo"), hi.alias("hi"))

    def chosen(self) -> DataFrame:
        """The pieces that the mixture takes, once per slot: pieces joined to slots by block number."""
        slots = self.slots().withColumnRenamed("source", "s").withColumnRenamed("block", "b").hint("merge")  # estimated by shards, not slots, it would be broadcast
        return self.pieces().join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")

    def taken(self) -> DataFrame:
        """``doc_id, size, source, source_size, target, taken``, one row per input row."""
        got = self.chosen().groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("t"))
        kinds = self._held(self.sources().withColumnRenamed("source", "s"))
        each = self.docs.join(got, "rid", "left").join(kinds, F.col("source").eqNullSafe(F.col("s")))
        return each.select("doc_id", "size", "source", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"))

    def _held(self, kinds: DataFrame) -> DataFrame:
        """Broadcast the per-source table only while it is known to be small."""
        return F.broadcast(kinds) if len(self.about) <= 10_000 else kinds

    def texts(self) -> DataFrame:
        """The mixture as documents: each input row up to twice, with the words that were taken.

        Returns the input's columns and, last, ``copy`` (also where the input has a column of
        that name); the n-th copy of a document holds, in order, the pieces taken at least n
        times. A row whose words were all taken keeps its text unchanged; rows of which
        nothing was taken are gone.
        """
        if not self.carry:
            raise ValueError("texts() needs a mixture that carries its rows")
        times = self.chosen().groupBy("rid", "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
        lists = times.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "c")).alias("parts"))
        at, n = self.text_at, len(self.names)
        columns = ["text" if k == at else f"c{k}" for k in range(n)]
        both = self.rows.select("rid", "size", *columns).join(lists, "rid").select("size", "parts", *columns)
        kinds = T.StructType([T.StructField(f"c{k}", T.StringType() if k == at else both.schema[c].dataType) for k, c in enumerate(columns)] + [T.StructField("copy", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in slices(buffers(batch.column("text"))[1]):
                    part = batch.slice(lo, hi - lo)
                    made = [_copies(t, s, [(p["lo"], p["hi"], p["c"]) for p in ps]) for t, s, ps in zip(*(part.column(c).to_pylist() for c in ("text", "size", "parts")), strict=True)]
                    rows = pa.array([k for k, m in enumerate(made) for _ in m], pa.int64())
                    body = pa.array([t for m in made for t in m], pa.string())
                    cols = [body if k == at else part.column(c).take(rows) for k, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([k for m in made for k in range(len(m))], pa.int32())], kinds.names)

        return both.mapInArrow(freeing(run), kinds).toDF(*self.names, "copy")


def _copies(text: str, size: int, parts: list[tuple[int, int, int]]) -> list[str]:
    """Texts of the copies that the taken word ranges, each with its count, make up."""
    data, bounds, out = b"", None, []
    for n in range(1, max(c for *_, c in parts) + 1):
        runs = sorted((lo, hi) for lo, hi, c in parts if c >= n)
        if sum(hi - lo for lo, hi in runs) == size:
            out.append(text)
            continue
        if bounds is None:  # places of words, not words: a long text costs little more than itself
            data = text.encode()
            starts, ends, _ = word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            bounds = starts, ends
        starts, ends = bounds
        # bytes.split() parts words at 0x20 and 0x09-0x0D alone
        out.append(b" ".join(b" ".join(data[starts[lo] : ends[hi - 1]].split()) for lo, hi in runs).decode())
    return out


def counted(df: DataFrame, carry: bool) -> DataFrame:
    """The rows with ``size``, the number of words of `text`, which itself goes unless it is to be carried."""
    kept = [f for f in df.schema if carry or f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            size = np.zeros(len(batch), np.int64)
            for lo, hi in slices(offsets):
                base = offsets[lo]
                size[lo:hi] = np.diff(word_bounds(data[base : offsets[hi]], offsets[lo : hi + 1] - base)[2])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(size)], [*names, "size"])

    return df.mapInArrow(freeing(run), T.StructType([*[T.StructField(f.name, f.dataType) for f in kept], T.StructField("size", T.LongType())]))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken", "source")
