"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every coordinate: the first scatters shingles over a ring of
2^20 places, the second ranks the places; coordinate k reads the ranks circularly shifted
by k (C-MinHash, Li and Li). Documents with equal shingle sets form one class, and one
representative of each class is banded. Links are then confirmed in two passes, each on
full sets:

1. Every member of a bucket is compared with the bucket's first and last member, one row a
   member, and confirmed links are contracted to components. Copies of one text end here.
2. Classes in buckets that still hold several components are joined by their rare
   shingles: shingles are ordered by frequency, and two sets can link only if they share
   a shingle so early in both that the rest suffices (prefix and position filter), and
   only if the parity bitmaps of their shingles differ in few bits. Both are bounds, so no
   link is lost. Lists of a shingle with members of one component alone are dropped; a
   long list is dealt out in blocks, and only members outside its largest component visit
   all blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import connected_components
from .shared import freeing, saved, scratch
from .textcore import LOWER, M_BYTE, U64, buffers, mix, slices, window_hashes, word_bounds, word_hashes

RING = 1 << 20
ROWS = 5
MISS = 1e-5
#: Bits of a set's parity bitmap.
PARITY = 512
#: Members of a shingle's list that one block holds; where many members visit, blocks grow up to the second number.
BLOCK = (512, 1 << 14)
#: Pairs that are looked at together.
PAIRS = 1 << 18
LAST = (1 << 63) - 1


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that lose a pair at exactly the threshold with a chance of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def ring(width: int, seed: int = 11) -> np.ndarray:
    """Rows of `width` neighbouring ranks for each place of the ring, as a view."""
    ranks = np.random.default_rng(seed).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:width]]), width)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lowered.

    A text with fewer words than `width` has its whole sequence as one shingle; one
    without words has none.
    """
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(LOWER[data], starts, ends)
    h = window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def band_keys(sets: list[np.ndarray], ranks: np.ndarray, rows: int) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sets."""
    places = (mix(np.concatenate(sets) ^ U64(M_BYTE)) >> U64(44)).astype(np.int64)
    edges = np.cumsum([0, *map(len, sets)])
    sig = np.empty((len(sets), ranks.shape[1]), np.uint32)
    lo = 0
    while lo < len(sets):  # some thousand shingles at a time stay in cache
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 8192, "right")) - 1)
        if hi == lo + 1:
            best = np.full(ranks.shape[1], RING, np.uint32)
            for at in range(edges[lo], edges[hi], 8192):
                np.minimum(best, ranks[places[at : min(at + 8192, edges[hi])]].min(axis=0), out=best)
            sig[lo] = best
        else:
            sig[lo:hi] = np.minimum.reduceat(ranks[places[edges[lo] : edges[hi]]], edges[lo:hi] - edges[lo], axis=0)
        lo = hi
    cut = sig.reshape(len(sets), -1, rows).astype(U64)
    key = np.broadcast_to(np.arange(cut.shape[1], dtype=U64) + U64(1), cut.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * U64(M_BYTE) + cut[:, :, k])
    return key


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap (bytes) for each set: each shingle flips one bit, so two bitmaps differ in at most as many bits as the sets do in shingles."""
    out = np.zeros((len(sets), PARITY), np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[:] = np.bincount((mix(s ^ U64(M_BYTE >> 1)) % U64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(out, axis=1)


def _signed(df: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """``doc_id, tie, n, digest, bands`` of every text."""
    bands = bands_for(percent, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ring(bands * rows)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in slices(offsets):
                base = offsets[lo]
                sets = shingle_sets(data[base : offsets[hi]], offsets[lo : hi + 1] - base, width)
                keys: list[list[int] | None] = [None] * len(sets)
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    for k, row in zip(full, band_keys([sets[k] for k in full], ranks, rows).view(np.int64), strict=True):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("tie").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "tie", "n", "digest", "bands"],
                )

    return df.mapInArrow(freeing(run), "doc_id long, tie long, n long, digest binary, bands array<long>")


def _sets(df: DataFrame, width: int) -> DataFrame:
    """``digest, n, bits, tokens`` of the texts whose set has the digest that stands beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in slices(offsets):
                base = offsets[lo]
                sets = shingle_sets(data[base : offsets[hi]], offsets[lo : hi + 1] - base, width)
                wanted = batch.column("digest").slice(lo, hi - lo)
                right = [k for k, (s, d) in enumerate(zip(sets, wanted.to_pylist(), strict=True)) if set_digest(s) == d]
                some = [sets[k] for k in right]
                yield pa.RecordBatch.from_arrays(
                    [wanted.take(pa.array(right, pa.int64())), pa.array([len(s) for s in some], pa.int64()), pa.array([b.tobytes() for b in parity(some)], pa.binary()), pa.array([s.view(np.int64) for s in some], pa.list_(pa.int64()))],
                    ["digest", "n", "bits", "tokens"],
                )

    return df.mapInArrow(freeing(run), "digest binary, n long, bits binary, tokens array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of class numbers whose full sets link."""
    a = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("t"))
    return both.where(F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("t") - F.col("c"))).select("a", "b")


def may_link(n: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], bits: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Whether pairs can link whose first common shingle has `left` shingles from it on, by count and by bitmaps.

    100 c >= percent (n + m - c) asks for c >= percent (n + m) / (100 + percent) common
    shingles, and for n + m - 2 c shingles at most that only one of both has.
    """
    total = n[0] + n[1]
    ok = np.flatnonzero((100 + percent) * np.minimum(*left) >= percent * total)
    differ = np.bitwise_count(bits[0][ok] ^ bits[1][ok]).sum(axis=1, dtype=np.int64)
    need = -(-percent * total[ok] // (100 + percent))
    out = np.zeros(len(total), bool)
    out[ok] = differ <= total[ok] - 2 * need
    return out


class _List:
    """Part of the members of one block of one shingle's list."""

    def __init__(self, batch: pa.RecordBatch):
        self.cid, self.comp, self.n, self.left = (np.asarray(batch.column(c)) for c in ("cid", "comp", "n", "left"))
        self.main = np.asarray(batch.column("main"), bool)
        self.bits = buffers(batch.column("bits"))[0].reshape(len(batch), -1).view(U64)

    def meet(self, other: _List, percent: int, guests: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of a row here and one there that may link; rows here are `guests` of the other's block or live in it too."""
        step = max(1, PAIRS // max(1, len(other.cid)))
        for at in range(0, len(self.cid), step):
            mine = np.arange(at, min(at + step, len(self.cid)))
            i, j = (x.ravel() for x in np.meshgrid(mine, np.arange(len(other.cid)), indexing="ij"))
            ok = self.comp[i] != other.comp[j]
            # two guests meet in the blocks of both; members of the largest component visit none
            if guests:
                ok &= other.main[j] | (self.cid[i] < other.cid[j])
            elif other is self:
                ok &= i < j
            i, j = i[ok], j[ok]
            ok = may_link((self.n[i], other.n[j]), (self.left[i], other.left[j]), (self.bits[i], other.bits[j]), percent)
            if ok.any():
                a, b = self.cid[i[ok]], other.cid[j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _joined(live: DataFrame, percent: int, block: tuple[int, int]) -> DataFrame:
    """Pairs ``a, b`` of classes of different components that may link, from ``cid, comp, n, bits, tokens``."""
    tokens = live.select("cid", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # rarest first; `left` counts a set's shingles from this one on, which is all that it can still share
    rare = Window.partitionBy("cid").orderBy(F.col("df").desc(), F.col("token").desc())
    ranked = tokens.join(common, "token").withColumn("left", F.row_number().over(rare).cast("long"))
    posts = saved(ranked.join(live.select("cid", "comp", "n", "bits"), "cid").where(F.lit(100) * F.col("left") >= F.lit(percent) * F.col("n")).select("token", "cid", "comp", "n", "left", "bits"))
    parts = posts.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    lists = parts.groupBy("token").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    size = F.least(F.greatest(F.lit(block[0]), F.col("m") - F.col("top.c")), F.lit(block[1]))
    lists = lists.select("token", F.col("top.comp").alias("top"), F.ceil(F.col("m") / size).cast("int").alias("blocks"))
    dealt = posts.join(lists, "token").withColumn("main", F.col("comp") == F.col("top")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    to = F.when(F.col("main") | (F.col("blocks") == 1), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("block", F.explode(to)).withColumn("guest", F.col("block") != F.col("own")).select("token", "block", "guest", "cid", "comp", "n", "left", "bits", "main")
    width = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home = None, []
        for batch in batches:
            token, part, guest = (np.asarray(batch.column(c)) for c in ("token", "block", "guest"))
            new = np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (guest[1:] != guest[:-1]))
            cuts = np.append(np.flatnonzero(new), len(batch))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key, rows = (token[lo], part[lo]), _List(batch.slice(lo, hi - lo))
                if key != now:
                    now, home = key, []
                for other in home:  # members of the block come first, then its guests, a batch at a time
                    yield from rows.meet(other, percent, bool(guest[lo]))
                if not guest[lo]:
                    yield from rows.meet(rows, percent, False)
                    home.append(rows)

    dealt = dealt.repartition(width, "token", "block").sortWithinPartitions("token", "block", "guest")
    return dealt.mapInArrow(freeing(run), "a long, b long").distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str, percent: int, width: int, rows: int, block: tuple[int, int]) -> DataFrame:
    """``doc_id, tie, n, head`` of every row: `tie` hashes the text, `head` is the least (id, tie) of the row's component, null without words."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("tie"), "text")
    with scratch(df.sparkSession):
        signed = saved(_signed(docs, width, percent, rows), keep=True)
        least = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "tie"))
        classes = saved(signed.where("n > 0").groupBy("digest").agg(least.alias("least"), F.first("bands").alias("bands")))
        banded = classes.select("digest", F.explode("bands").alias("key"))
        shared = saved(banded.join(banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "key"))
        reps = classes.join(shared.select("digest").distinct(), "digest", "left_semi").select("digest", "least.id", "least.tie")
        texts = docs.join(reps, ["id", "tie"]).groupBy("id", "tie", "digest").agg(F.first("text").alias("text"))
        sets = saved(_sets(texts, width).withColumn("cid", F.monotonically_increasing_id()))
        buckets = saved(shared.join(sets.select("digest", "cid"), "digest").select("key", "cid"))
        ends = buckets.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
        pairs = buckets.join(ends, "key").select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("cid").alias("b")), F.struct(F.col("cid").alias("a"), F.col("hi").alias("b")))).alias("p"))
        links = connected_components(_confirmed(pairs.select("p.a", "p.b").where("a < b").distinct(), sets, percent))
        named = buckets.join(links.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
        open_ = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        live = saved(named.join(open_, "key", "left_semi").select("cid", "comp").distinct())
        if not live.isEmpty():
            more = _confirmed(_joined(sets.drop("digest").join(live, "cid"), percent, block), sets, percent)
            links = connected_components(links.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        owned = classes.select("digest", "least").join(sets.select("digest", "cid"), "digest", "left").join(links.withColumnRenamed("node", "cid"), "cid", "left")
        heads = owned.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("head"))
        table = saved(owned.join(heads, "component", "left").select("digest", F.coalesce("head", "least").alias("head")), keep=True)
    return signed.drop("bands").join(table, "digest", "left").select("doc_id", "tie", "n", "head")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, rows: int = ROWS, block: tuple[int, int] = BLOCK) -> DataFrame:
    """Component of near-duplicates of each document.

    Words are lower-cased (A-Z); a document's set is its distinct `width`-word shingles.
    Documents are linked where 100 * intersection >= percent * union, confirmed on full
    sets. Returns ``id, n_shingles, component_id, kept``, one row per input row:
    `component_id` is the smallest id reachable over links, `kept` says id = component_id.

    With fewer words than `width` the whole sequence is one shingle; null, empty and blank
    texts have an empty set, link with nothing and are kept. Null ids count as larger than
    every id; a component of null ids alone has component_id null and keeps all of them.
    Repeated rows link with each other (equal sets), so repeats with one id are all kept.
    An empty table gives no rows; further columns are ignored.
    """
    out = _grouped(df, id_col, text_col, percent, width, rows, block)
    who = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif(F.col("head.id"), F.lit(LAST)))
    return out.select(F.col("doc_id").alias("id"), F.col("n").alias("n_shingles"), who.alias("component_id"), F.col("doc_id").eqNullSafe(who).alias("kept"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, rows: int = ROWS, block: tuple[int, int] = BLOCK) -> DataFrame:
    """One row of each component of near-duplicates, and all rows without words, with all their columns.

    A component keeps its row with the least id (nulls last); of several texts under that id
    the one whose hash is least, and of rows that repeat id and text the one whose other
    columns hash least. Columns may have any names; an empty table gives no rows.
    """
    out = _grouped(df, id_col, text_col, percent, width, rows, block)
    at = out.where((F.coalesce("doc_id", F.lit(LAST)) == F.col("head.id")) & (F.col("tie") == F.col("head.tie")))
    heads = at.select("head.id", "head.tie").distinct()
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    id_at, text_at = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    text = F.coalesce(F.col(text_at).cast("string"), F.lit(""))
    wordy = text.rlike(r"[^\x20\x09-\x0D]")
    hashed = [f.name for f in plain.schema if "map<" not in f.dataType.simpleString()]
    rows_ = plain.where(wordy).select(F.coalesce(F.col(id_at).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("tie"), F.struct("*").alias("row"), F.xxhash64(*hashed).alias("rank"))
    one = rows_.join(heads, ["id", "tie"], "left_semi").groupBy("id", "tie").agg(F.min_by("row", "rank").alias("row"))
    return one.select("row.*").unionByName(plain.where(~wordy)).toDF(*df.columns)


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, percent=85).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM i JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT rid, rid AS at FROM w UNION SELECT r.rid, l.y FROM r JOIN l ON r.at = l.x),
m AS (SELECT r.rid, min(t.doc_id) AS component_id FROM r JOIN w t ON t.rid = r.at GROUP BY r.rid)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
