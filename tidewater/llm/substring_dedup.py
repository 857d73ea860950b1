"""Removal of repeated word windows by difference-cover anchors.

Only windows at positions whose residue modulo `PERIOD` lies in a difference cover are
hashed as anchors. Two equal stretches of PERIOD - 1 + ANCHOR words share an anchor that
is aligned in both, whatever their offsets, so every repeated window of 13 words contains
an anchor that a second place has too. Anchors found twice are extended: each window over
one is compared by a 128-bit key of its own, and the smallest document that has it keeps it.

Documents lie in slices of bounded text. A slice sends each distinct anchor and window
once, whatever its number of occurrences, so a passage that a third of all documents
share costs one entry a slice. Hash buckets grow in number with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices_for, text_bytes
from .textcore import M_WORD2, U64, buffers, joined, row_of, slices, window_hashes, word_bounds, word_hashes

#: {0, 1, 3} covers all differences modulo 7.
PERIOD, COVER = 7, (0, 1, 3)
LAST = (1 << 63) - 1
#: Slices that one partition may hold; they are worked on one after the other.
SLICES = 64


def _anchors(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices at cover positions of their text, and the anchor hashes there."""
    hashes = window_hashes(words, width)
    rows = row_of(first)[: len(hashes)]
    at = np.arange(len(hashes)) - first[rows]
    ok = np.isin(at % PERIOD, COVER) & (np.arange(len(hashes)) + width <= first[rows + 1])
    idx = np.flatnonzero(ok)
    return idx, hashes[idx]


def _windows(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word indices at which a whole window starts, and the two halves of its 128-bit key."""
    hashes, more = window_hashes(words, window), window_hashes(words, window, M_WORD2)
    rows = row_of(first)[: len(hashes)]
    idx = np.flatnonzero(np.arange(len(hashes)) + window <= first[rows + 1])
    return idx, hashes[idx], more[idx]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _spread(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash, from bits that the 64-bit comparison doesn't repeat."""
    return ((h * U64(M_WORD2)) >> U64(33)) % U64(buckets)


def _parts(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """Small runs of documents: bytes, offsets, ids (null: the largest) and their rows."""
    for batch in table.combine_chunks().to_batches():
        data, offsets = buffers(batch.column("text"))
        ids = np.array(batch.column("doc_id").fill_null(LAST))
        for lo, hi in slices(offsets):
            base = offsets[lo]
            yield data[base : offsets[hi]], offsets[lo : hi + 1] - base, ids[lo:hi], batch.slice(lo, hi - lo)


def _by_bucket(slice_id: int, keys: np.ndarray, buckets: int, *cols: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the packed columns of its keys."""
    b = _spread(keys, buckets).astype(np.int64)
    order = np.argsort(b, kind="stable")
    which, start = np.unique(b[order], return_index=True)
    stops = np.append(start, len(order))[1:]  # no keys, no buckets
    packed = [[c[order[i:j]].tobytes() for i, j in zip(start, stops, strict=True)] for c in (keys, *cols)]
    return pa.RecordBatch.from_arrays(
        [pa.array(which.astype(np.int32)), pa.array([slice_id] * len(which), pa.int64()), *[pa.array(p, pa.binary()) for p in packed]],
        ["bucket", "slice", "keys", *[f"c{k}" for k in range(len(cols))]],
    )


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Texts without the words of windows that a smaller document has too.

    A window is `window` consecutive words of one document. It goes, with every word it
    covers, if its word sequence also starts in a document with a smaller id; windows are
    judged on the input. Returns ``id, n_words, n_removed, kept_text``, one row per input
    row; kept words are joined by one space.

    Null and empty texts have no words (kept text ''). Null ids count as larger than every
    id and equal to each other. Rows with equal ids never remove one another's words.
    Texts shorter than a window keep all words. Further columns are ignored. Ids are
    integers. `window` is at least PERIOD.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    width = window - PERIOD + 1
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = slices_for(spark, text_bytes(docs, "text"))
    docs = docs.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long")).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICES)), "slice")

    def send_anchors(table: pa.Table) -> pa.Table:
        keys, shared = [], []
        for data, offsets, _, _ in _parts(table):
            starts, ends, first = word_bounds(data, offsets)
            words = word_hashes(data, starts, ends)
            idx, h = _anchors(words, first, width)
            h = h & U64(0xFFFFFFFFFF)  # 40 bits and the bucket: a false match only costs a look
            rows = row_of(first)[idx]
            order = np.lexsort((rows, h))
            h, rows = h[order], rows[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            twice = np.zeros(len(h), bool)
            twice[1:] = ~new[1:] & (rows[1:] != rows[:-1])
            group = np.cumsum(new) - 1
            keys.append(h[new])
            shared.append(np.bincount(group, weights=twice, minlength=int(new.sum())) > 0)
        h, flag = np.concatenate(keys or [np.zeros(0, U64)]), np.concatenate(shared or [np.zeros(0, bool)])
        order = np.argsort(h, kind="stable")
        h, flag = h[order], flag[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first_of = np.flatnonzero(new)
        count = np.diff(np.append(first_of, len(h)))
        flag = (np.add.reduceat(flag.astype(np.int64), first_of) if len(h) else np.zeros(0, np.int64)) + (count > 1) > 0
        return pa.Table.from_batches([_by_bucket(table["slice"][0].as_py(), h[new], n, flag.astype(np.uint8))])

    def meet_anchors(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, U64) for x in table["keys"].to_pylist()]
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in table["c0"].to_pylist()])
        every = np.concatenate(keys)
        uniq, back, count = np.unique(every, return_inverse=True, return_counts=True)
        hit = (count > 1) | (np.bincount(back, weights=flags) > 0)
        out, at = [], 0
        for k in keys:
            out.append(k[hit[back[at : at + len(k)]]].tobytes())
            at += len(k)
        return pa.table({"slice": table["slice"], "keys": pa.array(out, pa.binary())})

    def send_windows(table: pa.Table, answer: pa.Table) -> pa.Table:
        shared = _sorted(answer, "keys")
        hs, gs, ids = [], [], []
        for data, offsets, doc, _ in _parts(table):
            starts, ends, first = word_bounds(data, offsets)
            words = word_hashes(data, starts, ends)
            idx, h = _anchors(words, first, width)
            hit = np.zeros(len(words) + PERIOD + 1, np.int64)
            hit[idx[_member(h & U64(0xFFFFFFFFFF), shared)]] = 1
            total = np.concatenate([[0], np.cumsum(hit)])
            at, w, v = _windows(words, first, window)
            near = total[at + PERIOD] > total[at]
            hs.append(w[near])
            gs.append(v[near])
            ids.append(doc[row_of(first)[at[near]]])
        none = np.zeros(0, U64)
        h, g, doc = np.concatenate(hs or [none]), np.concatenate(gs or [none]), np.concatenate(ids or [np.zeros(0, np.int64)])
        order = np.lexsort((doc, g, h))
        h, g, doc = h[order], g[order], doc[order]
        first_of = np.flatnonzero(_new(h, g))
        last_of = np.append(first_of[1:], len(h)) - 1 if len(h) else first_of
        several = doc[last_of] != doc[first_of]
        sid = (table["slice"] if len(table) else answer["slice"])[0].as_py()
        return pa.Table.from_batches([_by_bucket(sid, h[first_of], n, g[first_of], doc[first_of], several.astype(np.uint8))])

    def meet_windows(table: pa.Table) -> pa.Table:
        columns = [[np.frombuffer(x, kind) for x in table[c].to_pylist()] for c, kind in (("keys", U64), ("c0", U64), ("c1", np.int64), ("c2", np.uint8))]
        h, g, doc, several = (np.concatenate(c) for c in columns)
        order = np.lexsort((doc, g, h))
        new = _new(h[order], g[order])
        smallest = np.empty(len(h), np.int64)
        smallest[order] = doc[order][new][np.cumsum(new) - 1]
        hit = (smallest < doc) | (several > 0)
        out, at = [], 0
        for k in columns[0]:
            part = slice(at, at + len(k))
            out.append([x[part][hit[part]].tobytes() for x in (h, g, smallest)])
            at += len(k)
        keys, more, least = zip(*out, strict=True)
        return pa.table({"slice": table["slice"], "keys": pa.array(keys, pa.binary()), "more": pa.array(more, pa.binary()), "least": pa.array(least, pa.binary())})

    def remove(table: pa.Table, answer: pa.Table) -> pa.Table:
        keys, more, least = (np.concatenate([np.frombuffer(x, kind) for x in answer[c].to_pylist()] or [np.zeros(0, kind)]) for c, kind in (("keys", U64), ("more", U64), ("least", np.int64)))
        order = np.lexsort((more, keys))
        keys, more, least = keys[order], more[order], least[order]
        times = int(np.diff(np.append(np.flatnonzero(_new(keys)), len(keys))).max(initial=0))  # keys that share their first half
        out = []
        for data, offsets, doc, rows in _parts(table):
            starts, ends, first = word_bounds(data, offsets)
            at, w, v = _windows(word_hashes(data, starts, ends), first, window)
            row = row_of(first)
            gone = np.zeros(len(starts) + 1, np.int64)
            head = np.searchsorted(keys, w)
            for k in range(times):
                place = np.minimum(head + k, len(keys) - 1)
                bad = at[(keys[place] == w) & (more[place] == v) & (least[place] < doc[row[at]])]
                np.add.at(gone, bad, 1)
                np.subtract.at(gone, bad + window, 1)
            keep = np.cumsum(gone)[:-1] == 0
            n_words = np.diff(first)
            kept = np.bincount(row[keep], minlength=len(n_words))
            out.append(pa.table({"id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - kept, pa.int64()), "kept_text": joined(data, starts, ends, first, keep)}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})

    sent = docs.groupBy("slice").applyInArrow(send_anchors, "bucket int, slice long, keys binary, c0 binary")
    shared = sent.groupBy("bucket").applyInArrow(meet_anchors, "slice long, keys binary")
    candidates = docs.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(send_windows, "bucket int, slice long, keys binary, c0 binary, c1 binary, c2 binary")
    found = candidates.groupBy("bucket").applyInArrow(meet_windows, "slice long, keys binary, more binary, least binary")
    return docs.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(remove, "id long, n_words long, n_removed long, kept_text string")


def _sorted(answer: pa.Table, name: str) -> np.ndarray:
    parts = [np.frombuffer(x, U64) for x in answer[name].to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, U64)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = repeated_windows(docs)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT rid, i + o AS p FROM (SELECT win.rid, win.i, unnest(range(0, 13)) AS o FROM win JOIN least USING (k) WHERE m < coalesce(win.doc_id, 9223372036854775807))),
words AS (SELECT rid, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT words.rid, string_agg(t, ' ' ORDER BY words.p) AS s, count(*) AS n FROM words ANTI JOIN gone ON words.rid = gone.rid AND words.p = gone.p GROUP BY words.rid)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""
