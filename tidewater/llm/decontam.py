"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A window of words walks through the CGK random-walk embedding (Chakraborty, Goldenberg,
Koucky): at step t the current word is output, and a random bit of (t, word) says whether
to move on. Windows at a small edit distance come out at a small Hamming distance. Each
repetition has a walk of its own and samples some output positions. An item is entered at
each of its words, so walks cover all of it wherever its edits lie; an entry and a place of
a document that agree on all samples make a candidate, and every candidate is verified by
the exact edit distance over the item's words.

k edits leave a run of at least (n - k) / (k + 1) of an item's n words unchanged. An entry
at the head of that run agrees with the document whenever its walk has not left the run by
the last sample. The chance of that follows from the sampled positions, and repetitions
are added until at most 1 - `recall` of such items are missed, however the edits lie. All
places of a document take a step together, and those that already disagree with every
item drop out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freeing, whole_rows
from .textcore import LOWER, U64, buffers, mix, slices, word_bounds, word_hashes

#: Bytes of benchmark text that one pass over the documents looks for; each word takes some 100 bytes in tables.
BLOCK_BYTES = 4 << 20
#: Most steps of a walk and most sampled steps.
STEPS, SAMPLES = 16, 4
EDITS = 0.2
#: Least chance that an item at the edit limit is found, in each length class; unchanged items always are.
RECALL = 0.999
#: Pairs of a place and an entry that are joined at a time.
PAIRS = 1 << 20
_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lowered and ASCII marks dropped, and each text's first word.

    Words of marks alone vanish, so spacing, case and punctuation are no edits.
    """
    keep = ~_MARKS[data]
    at = np.concatenate([[0], np.cumsum(keep)])
    body, off = LOWER[data[keep]], at[offsets]
    starts, ends, first = word_bounds(body, off)
    return word_hashes(body, starts, ends), first


def _row_end(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
    """Edits between `a` and the best stretch of `b` that ends at each place; it starts anywhere if `free`, else at 0."""
    places = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64) if free else places.copy()
    for i, word in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (b != word), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places  # insertions run along the row
    return row


def best_window(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Edits, start and end of the stretch of `b` nearest to `a`; the first, then the shortest, of equals."""
    row = _row_end(a, b, True)
    end = int(row.argmin())
    back = _row_end(a[::-1], b[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


def intact_run(words: int, edits: int) -> int:
    """Words of an item that lie unchanged in a row, wherever its edits are; at least so many."""
    return max(1, -(-(words - edits) // (edits + 1)))


def sampled_steps(run: int, exact: bool, recall: float, seed: int) -> list[tuple[np.ndarray, int, int]]:
    """Sampled steps, walk salt and least moves of each repetition that an intact run of `run` words needs.

    The walk's place at its last sample is binomial, so a repetition finds the run with the
    chance of a place within it. Walks that have hardly moved by then agree with too much:
    entries with fewer moves are left out, and not counted in that chance. A walk of no
    more steps than an `exact` item has words can't leave it.
    """
    steps, least = (min(run, STEPS // 2), 0) if exact else (min(2 * run, STEPS), run // 2)
    samples = min(SAMPLES, steps if exact else steps - 1)
    rng, missed, out = np.random.default_rng([seed, steps, exact]), 1.0, []
    while missed > 1 - recall or not out:
        at = np.sort(rng.choice(steps, samples, replace=False))
        at -= at[0]  # every word is entered, so a walk may begin at its first sample
        last = int(at[-1])
        if chance := sum(comb(last, k) for k in range(least, min(run - 1, last) + 1)) / 2**last:
            missed *= 1 - chance
            out.append((at, int(rng.integers(0, 1 << 63)), least))
    return out


class Items:
    """Sampled walks of a block of items, for all repetitions.

    An item is entered at each of its words, one in which no edit is allowed only at its
    first. A window's words outside the items' vocabulary can't match a sample; they only
    steer the walk.
    """

    def __init__(self, ids: list[int | None], texts: list[str], edits: float = EDITS, recall: float = RECALL, seed: int = 5):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        words, first = folded(data, np.cumsum([0, *map(len, raw)]))
        self.ids, self.words = ids, [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.most = [int(edits * len(w)) for w in self.words]
        self.vocabulary = np.unique(words)
        self.slot = np.zeros(1 << 20, np.int32)
        self.slot[(self.vocabulary >> U64(44)).astype(np.int64)] = np.arange(len(self.vocabulary))
        self.inside = np.zeros(1 << 22, bool)
        for k, w in enumerate(self.words):
            self.inside[_pair(np.full(len(w), k), self._ids_of(w))] = True
        self.length, self.limit = np.array([len(w) for w in self.words], np.int64), np.array(self.most, np.int64)
        self.rest = len(np.unique(self.vocabulary >> U64(44))) < len(self.vocabulary)
        self.tables: list[tuple] = []
        classes: dict[tuple[int, bool], list[int]] = {}
        for k, (w, most) in enumerate(zip(self.words, self.most, strict=True)):
            if len(w):
                exact = most == 0
                classes.setdefault((min(intact_run(len(w), most), STEPS // 2), exact), []).append(k)
        for (run, exact), members in sorted(classes.items()):
            # items one behind the other, each followed by so many zeros that no walk gets into the next
            flat = np.concatenate([np.append(self.words[k], np.zeros(STEPS, U64)) for k in members])
            size = self.length[members] + STEPS
            head = np.cumsum(size) - size
            n = np.ones_like(size) if exact else self.length[members]
            offset = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            entry = np.column_stack([np.repeat(np.array(members, np.int32), n), offset])
            starts, flat_ids = (np.repeat(head, n) + offset).astype(np.int32), self._ids(flat)
            for at, salt, least in sampled_steps(run, exact, recall, seed):
                _, place, got = self._walk(flat_ids, _bits(flat, U64(salt)), starts, at, None)
                some = np.flatnonzero(np.all([g > 0 for g in got], axis=0) & (place - starts >= least))  # others may walk past the item's end
                got = [g[some] for g in got]
                near = np.zeros(1 << 22, bool)
                if len(at) > 1:
                    near[_pair(got[0], got[1])] = True
                key = _fold(got)
                order = np.argsort(key)
                self.tables.append((at, U64(salt), near, key[order], some[order].astype(np.int32), entry))

    def _ids_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.vocabulary, words) + 1

    def _ids(self, words: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary, 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1) if self.rest else self.slot[(words >> U64(44)).astype(np.int64)]
        return np.where(self.vocabulary[at] == words, at + 1, 0).astype(np.int32)

    @staticmethod
    def _walk(ids: np.ndarray, bits: np.ndarray, starts: np.ndarray, at: np.ndarray, near: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Windows that are left, their places at the last sample and their words at each.

        With `near`, a window whose first two sampled words are no item's is gone.
        """
        live, place, got = starts, starts.copy(), []
        for t in range(int(at[-1]) + 1):
            if t == at[len(got)]:
                now = ids[place]
                if near is not None:
                    ok = now > 0
                    if len(got) == 1:
                        ok &= near[_pair(got[0], now)]
                    if len(got) > 0:
                        ok = np.flatnonzero(ok)
                        live, place, now, got = live[ok], place[ok], now[ok], [g[ok] for g in got]
                got.append(now)
                if len(got) == len(at):
                    break
            place += (bits[place] >> np.int32(t)) & np.int32(1)
        return live, place, got

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (first word, item, offset in the item of a word that agrees) of windows that agree in some repetition."""
        if not self.tables or not len(words):
            return (np.zeros(0, np.int64),) * 3
        body = np.concatenate([words, np.zeros(STEPS, U64)])
        ids, found = self._ids(body), []
        starts = np.flatnonzero(ids[: len(words)] > 0).astype(np.int32)  # the first sample is the first word
        for at, salt, near, key, order, entry in self.tables:
            live, _, got = self._walk(ids, _bits(body, salt), starts, at, near)
            if not len(live):
                continue
            mine = _fold(got)
            lo, hi = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
            ends = np.cumsum(hi - lo)
            a = 0
            while a < len(live):  # bounded memory where a phrase recurs in items and documents
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                n = hi[a:b] - lo[a:b]
                flat = np.repeat(lo[a:b], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                if len(flat):
                    start, pick = np.repeat(live[a:b], n).astype(np.int64), entry[order[flat]].astype(np.int64)
                    _, one = np.unique((start - pick[:, 1] + (1 << 20)) * len(self.words) + pick[:, 0], return_index=True)
                    found.append(np.column_stack([start, pick])[one])
                a = b
        if not found:
            return (np.zeros(0, np.int64),) * 3
        every = np.concatenate(found).astype(np.int64)
        begin, item = every[:, 0] - every[:, 2], every[:, 1]
        _, one = np.unique((begin + (1 << 20)) * len(self.words) + item, return_index=True)
        begin, item, start = begin[one], item[one], every[one, 0]
        # a window within the limit has so many places with words of the item; pairs that only look alike in `inside` count as well
        most, need = self.limit[item], self.length[item] - self.limit[item]
        size, have = self.length[item] + 2 * most, np.zeros(len(item), np.int64)
        for j in range(int(size.max(initial=0))):
            at = begin - most + j
            ok = (j < size) & (at >= 0) & (at < len(words))
            word = ids[np.where(ok, at, 0)]
            have += ok & (word > 0) & self.inside[_pair(item, word)]
        near = np.flatnonzero(have >= need)
        return start[near], item[near], (start - begin)[near]

    def matches(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Best verified window per text and item: edits, first word, number of words."""
        starts, which, offset = self.candidates(words)
        texts = np.searchsorted(first, starts, "right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for s, k, o, r in zip(starts.tolist(), which.tolist(), offset.tolist(), texts.tolist(), strict=True):
            item, most, head = self.words[k], self.most[k], int(first[r])
            lo = max(head, s - o - most)
            window = words[lo : min(int(first[r + 1]), s - o + len(item) + most)]
            if np.isin(item, window).sum() < len(item) - most:  # each missing word is an edit
                continue
            n, a, b = best_window(item, window)
            mine = (n, lo + a - head, b - a)
            if n <= most and mine < best.get((r, k), (1 << 60,)):
                best[r, k] = mine
        return best


def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (((item.astype(U64) << U64(32)) + word.astype(U64)) * U64(0x9E3779B97F4A7C15) >> U64(42)).astype(np.int64)


def _bits(words: np.ndarray, salt: np.uint64) -> np.ndarray:
    """The walk's bits of each word, step t's at bit t."""
    return ((words ^ salt) * U64(0x9E3779B97F4A7C15) >> U64(33)).astype(np.int32)


def _fold(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), U64)
    for c in columns:
        key = mix(key * U64(0x9E3779B97F4A7C15) + c.astype(U64))
    return key


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Benchmark items found in documents: ``id, item_id, edits, start_word, n_words``.

    One row per document row and item with a window whose word edit distance is at most
    `edits` times the item's words; of several windows that with fewest edits, then the
    first. An item at the limit is found with a chance of at least `recall`, whatever its
    length and wherever its edits lie. Words are compared without case and ASCII marks.
    `start_word` counts words that hold more than marks.

    Null and empty texts match nothing, items without words are never found, null item ids
    are kept as null, items with equal ids are looked for separately and each reported;
    repeated rows are reported each. Empty tables give no rows; further columns are
    ignored. Items reach the executors in blocks of `block_bytes`, one pass over the
    documents each, so any number of items works in bounded memory.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def search(looked: Items, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, found in _found(looked, batch.column("text")):
            if found:
                r, k, n, s, m = zip(*[(r + lo, k, *v) for (r, k), v in found.items()], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r)), pa.array([looked.ids[x] for x in k], pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.int64()), pa.array(m, pa.int32())], ["id", "item_id", "edits", "start_word", "n_words"])

    out = None
    for ids, texts in _blocks(items, item_col, item_text_col, block_bytes):
        part = _passed(source, ids, texts, edits, recall, search, f"id {kind}, item_id long, edits int, start_word long, n_words int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which `find_passages` finds no item, with all their columns; no shuffle.

    Null and empty texts stay; repeated rows stay or go together.
    """

    at = docs.columns.index(text_col)

    def search(looked: Items, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, found in _found(looked, batch.column(at)):
            ok = np.ones(hi - lo, bool)
            ok[[r for r, _ in found]] = False
            yield batch.slice(lo, hi - lo).filter(pa.array(ok))

    for ids, texts in _blocks(items, item_col, item_text_col, block_bytes):
        docs = _passed(docs, ids, texts, edits, recall, search)
    return docs


def _found(looked: Items, column: pa.Array) -> Iterator[tuple[int, int, dict]]:
    """Row ranges and what was found in them. Walks run over all texts of a range at once; one that crosses into the next text fails verification."""
    data, offsets = buffers(column)
    for lo, hi in slices(offsets, 512 << 10):
        base = offsets[lo]
        yield lo, hi, looked.matches(*folded(data[base : offsets[hi]], offsets[lo : hi + 1] - base))


def _passed(docs: DataFrame, ids: list, texts: list[str], edits: float, recall: float, search, schema: str | None = None) -> DataFrame:
    """One pass over the documents with a block of items, whose size is bounded; without a schema whole rows come out."""
    sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = Items(*sent.value, edits, recall)
        for batch in batches:
            yield from search(looked, batch)

    return docs.mapInArrow(freeing(run), schema) if schema else whole_rows(docs, run)


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of bounded text, one block (perhaps empty) at least; items without text are left out."""
    ids, texts, size, some = [], [], 0, False
    for row in items.select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator():
        if row[1] is None:
            continue
        if texts and size + len(row[1]) > block_bytes:
            yield ids, texts
            ids, texts, size, some = [], [], 0, True
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    if texts or not some:
        yield ids, texts


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_passages(docs, items).withColumnRenamed("id", "doc_id")
