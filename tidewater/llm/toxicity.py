"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

The kernel of two strings counts the letter triples that both contain as subsequences,
each discounted by `DECAY` for every letter it skips, so gaps and inserted letters lower a
match instead of losing it; the normalised kernel is raised to a power, so that near
matches stand out. A text is read as windows of 10 letters over its words: case,
marks and spaces between single letters are folded away. Its similarity to a landmark is
read twice: that of its best window (a text is as toxic as its worst place), and how dense
windows like the landmark are (a stem that clean texts show by chance is toxic where it
recurs). Both are whitened by the landmarks' own kernel matrix, and a hinge-loss model is
fitted on them, from the sample's texts and from copies with letters inserted into words.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .linear import SAMPLE_PER_CLASS, dual_coordinate_descent, platt, sigmoid, training_rows
from .quality import judged, kept
from .shared import release
from .textcore import U64, row_of, slices, word_bounds

SPAN, DECAY, POWER, LANDMARKS = 10, 0.9, 2, 48
#: Kernel values (after the power) below this count as none, in training and in scoring; a word with two letters inserted has some 0.2 or more.
FLOOR = 0.03
#: Share of a landmark's own kernel that a window must have to count in the density.
FULL = 0.8
#: Letters inserted into each word of four bytes or more, for each gapped copy of a training text.
GAPS = (1, 2)
#: Share of the toxic texts that a landmark must occur in to be sure.
SURE = 0.05
#: Kernel rows that are looked up at a time.
ROWS = 1 << 15
#: Bytes of training text that are cut into substrings at a time; at most 65,536 texts train a model.
CHUNK = 256 << 10
LENGTHS = (4, 5, 6, 7, 8)
#: Landmarks that a toxic text is to hold before more of its kind bring nothing: enough for each of many insults in one text.
DEEP = 20
#: A density of one full match in `PER` units counts 1; `PRIOR` units more keep short texts from extremes.
PER, PRIOR = 50, 25
#: Symbols 1-26 are letters, 27 opens a unit, 28-31 stand for bytes from 128 on, 0 is skipped.
OPEN = 27
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 28 + np.arange(128) % 4
for _mark, _letter in zip(b"013457@", b"oieasta", strict=True):
    SYMBOL[_mark] = _letter - 96
TRIPLES = np.array(list(combinations(range(SPAN), 3)))
WEIGHT = (DECAY ** (TRIPLES[:, 2] - TRIPLES[:, 0] - 2)).astype(np.float32)
#: Places that three letters in a row of a landmark take with up to two letters inserted. A window without two such triples
#: counts as unlike every landmark, in training and in scoring; that is part of the similarity, not a bound on the kernel.
NEAR = TRIPLES[TRIPLES[:, 2] - TRIPLES[:, 0] <= 4]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, and start, end and text of each unit: a word, or a run of single letters, behind its opening symbol."""
    starts, ends, first = word_bounds(data, offsets)
    sym = SYMBOL[data]
    at = np.concatenate([[0], np.cumsum(sym > 0)])
    lo, hi, row = at[starts], at[ends], row_of(first)
    some = hi > lo
    lo, hi, row = lo[some], hi[some], row[some]
    single = hi - lo == 1
    new = np.ones(len(lo), bool)
    new[1:] = ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(lo)) - 1 if len(head) else head
    shift = np.arange(len(head))
    opened = np.insert(sym[sym > 0], lo[head], OPEN)
    return np.concatenate([opened, np.zeros(SPAN, np.uint8)]), lo[head] + shift, hi[tail] + shift + 1, row[head]


def codes(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray, row: np.ndarray, length: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows of `length` symbols and their texts; units shorter than that give one window if `short`."""
    n = np.maximum(hi - lo - length + 1, 1 if short else 0)
    unit = np.repeat(np.arange(len(lo)), n)
    at = lo[unit] + np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
    code = np.zeros(len(at), U64)
    for k in range(length):
        code |= np.where(at + k < hi[unit], sym[np.minimum(at + k, len(sym) - 1)], 0).astype(U64) << U64(5 * k)
    return code, row[unit]


def letters(code: np.ndarray) -> np.ndarray:
    return ((code[:, None] >> (U64(5) * np.arange(SPAN, dtype=U64))) & U64(31)).astype(np.int32)


def triples(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple index and weight at each place triple; places past the end weigh 0."""
    a, b, c = (s[:, TRIPLES[:, k]] for k in range(3))
    return a << 10 | b << 5 | c, np.where(c > 0, WEIGHT, np.float32(0))


def _decayed(x: np.ndarray) -> np.ndarray:
    """At each pair of places the sum over earlier pairs, times `DECAY` for each letter skipped."""
    half, out = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, SPAN):
        half[i] = half[i - 1] * np.float32(DECAY) + x[i - 1]
    for j in range(1, SPAN):
        out[:, j] = out[:, j - 1] * np.float32(DECAY) + half[:, j - 1]
    return out


def norms(s: np.ndarray) -> np.ndarray:
    """Square root of each string's kernel with itself."""
    t = s.T
    same = ((t[:, None] == t[None]) & (t[:, None] > 0)).astype(np.float32)
    return np.sqrt((same * _decayed(same * _decayed(same))).sum(axis=(0, 1)))


def gapped(data: np.ndarray, offsets: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The texts with `n` random letters inserted at random places inside each word of four bytes or more."""
    starts, ends, _ = word_bounds(data, offsets)
    long = ends - starts >= 4
    lo, size = starts[long] + 1, (ends - starts)[long] - 1
    at = np.sort(np.concatenate([lo + (rng.random(len(lo)) * size).astype(np.int64) for _ in range(n)]))
    return np.insert(data, at, rng.integers(97, 123, len(at)).astype(np.uint8)), offsets + np.searchsorted(at, offsets)


class StringKernelSvm:
    """Landmarks and weights; `score` gives 0 to 1. Without both classes the score is the known share of label 1."""

    def __init__(self, texts: list[str], y: np.ndarray, share: float, landmarks: int = LANDMARKS):
        self.slope, self.offset, self.bias = 1.0, 0.0, 0.0
        self._landmarks(np.zeros(0, U64))
        self.alpha = np.zeros(0)
        if not (y > 0).any() or not (y < 0).any():
            share = min(max(share, 1e-6), 1 - 1e-6)
            self.offset = float(np.log(share / (1 - share)))
            return
        if len(texts) > 1 << 16:
            raise ValueError("at most 65,536 texts train a model")  # a text's number has 16 bits in `_choose`
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        code, sure = self._choose(data, offsets, y, landmarks)
        self._landmarks(code)
        x, of = self._sample(data, offsets, y, sure)
        y = y[of]
        value, vector = np.linalg.eigh(self.gram + 1e-3 * np.eye(len(self.gram)))
        white = vector @ np.diag(value**-0.5) @ vector.T if len(value) else np.zeros((0, 0))
        white = np.kron(np.eye(2), white)
        z, every = x @ white, np.arange(x.shape[1])
        fold, seen = of % 2, np.zeros(len(y))
        for part in (0, 1):  # decision values for the calibration come from rows not fitted on
            fit = np.flatnonzero(fold != part)
            if (y[fit] > 0).any() and (y[fit] < 0).any():
                w = dual_coordinate_descent([every] * len(fit), list(z[fit]), y[fit], len(every))
                seen[fold == part] = z[fold == part] @ w[:-1] + w[-1]
        w = dual_coordinate_descent([every] * len(y), list(z), y, len(every))
        self.alpha, self.bias = white @ w[:-1], float(w[-1])
        self.slope, self.offset = platt(seen, y, np.where(y > 0, share / (y > 0).mean(), (1 - share) / (y < 0).mean()))

    def _sample(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similarities of the texts and of their gapped copies, and the text of each row.

        A toxic text whose copies lost what makes it toxic would teach nothing, so only those
        have copies that hold a sure landmark: one that no other text holds and so many toxic
        ones do that it isn't chance. The other class has copies of all its texts.
        """
        rng = np.random.default_rng(1)
        parts = [(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, CHUNK)]
        x = np.concatenate([self.similar(*p) for p in parts])
        copied = np.flatnonzero((y < 0) | sure)
        rows, of = [x], [np.arange(len(y))]
        for n in GAPS:
            rows.append(np.concatenate([self.similar(*gapped(*p, n, rng)) for p in parts])[copied])
            of.append(copied)
        return np.concatenate(rows), np.concatenate(of)

    def _landmarks(self, code: np.ndarray) -> None:
        s = letters(code)
        idx, w = triples(s)
        size = norms(s)
        table = np.zeros((1 << 15, len(code)), np.float32)
        for z in range(len(code)):
            np.add.at(table[:, z], idx[z], w[z])
        self.table = table / np.maximum(size, 1e-9).astype(np.float32)
        self.most = self.table.max(axis=1) if len(code) else np.zeros(1 << 15, np.float32)
        self.near = (table >= DECAY).any(axis=1) if len(code) else np.zeros(1 << 15, bool)
        self.near[: 1 << 10] = False
        self.codes, self.size = code, np.maximum(size, 1e-9).astype(np.float32)
        self.gram = self._kernel(code, 0.0)[1].astype(np.float64)

    def _kernel(self, code: np.ndarray, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose kernel with some landmark may reach `floor`, and their normalised kernel with each, raised to `POWER` (which leaves it a kernel), and whether they hold it nearly whole.

        The bound takes each triple's greatest weight in a landmark. Triples that no landmark has are skipped.
        """
        rows, values, whole = [np.zeros(0, np.int64)], [np.zeros((0, self.table.shape[1]), np.float32)], [np.zeros((0, self.table.shape[1]), bool)]
        for k in range(0, len(code), 2048):
            s = letters(code[k : k + 2048])
            idx, w = triples(s)
            size = np.maximum(norms(s), np.float32(1e-9))
            most = self.most[idx] * w
            keep = np.flatnonzero((most.sum(axis=1) / size) ** POWER >= floor)
            out = np.zeros((len(keep), self.table.shape[1]), np.float32)
            row, place = np.nonzero(most[keep])
            if len(row):
                some, head = np.unique(row, return_index=True)
                out[some] = np.add.reduceat(self.table[idx[keep[row], place]] * w[keep[row], place][:, None], head, axis=0)
            rows.append(keep + k)
            values.append((out / size[keep, None]) ** POWER)
            whole.append(out >= np.float32(FULL) * self.size)
        return np.concatenate(rows), np.concatenate(values), np.concatenate(whole)

    def _choose(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, most: int, pool: int = 3000) -> tuple[np.ndarray, np.ndarray]:
        """Substrings that between them occur in most toxic texts and in hardly any other, and whether each text holds a sure one.

        Greedy cover: the next landmark is the one that reaches most toxic texts which have
        fewer than `DEEP` so far, each other text that it reaches counting against it fivefold,
        or twofold where the reach is that of repeats. One that gains less than a hundredth of
        the toxic texts is left out, for chance brings as much; so is a part or an extension of
        a landmark, if both open a unit or neither does, for the kernel sees it anyway. One is
        sure if no other text holds it and at least `SURE` of the toxic ones do.
        """
        toxic, found = y > 0, []
        for length in LENGTHS:
            keys = []
            for lo, hi in slices(offsets, CHUNK):  # a few texts at a time bound the driver's memory
                base = offsets[lo]
                code, text = codes(*units(data[base : offsets[hi]], offsets[lo : hi + 1] - base), length, False)
                once, times = np.unique(code << U64(16) | (text + lo).astype(U64), return_counts=True)
                keys.append(once << U64(1) | (times > 1).astype(U64))
            key = np.concatenate(keys)
            keys.clear()
            key.sort()  # in place: one array of keys and its two parts are all that the driver holds
            again, text = (key & U64(1)).astype(bool), (key >> U64(1)).astype(np.uint16)
            key >>= U64(17)
            code = key
            for code, text, weight in ((code, text, 5.0), (code[again], text[again], 2.0)):  # noqa: PLW2901 - texts that hold it, then those that repeat it
                head = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
                if not len(head):
                    continue
                hits = np.add.reduceat(toxic[text].astype(np.int64), head)
                other = np.diff(np.append(head, len(code))) - hits
                worth = hits / toxic.sum() - 4 * other / (~toxic).sum()
                best = np.argsort(-worth, kind="stable")[:pool]
                stop = np.append(head[1:], len(code))
                found += [(worth[b], -length, int(code[head[b]]), text[head[b] : stop[b]], weight) for b in best if worth[b] > 0 and hits[b] > 1]
        found = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[: 2 * pool]
        inside = np.zeros((len(found), len(y)), bool)
        for k, f in enumerate(found):
            inside[k, f[3]] = True
        spelt = [bytes(x for x in row if x) for row in letters(np.array([f[2] for f in found], U64)).tolist()]
        opens = [w[0] == OPEN for w in spelt]
        cost, reached, chosen = np.array([f[4] for f in found]) * inside[:, ~toxic].sum(axis=1), np.zeros(len(y), np.int64), []
        sure = np.zeros(len(y), bool)
        while len(chosen) < most and found:
            gain = inside[:, toxic & (reached < DEEP)].sum(axis=1) - cost
            k = int(gain.argmax())
            if gain[k] < max(1, toxic.sum() / 100):
                break
            chosen.append(found[k][2])
            reached += inside[k]
            if found[k][4] == 5.0 and not inside[k, ~toxic].any() and inside[k].sum() >= SURE * toxic.sum():
                sure |= inside[k]
            cost[[j for j, w in enumerate(spelt) if opens[j] == opens[k] and (w in spelt[k] or spelt[k] in w)]] = np.inf
        return np.array(chosen, U64), sure

    def similar(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's best kernel value with each landmark, then the density of those of windows that hold it nearly whole (`FULL`)."""
        m = len(self.codes)
        out = np.zeros((len(offsets) - 1, 2 * m), np.float32)
        if not m:
            return out
        parts = units(data, offsets)
        size = np.bincount(parts[3], minlength=len(out)) + PRIOR
        code, row = codes(*parts, SPAN, True)
        distinct, back = np.unique(code, return_inverse=True)
        s = letters(distinct)
        hits = np.zeros(len(distinct), np.int8)
        for a, b, c in NEAR:
            third = s[:, c]
            hits += self.near[s[:, a] << 10 | s[:, b] << 5 | third] & (third > 0)
        look = np.flatnonzero(hits >= 2)
        rows, kernel, whole = self._kernel(distinct[look])
        number = np.full(len(distinct), -1)
        number[look[rows]] = np.arange(len(rows))
        which = number[back]
        some = np.flatnonzero(which >= 0)
        if len(some):
            texts, head = np.unique(row[some], return_index=True)
            k, stop = 0, np.append(head[1:], len(some))
            while k < len(texts):  # whole texts, some rows of the kernel at a time
                a = head[k]
                upto = max(k + 1, int(np.searchsorted(stop, a + ROWS, "right")))
                pick, at = which[some[a : stop[upto - 1]]], head[k:upto] - a
                near = kernel[pick]
                near[near < FLOOR] = 0
                out[texts[k:upto], :m] = np.maximum.reduceat(near, at, axis=0)
                near[~whole[pick]] = 0
                out[texts[k:upto], m:] = np.add.reduceat(near, at, axis=0)
                k = upto
        out[:, m:] = np.minimum(out[:, m:] * (PER / size)[:, None], 1)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray, _state: object = None) -> np.ndarray:
        return sigmoid(self.slope * (self.similar(data, offsets) @ self.alpha + self.bias) + self.offset)


def _fitted(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> tuple[StringKernelSvm, bool]:
    """The model, and whether both classes are known; the sample's memory is given back."""
    texts, y, share = training_rows(docs, labels, label, folds, fold, per_class)
    model, both = StringKernelSvm(texts, y, share), len(set(y.tolist())) == 2
    del texts
    release()
    return model, both


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Toxicity score of each document: ``doc_id, held_out, score, predicted``.

    Fitted on at most `per_class` labelled rows of each class outside the held-out fold
    (see `training_rows`); every whole text is scored, and nothing but the text counts.
    Null, empty and letterless texts match no landmark and get the score of the bias. Null
    ids are scored; repeated rows get equal scores; an empty table gives no rows. Without
    labels of both classes all rows score the known share of label 1, 0.5 if none is
    known. Further columns are ignored.
    """
    model, _ = _fitted(docs, labels, label, folds, fold, per_class)
    return judged(docs, model, lambda: None, folds, fold)


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The documents that `score_toxicity` predicts not to be toxic, with all their columns.

    Fitted as there, on `docs` joined to `labels`; the same holds for nulls, empty texts and
    repeated rows. Where no label is known every row scores 0.5 and would go, so then all stay.
    """
    model, both = _fitted(docs, labels, label, folds, fold, per_class)
    return kept(docs, model, lambda: None) if both else docs


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
