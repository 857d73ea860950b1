"""Naive Bayes support vectors for document quality (Wang and Manning).

Indicators of hashed byte n-grams are scaled by the log ratio of their smoothed class
counts; a linear hinge-loss model over them is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import SAMPLE_PER_CLASS, dual_coordinate_descent, held_out, platt, sigmoid, training_rows
from .shared import freeing, whole_rows
from .textcore import buffers, slices

BITS = 17
#: Bytes of text that are scored at a time; arrays over them are many times as large.
SLICE = 512 << 10
ORDERS = (2, 3, 4)


def ngram_columns(data: np.ndarray) -> list[np.ndarray]:
    """Hashed n-gram at each byte position, one array per order."""
    out, code = [], data.astype(np.uint32)
    for k in range(1, max(ORDERS)):
        code = code[:-1] | data[k:].astype(np.uint32) << np.uint32(8 * k) if len(code) > 1 else code[:0]
        if k + 1 in ORDERS:
            h = (code + np.uint32(k * 0x61C88647 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
    return out


class Indicators:
    """Distinct hashed n-grams of one text after another."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int64)

    def of(self, columns: list[np.ndarray], lo: int, hi: int) -> np.ndarray:
        idx = np.concatenate([c[lo : max(lo, hi - n + 1)] for c, n in zip(columns, ORDERS, strict=True)]).astype(np.int64)
        place = np.arange(len(idx))
        self.last[idx] = place  # the last of equal entries stays
        return idx[self.last[idx] == place]


class NaiveBayesSvm:
    """Fitted weights; `score` gives 0 to 1. Without both classes the score is the known share of label 1."""

    def __init__(self, texts: list[str], y: np.ndarray, share: float, smoothing: float = 1.0):
        self.weights, self.bias, self.slope, self.offset = np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0
        if not (y > 0).any() or not (y < 0).any():
            share = min(max(share, 1e-6), 1 - 1e-6)
            self.offset = float(np.log(share / (1 - share)))
            return
        maker = Indicators()
        rows = []
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            rows.append(maker.of(ngram_columns(data), 0, len(data)))
        prior = np.where(y > 0, share / (y > 0).mean(), (1 - share) / (y < 0).mean())
        halves = np.arange(len(y)) % 2
        seen = np.zeros(len(y))
        for part in (0, 1):  # decision values for the calibration come from rows not fitted on
            fit = np.flatnonzero(halves != part)
            if (y[fit] > 0).any() and (y[fit] < 0).any():
                v, b = self._fit([rows[i] for i in fit], y[fit], smoothing)
                for i in np.flatnonzero(halves == part):
                    seen[i] = self._value(rows[i], v, b)
        self.weights, self.bias = self._fit(rows, y, smoothing)
        self.slope, self.offset = platt(seen, y, prior)

    @staticmethod
    def _value(idx: np.ndarray, v: np.ndarray, b: float) -> float:
        return float(v[idx].sum() / np.sqrt(max(len(idx), 1)) + b)

    @staticmethod
    def _fit(rows: list[np.ndarray], y: np.ndarray, smoothing: float) -> tuple[np.ndarray, float]:
        dim = 1 << BITS
        counts = {s: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == s] or [np.zeros(0, np.int64)]), minlength=dim) + smoothing for s in (1, -1)}
        ratio = np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))
        values = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
        w = dual_coordinate_descent(rows, values, y, dim)
        return (w[:-1] * ratio).astype(np.float32), float(w[-1])

    def score(self, data: np.ndarray, offsets: np.ndarray, maker: Indicators) -> np.ndarray:
        columns = ngram_columns(data)
        raw = np.array([self._value(maker.of(columns, int(a), int(b)), self.weights, self.bias) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return sigmoid(self.slope * raw + self.offset)


def scored(docs: DataFrame, model, make) -> DataFrame:
    """``doc_id, score`` of every row; the model is broadcast once, its size fixed by its parameters."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = sent.value, make()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                base = offsets[lo]
                got = own.score(data[base : offsets[hi]], offsets[lo : hi + 1] - base, state)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(freeing(run), f"doc_id {kind}, score double")


def kept(docs: DataFrame, model, make, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is less than `below`; no shuffle."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = sent.value, make()
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            for lo, hi in slices(offsets, SLICE):
                base = offsets[lo]
                ok = own.score(data[base : offsets[hi]], offsets[lo : hi + 1] - base, state) < below
                yield batch.slice(lo, hi - lo).filter(pa.array(ok))

    return whole_rows(docs, run)


def judged(docs: DataFrame, model, make, folds: int, fold: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    out = scored(docs, model, make)
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Quality score of each document: ``doc_id, held_out, score, predicted``.

    Fitted on at most `per_class` labelled rows of each class outside the held-out fold
    (see `training_rows`); every whole text is scored, and nothing but the text counts.
    Null and empty texts have no n-grams and get the score of the bias. Null ids are
    scored; repeated rows get equal scores; an empty table gives no rows. Without labels
    of both classes all rows score the known share of label 1, 0.5 if none is known.
    Further columns are ignored.
    """
    texts, y, share = training_rows(docs, labels, label, folds, fold, per_class)
    return judged(docs, NaiveBayesSvm(texts, y, share), Indicators, folds, fold)


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
