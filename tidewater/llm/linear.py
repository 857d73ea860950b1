"""Linear hinge-loss models, their calibration and the bounded training sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a model is fitted on, those with the least hashed ids, and the bytes of text of each class.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2000, 64 << 20


def dual_coordinate_descent(rows: Sequence[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, dim: int, c: float = 1.0, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss model; the last weight is the bias.

    Dual coordinate descent (Hsieh et al.): one dual variable at a time, in a shuffled
    order each epoch, the weights kept up to date; it ends when no step moved. Rows are
    sparse: `rows` has indices, `values` their values. Classes weigh the same in total.
    """
    w, alpha = np.zeros(dim + 1), np.zeros(len(y))
    square = np.array([float(v @ v) + 1.0 for v in values])
    limit = np.where(y > 0, c * len(y) / max(2 * (y > 0).sum(), 1), c * len(y) / max(2 * (y < 0).sum(), 1))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            idx, val = rows[i], values[i]
            slope = y[i] * (w[idx] @ val + w[-1]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), limit[i])
            if step := new - alpha[i]:
                w[idx] += step * y[i] * val
                w[-1] += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def platt(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that fits labels to decision values; Newton steps with Platt's soft labels."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([scores, np.ones_like(scores)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ at)
        grad = x.T @ (weight * (p - t)) + 1e-6 * at
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        at = at - np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text has this remainder; null ids count as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int = SAMPLE_PER_CLASS, per_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels (1, -1) of the training sample, and the share of label 1.

    Rows of the held-out fold never take part. Repeated labels of an id count as 1 where
    any is 1; null labels and null ids are left out. The sample is `per_class` ids of
    each class, those least by hash, and of their rows, an id's equal texts once, as many of
    each class, as long as they hold at most `per_bytes` of text; so it doesn't change with
    partitioning, and however often an id is repeated the driver holds no more.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.union(part)
    ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, y int")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(ids), "doc_id")
    # first which rows, then their texts: narrow rows decide, and no more than the sample reaches the driver
    tell = rows.select("y", "doc_id", "h", F.octet_length("text").cast("long").alias("bytes")).distinct()
    chosen = []
    for y in (0, 1):
        total = 0
        for r in tell.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(per_class).collect():
            total += r["bytes"]
            if total > per_bytes:
                break
            chosen.append((r["doc_id"], r["h"], r["y"]))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, y int")
    found = rows.drop("y").join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    total = counts.get(0, 0) + counts.get(1, 0)
    return [r["text"] for r in found], np.array([1 if r["y"] else -1 for r in found]), counts.get(1, 0) / total if total else 0.5
