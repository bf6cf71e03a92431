"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes.

Each text is the set of its hashed lower-case character n-grams. The log ratio
of an n-gram's smoothed document frequencies in toxic and other labelled texts
scales its column; a logistic regression over the scaled columns gives the
weights (the NB-SVM family of Wang and Manning, 2012).

Fitting: document frequencies are summed per partition before they are
shuffled; the ``features`` n-grams with the largest chi-square statistic go to
the driver, then only those columns of the sample. Both are bounded by
parameters, whatever the size of the tables.

Defined results: a null or empty text has no n-grams and gets the score of the
intercept alone; repeated rows get equal scores; labels without a text are
ignored, and ids that have both; of a repeated id the least text is fitted;
with no labelled rows, or one class only, the score is that class's
share (0 with none). Very long texts are read whole, a stretch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZES = (3, 4, 5)
BITS = 22
STRETCH = 1 << 20
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Hashes of the chosen n-grams, their weights (log ratio included), and the intercept."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams, in pieces; the text stands between two spaces."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    longest = SIZES[-1]
    for at in range(0, max(1, len(codes) - SIZES[0] + 1), STRETCH):
        a = codes[at : at + STRETCH + longest - 1]
        h = a * np.uint32(0x9E3779B1)
        for n in range(2, longest + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x01000193) + a[n - 1 :]
            if n in SIZES:
                g = h ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
                g ^= g >> np.uint32(15)
                g *= np.uint32(0x2C1B3C6D)
                g ^= g >> np.uint32(12)
                g *= np.uint32(0x297A2D39)
                yield g[:STRETCH] >> np.uint32(32 - BITS)


def distinct(text: str) -> np.ndarray:
    parts = [np.unique(g) for g in grams(text)]
    return np.unique(np.concatenate(parts)).astype(np.int32) if parts else np.zeros(0, np.int32)


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, label: str = "toxic", per_class: int = 4000, features: int = 1 << 14, least: int = 4, rounds: int = 150, ridge: float = 1.0) -> Model:
    """Learn from at most ``2 * per_class`` labelled rows that satisfy ``train``."""
    common.prepare(docs.sparkSession)
    rows = common.labelled_texts(docs, labels, label, train, per_class)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([distinct(t).tobytes() for t in common.texts(b)], pa.binary())], names=["label", "grams"])

    rows = common.cut(rows.mapInArrow(sets, "label int, grams binary"))
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        share = float(next(iter(total), 0))
        return Model(np.zeros(0, np.int32), np.zeros(0), 20.0 if share else -20.0)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for y, g in zip(b.column("label").to_pylist(), b.column("grams").to_pylist(), strict=True):
                by[y][np.frombuffer(g, np.int32)] += 1
        some = np.flatnonzero(by[0] + by[1])
        for at in range(0, len(some), 1 << 16):
            i = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(by[0][i].astype(np.int64)), pa.array(by[1][i].astype(np.int64))], names=["gram", "n0", "n1"])

    n0, n1 = total[0], total[1]
    stats = rows.mapInArrow(counts, "gram int, n0 bigint, n1 bigint").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1") / n1, F.col("n0") / n0
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    chi = (a - b) * (a - b) / (p * (1 - p) + 1e-9)
    top = stats.filter(F.col("n0") + F.col("n1") >= least).orderBy(chi.desc(), "gram").limit(features).collect()
    top.sort(key=lambda r: r["gram"])
    chosen = np.array([r["gram"] for r in top], np.int32)
    c0, c1 = (np.array([r[k] for r in top], float) + 1 for k in ("n0", "n1"))
    ratio = np.log((c1 / (n1 + 2)) / (c0 / (n0 + 2)))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.searchsorted(chosen, np.intersect1d(chosen, np.frombuffer(g, np.int32), True)).astype(np.uint16).tobytes() for g in b.column("grams").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(own, pa.binary())], names=["label", "columns"])

    data = rows.mapInArrow(columns, "label int, columns binary").collect()
    data.sort(key=lambda r: (r["label"], bytes(r["columns"])))  # the order of tasks doesn't matter
    y = np.array([r["label"] for r in data], float)
    cols = [np.frombuffer(bytes(r["columns"]), np.uint16) for r in data]
    del data
    w, bias = logistic(cols, y, ratio, rounds, ridge)
    return Model(chosen, (w * ratio).astype(np.float64), bias)


def logistic(cols: list[np.ndarray], y: np.ndarray, scale: np.ndarray, rounds: int, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Nesterov's method; column j is ``scale[j]`` where present.

    The matrix is kept as 16-bit column numbers and met a block of rows at a
    time, so the driver's memory is about two bytes an entry.
    """
    if len(scale) > 1 << 16:
        raise ValueError("at most 65,536 features")
    blocks = [(at, np.concatenate(cols[at : at + 256]), np.array([len(c) for c in cols[at : at + 256]])) for at in range(0, len(cols), 256)]
    cols.clear()

    def times(u: np.ndarray) -> np.ndarray:
        own = u * scale
        return np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), own[c], len(n)) for _, c, n in blocks])

    def transposed(err: np.ndarray) -> np.ndarray:
        out = np.zeros(len(scale))
        for at, c, n in blocks:
            out += np.bincount(c, np.repeat(err[at : at + len(n)], n), len(scale))
        return out * scale

    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    lam = ridge / max(1, len(y))
    # The Lipschitz constant by power iteration on the weighted Gram matrix.
    v = np.full(len(scale), 1.0)
    for _ in range(12):
        v /= np.linalg.norm(v) + 1e-12
        v = transposed(weight * times(v))
    step = 1 / (0.25 * (np.linalg.norm(v) + 1) * 1.2 + lam)
    w, last, bias, last_bias = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0
    for k in range(rounds):
        m = k / (k + 3)
        u, ub = w + m * (w - last), bias + m * (bias - last_bias)
        z = times(u) + ub
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        last, last_bias = w, bias
        w = u - step * (transposed(err) + lam * u)
        bias = ub - step * err.sum()
    return w, float(bias)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def values():
        m = shared.value
        slot = np.zeros(1 << BITS, np.int32)
        slot[m.grams] = np.arange(1, len(m.grams) + 1)
        weights = np.concatenate([[0.0], m.weights])

        def one(text: str) -> float:
            hits = [s[s > 0] for s in (slot[g] for g in grams(text))]
            z = m.bias + (float(weights[np.unique(np.concatenate(hits))].sum()) if hits else 0.0)
            return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))

        return lambda b: [pa.array([one(t) for t in common.texts(b)], pa.float64())]

    return common.with_columns(docs, [(column, T.DoubleType())], values)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold; columns as they were."""
    model = fit(docs, labels, common.fold("doc_id", 3) != 1)
    return score(docs, model, "__toxicity").filter(F.col("__toxicity") < threshold).drop("__toxicity")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"), common.fold("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
