"""Quality: similarity-weighted votes of labelled neighbours in a latent space.

A text is a bag of terms: its lower-case words (hashed to WORDS buckets), trigrams
of character kinds (lower, upper, digit, blank, one kind for each common mark,
other) and events of repetition (a word equal to the one before, a line seen
before, the share of words seen before). Logarithmic counts, weighted by inverse document frequency, of a
bounded labelled sample are factored by a truncated singular value
decomposition; the labelled vectors in that latent space are broadcast. Every
document is projected, its cosines with all labelled vectors are computed
exactly as blocks of matrix products, and the labels of its nearest neighbours
are summed with a power of the similarity as weight.

What is broadcast has ``2 * per_class`` vectors of ``rank`` numbers and one
projection of ``TERMS * rank``: both are parameters and don't grow with the data.

Defined results: null and empty texts have the zero vector and get the share of
label 1 in the sample; repeated rows get equal scores; ties among neighbours
are broken by position in the sample; with no labelled rows the score is 0.5.
An id with both labels is not in the sample; of a repeated id the least text is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

THRESHOLD = 0.3
KINDS = 24
MARKS = b".,!?#*$%&|<>:;-\"'()[]{}"
EVENTS = 24
#: Buckets that lower-case words are hashed to, and the weight of their counts.
WORDS = 4096
WORD_WEIGHT = 0.3
TERMS = KINDS**3 + EVENTS + WORDS
STRETCH = 1 << 20


def _kinds() -> np.ndarray:
    kind = np.full(256, 6, np.uint16)  # control characters and other marks
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[9, 11, 12, 13, 32]] = 3
    kind[10] = 4
    kind[128:] = 5
    for k, group in enumerate((b".", b",", b"!?", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b":;", b"-", b"\"'", b"()[]{}", b"/@", b"_=+~^")):
        kind[list(group)] = 7 + k
    return kind


KIND = _kinds()


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and their counts in the whole text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0)
    total = np.zeros(KINDS**3, np.int64)
    for at in range(0, len(text), STRETCH):
        k = KIND[np.frombuffer(text[max(0, at - 2) : at + STRETCH], np.uint8)]
        total += np.bincount(k[:-2] * (KINDS * KINDS) + k[1:-1] * KINDS + k[2:], minlength=KINDS**3) if len(k) > 2 else 0
    words = text.split()
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    upper = sum(map(bytes.isupper, words))
    old = 1 - len(set(words)) / n
    events = np.zeros(EVENTS)
    events[0], events[1], events[2] = same, again, upper
    events[3 + min(5, int(6 * same / n))] = 5 * (same > 0)
    events[9 + min(3, int(4 * again / max(1, len(lines))))] = 5 * (again > 0)
    events[13 + min(5, int(6 * old))] = 2
    events[19 + min(4, len(words) // 25 if len(words) < 100 else 4)] = 1
    some = np.flatnonzero(total)
    own = np.flatnonzero(events)
    lower = text.lower().split()
    place, times = np.unique(np.fromiter(map(zlib.crc32, lower), np.int64, len(lower)) % WORDS, return_counts=True)
    return np.concatenate([some, KINDS**3 + own, KINDS**3 + EVENTS + place]), np.concatenate([total[some], events[own], times]).astype(float)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of each row; of equal ones at the edge the first."""
    edge = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
    above, level = cos > edge, cos == edge
    open_ = k - above.sum(1)
    more = np.flatnonzero(level.sum(1) > open_)  # rows where not all that are level fit
    level[more] &= np.cumsum(level[more], axis=1) <= open_[more, None]
    return np.nonzero(above | level)[1].reshape(len(cos), k)


@dataclass(frozen=True)
class Model:
    """Weighted projection of terms, unit labelled vectors, their labels."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float

    def project(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(bags), self.projection.shape[1]), np.float32)
        for i, (t, c) in enumerate(bags):
            if len(t):
                out[i] = np.log1p(c).astype(np.float32) @ self.projection[t]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def score(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Votes of the nearest neighbours, a block of texts at a time."""
        if not len(self.labels):
            return np.full(len(bags), 0.5)
        v = self.project(bags)
        cos = v @ self.vectors.T
        k = min(self.neighbours, cos.shape[1])
        near = nearest(cos, k)
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(float) ** self.power
        total = w.sum(1)
        votes = (w * self.labels[near]).sum(1)
        return np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.labels.mean())


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, label: str = "quality", per_class: int = 2500, rank: int = 48, neighbours: int = 15, power: float = 8.0) -> Model:
    """The latent space and labelled vectors of at most ``2 * per_class`` rows that satisfy ``train``."""
    common.prepare(docs.sparkSession)
    rows = common.labelled_texts(docs, labels, label, train, per_class)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [terms(t) for t in common.raw_texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([t.astype(np.int32).tobytes() for t, _ in own], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in own], pa.binary())], names=["label", "terms", "counts"])

    data = rows.mapInArrow(bags, "label int, terms binary, counts binary").collect()
    data.sort(key=lambda r: (r["label"], bytes(r["terms"]), bytes(r["counts"])))
    if not data:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    own = [(np.frombuffer(bytes(r["terms"]), np.int32), np.frombuffer(bytes(r["counts"]), np.float32).astype(float)) for r in data]
    found = np.bincount(np.concatenate([t for t, _ in own]), minlength=TERMS)
    used = np.flatnonzero(found)
    idf = np.zeros(TERMS, np.float32)
    idf[used] = 1 + np.log(len(own) / found[used])
    idf[KINDS**3 + EVENTS :] *= WORD_WEIGHT
    place = np.zeros(TERMS, np.int64)
    place[used] = np.arange(len(used))
    x = np.zeros((len(own), len(used)), np.float32)
    for i, (t, c) in enumerate(own):
        x[i, place[t]] = np.log1p(c) * idf[t]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(size > 0, size, 1)
    basis = latent(x, min(rank, *x.shape))
    projection = np.zeros((TERMS, basis.shape[1]), np.float32)
    projection[used] = basis * idf[used, None]
    model = Model(projection, np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    return Model(projection, model.project(own), np.array([r["label"] for r in data], float), neighbours, power)


def latent(x: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors by block power iteration from a fixed start."""
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((x.shape[0], rank + min(8, min(x.shape) - rank))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ np.linalg.qr(x @ q)[0])[0]
    small = np.linalg.svd(x @ q, full_matrices=False)[2]
    return q @ small.T[:, :rank]


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the weighted share of label 1 among each text's neighbours."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def values():
        return lambda b: [pa.array(shared.value.score([terms(t) for t in common.raw_texts(b)]), pa.float64())]

    return common.with_columns(docs, [(column, T.DoubleType())], values)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; columns as they were."""
    model = fit(docs, labels, common.fold("doc_id", 5) != 0)
    return score(docs, model, "__quality").filter(F.col("__quality") >= threshold).drop("__quality")


def op6_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"), common.fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
