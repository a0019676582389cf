"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is the counts of its byte pairs and of pseudo-terms for repetition, word
lengths and letter classes, weighted by log term and inverse document frequency.
A truncated singular value decomposition of a labelled sample gives the latent
space, by subspace iteration.  The labelled vectors are broadcast (their number and width are bounded);
each document's cosines with all of them are exact, computed a block of
documents at a time, and the nearest neighbours vote by similarity.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_out, map_arrow, table, training_rows, utf8

#: Labelled documents that the neighbours are taken from, at most.
BOUND = 4_000
PAIRS, LATENT, NEIGHBOURS, POWER = 2_048, 48, 25, 4.0
CUT = 0.7
#: Classes of bytes: lower, upper, digit, space, line end, sentence end, other ASCII, beyond ASCII.
KIND = np.array([4 if c == 10 else 3 if c in (9, 11, 12, 13, 32) else 2 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 0 if 97 <= c <= 122 else 5 if c in b".!?" else 7 if c >= 128 else 6 for c in range(256)], np.uint8)
FOLD = (np.arange(65_536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)).astype(np.int64)
SPACE = re.compile(rb"\s+")
#: Shares that become pseudo-terms, each with weight; one column a tenth, spread over neighbours.
SHARES, TENTHS = 11, 11
WIDTH = PAIRS + SHARES * TENTHS


def features(raw: bytes) -> np.ndarray:
    """The log counts of a whole text's terms, and what its shares say, as one vector."""
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    if len(b) > 1:
        pair = b[:-1].astype(np.int64) * 256 + b[1:]
        out[:PAIRS] = np.log1p(np.bincount(FOLD[pair], minlength=PAIRS))
    words = raw.split()
    n = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = np.bincount(KIND[b], minlength=8) / len(b)
    twice = sum(x == y for x, y in zip(words, words[1:], strict=False)) / n
    shares = [
        *kinds[[1, 2, 5, 6, 7]],
        len(set(words)) / n,
        twice,
        len(zlib.compress(raw, 1)) / len(raw),
        min(sum(map(len, words)) / n / 20, 1),
        len(set(lines)) / max(len(lines), 1),
        min(np.log1p(n) / 12, 1),
    ]
    for k, x in enumerate(shares):
        x = min(max(x, 0), 1) * (TENTHS - 1)
        i = min(int(x), TENTHS - 2)
        at = PAIRS + k * TENTHS + i
        out[at], out[at + 1] = 1 - (x - i), x - i
    return out


class Model:
    """The latent space, and the labelled vectors in it.

    ``counts``: the sample's features in half precision, a row each; they are
    weighed a block of rows at a time, so the driver never holds them in full
    precision.
    """

    def __init__(self, counts: np.ndarray, y: np.ndarray, block: int = 256):
        self.y = y.astype(np.float32)
        self.base = float(y.mean()) if len(y) else 0.5
        if not len(y):
            return
        starts = range(0, len(y), block)
        held = sum((counts[a : a + block] > 0).sum(0) for a in starts)
        self.idf = np.log((1 + len(y)) / (1 + held)).astype(np.float32) + 1
        square = np.zeros((WIDTH, WIDTH), np.float32)  # whatever the sample's size
        for a in starts:
            x = self.weigh(counts[a : a + block].astype(np.float32))
            square += x.T @ x
        self.axes = leading(square, LATENT)
        self.vectors = unit(np.concatenate([self.weigh(counts[a : a + block].astype(np.float32)) @ self.axes for a in starts]))

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = counts.copy()
        x[:, :PAIRS] *= self.idf[:PAIRS]
        x[:, :PAIRS] /= np.maximum(np.linalg.norm(x[:, :PAIRS], axis=1, keepdims=True), 1e-9)
        x[:, PAIRS:] *= 0.7
        return x

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The votes, from 0 to 1, of a block of documents."""
        if not len(self.y):
            return np.full(len(counts), self.base)
        near = unit(self.weigh(counts) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.y))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** POWER
        return (weight * self.y[best]).sum(1) / weight.sum(1)


def leading(square: np.ndarray, k: int, rounds: int = 40) -> np.ndarray:
    """The ``k`` leading eigenvectors of a symmetric matrix without negative eigenvalues, by subspace iteration."""
    q = np.random.default_rng(5).standard_normal((len(square), 2 * k)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(square @ q)
    w, u = np.linalg.eigh(q.T @ (square @ q))
    return np.ascontiguousarray(q @ u[:, np.argsort(-w)[:k]], np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def train(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """Fit on the labelled sample.  Features are computed where the texts are; only they come to the driver."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            x = [features(t).astype("<f2").tobytes() for t in utf8(batch.column(0))]
            return {"x": pa.array(x, pa.binary()), "y": batch.column(1)}

        return work

    rows = arrow_map(training_rows(documents, labels, "quality", bound).select("text", "y"), make, "x binary, y int").toArrow()
    rows = sorted(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), strict=True))
    counts = np.frombuffer(b"".join(x for x, _ in rows), "<f2").reshape(len(rows), WIDTH)
    return Model(counts, np.array([float(y > 0) for _, y in rows]))


def scorer(sent, column: int):
    """The function from a batch to the scores of its texts; an empty text scores 0."""

    def make():
        model = sent.value

        def work(batch: pa.RecordBatch) -> np.ndarray:
            raw = utf8(batch.column(column))
            found = model.score(np.array([features(t) for t in raw]).reshape(len(raw), WIDTH))
            return np.where([not t.strip() for t in raw], 0.0, np.clip(found, 0, 1)).astype(float)

        return work

    return make


def score(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and ``score`` of each row.

    Null, empty and blank texts score 0; equal rows score equally, and of labelled
    vectors that are equally near the same ones vote in each run; whole texts are
    read, however long; no other column is.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        votes = scorer(sent, 1)()
        return lambda batch: {key: batch.column(0), "score": pa.array(votes(batch), pa.float64())}

    return arrow_map(documents.select(key, text), make, f"{key} {dict(documents.dtypes)[key]}, score double", rows=256)


def keep(documents: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows whose text scores at least ``least``, in their own columns; all, if nothing was learned."""
    if not len(model.y):
        return documents
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)

    def run(batches):
        votes = None
        for batch in batches:
            votes = votes or scorer(sent, at)()
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(votes(part) >= least))

    return map_arrow(documents, run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    found = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"))
