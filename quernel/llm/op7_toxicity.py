"""Toxicity by multiple-instance learning.

A document is a bag of sentences: the distinct word sets of its lines and
sentences that have words.  Each has a probability p = sigmoid(b + sum of the
weights of its words and of their beginnings, which inflected forms share); the
document's is the noisy-or 1 - prod(1 - p).  The weights are fitted to document
labels alone, by gradient ascent on their likelihood through the noisy-or, so
the model learns by itself which sentences carry a label; those are returned.

A harmless sentence still has a small p, and many of them must not add up: once
the model is fitted, a sentence of p under ``FLOOR`` is no evidence and counts 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_out, table, training_rows

#: Labelled documents that the classifier is fitted on, and their characters in all, at most.
BOUND, BOUND_CHARS = 4_000, 40_000_000
#: Probability from which a sentence is evidence.
FLOOR = 0.02
#: Features that the model knows at most, in how many sampled documents one must
#: be, and by how many standard deviations it must favour the labelled ones.
VOCABULARY, LEAST, STRENGTH = 2_000, 5, 4.0
#: Lengths of the beginnings of words that count as features.
STARTS = (3, 4, 5, 6)
#: Word weights that a task keeps.
CACHE = 1 << 16
CUT = 0.3
SENTENCE = re.compile(r"[.!?]+\s|\n")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence that is not blank, over the whole text."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def bags(text: str, known: dict[str, str] | None = None) -> list[tuple[str, ...]]:
    """The distinct word sets of a text's sentences, those without words left out; ``known`` keeps one copy of each word."""
    known = {} if known is None else known
    found = dict.fromkeys(frozenset(WORD.findall(a)) for a in SENTENCE.split(text.lower()))
    return [tuple(sorted(known.setdefault(w, w) for w in s)) for s in found if s]


def terms(word: str) -> list[str]:
    """The features of a word: itself, and each longer beginning with a hyphen."""
    return [word, *(f"{word[:k]}-" for k in STARTS if len(word) > k)]


def fit(rows: list[tuple[list[tuple[str, ...]], int]], steps: int = 250, rate: float = 0.1, l2: float = 0.05) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias, from (distinct words of each sentence, label) pairs.

    Without labels of both kinds there is nothing to learn: no weights, and the
    bias of a sentence that is hardly ever toxic.
    """
    n, positive = len(rows), sum(y for _, y in rows)
    if not positive or positive == n:
        return {}, -9.0 if not positive else 3.0
    total, toxic = Counter(), Counter()
    for bag, y in rows:
        seen = {t for w in set().union(*bag) for t in terms(w)}
        total.update(seen)
        if y:
            toxic.update(seen)
    share = positive / n
    strength = {w: (k - total[w] * share) / np.sqrt(total[w] * share * (1 - share)) for w, k in toxic.items() if total[w] >= LEAST}
    known = sorted((w for w, z in strength.items() if z >= STRENGTH), key=lambda w: (-strength[w], w))[:VOCABULARY]
    code = {w: i for i, w in enumerate(known)}
    doc, sent, word = [], [], []
    cache: dict[str, list[int]] = {}
    s = 0
    for d, (bag, _) in enumerate(rows):
        for b in bag:
            codes = set()
            for w in b:
                if (c := cache.get(w)) is None:
                    c = cache[w] = [code[t] for t in terms(w) if t in code]
                codes.update(c)
            sent += [s] * len(codes)
            word += codes
            doc.append(d)
            s += 1
    if not doc:
        return {}, -9.0
    doc, sent, word = np.array(doc), np.array(sent, int), np.array(word, int)
    y = np.array([y for _, y in rows], float)
    w, b = np.zeros(len(known)), -np.log(len(doc) / n / share)
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(sent, w[word], len(doc))
        q = np.bincount(doc, np.logaddexp(0, z), n)
        up = np.where(y > 0, np.exp(-q) / np.maximum(-np.expm1(-q), 1e-9), -1.0)
        gz = up[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, gz[sent], len(known)) - l2 * w, gz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    return {k: float(w[c]) for k, c in code.items() if abs(w[c]) > 0.02}, float(b)


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.cache = weights, bias, {}

    def log_odds(self, words) -> float:
        """Of a sentence of these distinct lower-case words."""
        seen: set[str] = set()
        cache = self.cache
        for w in words:
            if (found := cache.get(w)) is None:
                if len(cache) >= CACHE:
                    cache.clear()
                found = cache[w] = tuple(t for t in terms(w) if t in self.weights)
            if found:
                seen.update(found)
        return self.bias + sum(map(self.weights.__getitem__, sorted(seen)))

    def score(self, text: str | None) -> float:
        """The noisy-or of the distinct sentences that are evidence; a text without any scores 0."""
        clean = 1.0
        for s in dict.fromkeys(frozenset(WORD.findall(a)) for a in SENTENCE.split((text or "").lower())):
            if s and (p := chance(self.log_odds(s))) >= FLOOR:
                clean *= 1 - p
        return 1 - clean

    def offending(self, text: str | None, least: float) -> list[dict]:
        out = []
        for a, b in sentences(text or ""):
            words = set(WORD.findall(text[a:b].lower()))
            if words and (p := chance(self.log_odds(words))) >= least:
                out.append({"start": a, "end": b, "p": p})
        return out


def chance(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def train(documents: DataFrame, labels: DataFrame, bound: int = BOUND, chars: int = BOUND_CHARS) -> Model:
    """Fit on the labelled sample; null texts are empty bags.

    The sample is taken in an order by hash; a text that would bring it beyond
    ``chars`` is left out, and those after it are still learned from.
    """
    size, known, rows = 0, {}, []
    some = training_rows(documents, labels, "toxic", bound).where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if size + len(r.text or "") <= chars:
            size += len(r.text or "")
            rows.append((bags(r.text or "", known), int(r.y > 0)))
    return Model(*fit(rows))


def score(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least: float = CUT) -> DataFrame:
    """The key, ``score`` and ``sentences`` (start, end and p of those at ``least``) of each row.

    Null and empty texts, and texts without words, score 0; equal rows score
    equally; a text's score depends on its distinct sentences, not on how often
    they come or how long it is; no other column is read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def make():
        model = sent.value

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            found = [model.score(x) for x in texts]
            where = [model.offending(x, least) if p >= least else [] for x, p in zip(texts, found, strict=True)]
            return {key: batch.column(0), "score": pa.array(found, pa.float64()), "sentences": pa.array(where, kind)}

        return work

    return arrow_map(documents.select(key, text), make, f"{key} {dict(documents.dtypes)[key]}, score double, sentences array<struct<start: long, end: long, p: double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    found = score(documents, train(documents, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), F.expr("cast(size(sentences) as long)").alias("n_offending"))
