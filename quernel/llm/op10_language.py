"""Language identification by multilingual mixture inference.

Each language has a distribution of byte n-grams (of words, with their ends),
counted over all labelled training documents.  A document is a mixture of
languages; expectation-maximisation estimates its proportions from the n-gram
likelihoods, for the most likely one, two, three languages and so on while a
further one pays its penalty in likelihood; that selects the set.  The
prediction is the largest part of that set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_out, map_arrow, parts, table

#: Hashed n-grams of three and four bytes.
BINS = 1 << 15
#: Languages that can be learned at most; more raise an error.
LANGUAGES = 200
STEPS, PSEUDO = 12, 0.5
#: Log likelihood that a further language must bring, per log of the n-grams.
PENALTY = 6.0
#: ASCII letters in lower case; bytes beyond ASCII stay; all else is a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a whole text's n-grams and their counts."""
    b = np.frombuffer(b" " + b" ".join(raw.lower().translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    four = (three[:-1] << 8 | b[3:]) ^ np.uint32(0x5BD1E995)
    h = np.concatenate([three, four]) * np.uint32(0x9E3779B1) >> np.uint32(17)
    n = np.bincount(h, minlength=BINS)
    bins = np.flatnonzero(n)
    return bins, n[bins].astype(float)


def lower(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def counts(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(lang, bin, n) over all training documents; each task sums its own before the shuffle."""
    rows = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(lang, text)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in parts(batches):
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bins, n = grams(lower(x))
                if name not in total:
                    total[name] = np.zeros(BINS)
                total[name][bins] += n
            if len(total) > 64:  # keep the task's memory small however many languages there are
                yield from sent(total)
                total = {}
        yield from sent(total)

    def sent(total):
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bin": pa.array(at, pa.int32()), "n": pa.array(n[at].astype(np.int64))})

    return map_arrow(rows, run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, names: list[str], n: np.ndarray):
        self.names = names
        p = n + PSEUDO * n.sum(1, keepdims=True) / max(BINS, 1) / 10 + 1e-3
        self.p = (p / p.sum(1, keepdims=True)).T.copy() if len(names) else np.zeros((BINS, 0))
        self.log = np.log(self.p)

    def __getstate__(self):
        """What is sent: half the digits, and no logarithms."""
        return self.names, self.p.astype(np.float32)

    def __setstate__(self, state):
        self.names, self.p = state[0], state[1].astype(float)
        self.log = np.log(self.p)

    def infer(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Prediction, its proportion, and all proportions, of each text."""
        k, n = len(self.names), len(texts)
        share = np.zeros((n, k))
        if not k:
            return ["und"] * n, np.zeros(n), share
        for i, x in enumerate(texts):
            if x and any(map(str.isalpha, x)):
                bins, c = grams(lower(x))
                if len(bins):
                    share[i] = select(self.p[bins], self.log[bins], c)
        best = share.argmax(1)
        score = share[np.arange(n), best]
        return [self.names[b] if s > 0 else "und" for b, s in zip(best, score, strict=True)], score, share


def em(p: np.ndarray, c: np.ndarray, total: float) -> np.ndarray:
    """The proportions that the columns of ``p`` mix in, for n-grams of these counts."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(STEPS):
        pi *= (c / (p @ pi)) @ p
        pi /= total
    return pi


def select(p: np.ndarray, log: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Proportions of a document under the best penalised set.

    ``p`` and ``log`` hold an n-gram's probability, and its logarithm, in each
    language, ``c`` its count.
    """
    total, k = c.sum(), p.shape[1]
    single = c @ log
    one = single.argmax()
    best, value = np.zeros(k), single[one]
    best[one] = 1.0
    order = np.argsort(-em(p, c, total), kind="stable")
    for m in range(2, k + 1):
        mine = np.ascontiguousarray(p[:, order[:m]])
        mix = em(mine, c, total)
        fit = c @ np.log(mine @ mix) - PENALTY * (m - 1) * np.log1p(total)
        if fit <= value:
            break
        best, value = np.zeros(k), fit
        best[order[:m]] = mix
    return best


def train(documents: DataFrame) -> Model:
    """Counts of all training documents.

    The driver takes one row a language, of at most BINS sums, and stops at the
    first beyond LANGUAGES, so it never holds more than it can learn from.
    """
    each = counts(documents).where(F.col("lang").isNotNull()).groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns"))
    found: dict[str, np.ndarray] = {}
    for r in each.limit(LANGUAGES + 1).toLocalIterator():
        found[r.lang] = np.bincount(r.bins, np.array(r.ns, float), BINS)
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages can't be learned")
    names = sorted(found)
    return Model(names, np.array([found[x] for x in names]).reshape(len(names), BINS))


def identify(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, ``lang_pred``, ``score`` and ``languages`` (lang, share of the selected set) of each row.

    A text that is null or has no letter is ``und`` with score 0 and no
    languages, as is every text if nothing was learned.  Of languages that are
    equally likely the one first by name is taken; whole texts are read, however
    long; other columns are not.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def make():
        model = sent.value

        def work(batch: pa.RecordBatch) -> dict:
            names, score, share = model.infer(batch.column(1).to_pylist())
            sets = [[{"lang": model.names[j], "share": float(row[j])} for j in np.flatnonzero(row > 0.005)] if x != "und" else [] for x, row in zip(names, share, strict=True)]
            return {key: batch.column(0), "lang_pred": names, "score": pa.array(np.clip(score, 0, 1)), "languages": pa.array(sets, kind)}

        return work

    return arrow_map(documents.select(key, text), make, f"{key} {dict(documents.dtypes)[key]}, lang_pred string, score double, languages array<struct<lang: string, share: double>>", rows=128)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(documents, train(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.expr("cast(size(languages) as long)").alias("n_languages"))
