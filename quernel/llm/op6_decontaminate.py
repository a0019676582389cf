"""Benchmark decontamination by a generalised suffix automaton.

The automaton of the normalised benchmark items is walked by the words of each
document, which keeps the length of the longest suffix read that occurs in some
item.  Where that length reaches ``window`` words, a window of an item ends; an
item shorter than a window counts as one window.  The words inside any window
are hit.

The automaton is built from a bounded block of items.  A benchmark of more words
than ``BLOCK`` is dealt into several blocks by hash and walked in as many passes,
one after the other: each pass is a table in the shared folder before the next
block is read.  So neither the driver nor an executor ever holds more than one
block, and no row is shuffled.  A single item of more words is a block of its own.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import Workspace, free, map_arrow, table, utf8

WINDOW = 13
#: A document is contaminated if 1 in this many words, at least, is hit.
SHARE = 20
#: Words of benchmark items in one automaton, as expected; it takes up to about 600 bytes of memory a word.
BLOCK = 200_000
#: Lower-cases A-Z and turns all other ASCII but digits and letters into spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: What a scan adds to a row, unless its table has such names: its words, the hit word ranges, the items.
FOUND, KINDS = ("__n", "__spans", "__items"), (LongType(), ArrayType(ArrayType(LongType())), ArrayType(StringType()))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton of items, each a list of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.code = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        paths = []
        for name, ws in items:
            ids = [self.code.setdefault(w, len(self.code)) for w in ws]
            last = 0
            for c in ids:
                last = self.extend(last, c)
            paths.append((name, ids))
        n = len(self.len)
        order = sorted(range(n), key=self.len.__getitem__)
        self.cut = [-1] * n  # the ancestor that holds the suffix of one window
        whole: list[tuple] = [()] * n  # items shorter than a window that end here
        self.items: list[set[str]] = [set() for _ in range(n)]
        for name, ids in paths:
            v = 0
            for c in ids:
                v = self.next[v][c]
                u = v
                while u > 0 and name not in self.items[u]:
                    self.items[u].add(name)
                    u = self.link[u]
            if 0 < len(ids) < window:
                while self.len[self.link[v]] >= len(ids):
                    v = self.link[v]
                whole[v] += ((len(ids), name),)
        self.whole, self.need = whole, [window] * n
        for v in order[1:]:
            u = self.link[v]
            self.cut[v] = v if self.len[u] < window <= self.len[v] else self.cut[u]
            self.whole[v] = self.whole[v] + self.whole[u]
            self.need[v] = min([window, *(k for k, _ in self.whole[v])])
        self.need[0] = window
        self.least = min([window, *(len(ids) for _, ids in paths if ids)])

    def extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self.split(last, q, c)
        new = self.state(length[last] + 1, {}, -1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, q, c)
        return new

    def split(self, p: int, q: int, c: int) -> int:
        clone = self.state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges, merged, and the items with windows in ``ws``."""
        n = len(ws)
        if n < self.least or not self.code:
            return [], set()
        codes = np.fromiter(map(self.code.get, ws, repeat(-1)), np.int32, n)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], codes >= 0, [0]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        nxt, link, length, need = self.next, self.link, self.len, self.need
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.least:  # a match never holds a word outside the benchmark
                continue
            v = size = 0
            for i, c in enumerate(codes[a:b].tolist(), a + 1):
                while c not in nxt[v]:
                    v = link[v]
                    size = length[v]
                v = nxt[v][c]
                size += 1
                if size >= need[v]:
                    if size >= self.window:
                        spans.append((i - self.window, i))
                        found |= self.items[self.cut[v]]
                    for k, name in self.whole[v]:
                        if size >= k:
                            spans.append((i - k, i))
                            found.add(name)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, block: int) -> list[DataFrame]:
    """(i, t) of the items that have words, in blocks of about ``block`` words."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")).where("i is not null and t is not null")
    # the words of ASCII texts, and about those of others, without bringing a text to the driver
    size = F.size(F.expr("regexp_extract_all(cast(t as string), '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+', 0)"))
    n = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    k = max(1, -(-n // block))
    return [rows.where(F.expr(f"pmod(xxhash64(i, t), {k}) = {b}")) if k > 1 else rows for b in range(k)]


#: The automaton that a Python worker built last, by the name of its block.
_built: dict[str, Automaton] = {}


def automaton(name: str, items: list[tuple[str, bytes]], window: int) -> Automaton:
    if name not in _built:
        _built.clear()
        _built[name] = Automaton([(i, words(t)) for i, t in items], window)
    return _built[name]


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", block: int = BLOCK, out: tuple[str, ...] = ()) -> DataFrame:
    """The rows with their words, hit word ranges and item ids added, as ``out`` (``__n``, ``__spans`` and ``__items``, if the table has no such names).

    Null texts have no words.  Items that are null, or have no words, are in no
    document.  Rows with equal keys are each scanned, whole, however long.
    """
    df, at = documents, documents.columns.index(text)
    count, ranges, names = out = out or tuple(free(documents, *FOUND))
    pair = pa.list_(pa.list_(pa.int64()))
    schema = StructType([*documents.schema.fields])
    for n, kind in zip(out, KINDS, strict=True):
        schema = schema.add(n, kind)
    work, all_ = Workspace(df.sparkSession), blocks(benchmark, item, text, block)
    for k, some in enumerate(all_):
        items = sorted((r.i, bytes(r.t)) for r in some.collect())
        sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches, sent=sent, k=k):
            for batch in batches:
                a = automaton(*sent.value, window)
                size, spans, found = [], [], []
                for x in utf8(batch.column(at)):
                    ws = words(x)
                    s, f = a.scan(ws)
                    size.append(len(ws))
                    spans.append(s)
                    found.append(f)
                if k:
                    old, seen = batch.column(ranges).to_pylist(), batch.column(names).to_pylist()
                    spans = [merged([*a, *map(tuple, b)]) for a, b in zip(spans, old, strict=True)]
                    found = [a | set(b) for a, b in zip(found, seen, strict=True)]
                own = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in out]
                own += [(count, pa.array(size, pa.int64())), (ranges, pa.array([[list(s) for s in x] for x in spans], pair)), (names, pa.array([sorted(x) for x in found], pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([c for _, c in own], [n for n, _ in own])

        new = map_arrow(df, run, schema)
        if k + 1 < len(all_):
            new = work.save(new, "pass")
            sent.unpersist()
            work.drop(df)
        df = new
    return df


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, text: str = "text") -> DataFrame:
    """The rows without benchmark passages, in their own columns.

    A hit span goes if it is as long as a window, and every hit span goes if hits
    make up 1 in ``share`` words.  A row that keeps no word goes; rows without a
    removed span stay as they are, empty and null texts too.
    """
    names, added = documents.columns, tuple(free(documents, *FOUND))
    df = hits(documents, benchmark, window, text, out=added)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            rows, keep = [], []
            for x, n, spans in zip(batch.column(at).to_pylist(), batch.column(added[0]).to_pylist(), batch.column(added[1]).to_pylist(), strict=True):
                hit = sum(b - a for a, b in spans)
                gone = [(a, b) for a, b in spans if b - a >= window or share * hit >= n]
                if gone:
                    raw = x.encode()
                    where = [m.span() for m in WORD.finditer(raw)]
                    out, last = [], 0
                    for a, b in gone:
                        out.append(raw[last : where[a][0]])
                        last = where[b - 1][1]
                    raw = b"".join([*out, raw[last:]])
                    x = raw.decode()
                    keep.append(bool(words(raw)))
                else:
                    keep.append(True)
                rows.append(x)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return map_arrow(df, run, documents.schema)


#: The query's rows by joins of windows, without an automaton.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 13) AS k FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM s)),
g AS (SELECT r, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w))),
h AS (SELECT r, g.k, i, item_id FROM g JOIN w ON g.k = w.k AND g.g = w.g),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.x, '')) AS items_sha256,
       coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    found = hits(documents, table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", F.col("__n").alias("n_words"), F.expr("aggregate(__spans, 0L, (s, x) -> s + x[1] - x[0])").alias("n_hit"), F.expr("cast(size(__items) as long)").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
