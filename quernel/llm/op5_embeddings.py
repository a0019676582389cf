"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into two halves, each with a codebook of its own; the pairs
of codes are the cells of a product grid.  For a query, the multi-sequence
traversal visits cells in order of the sum of both code distances.  A link is
found if either of its ends visits the other's cell; how many cells that takes
for the target recall is measured on the sample that the codebooks are fitted
on, with its own links and with made pairs just at the limit.  Vectors found in
visited cells are verified by their cosine in double precision.

Every vector is indexed, among those of its own width, and every vector is a
query.  Cells with many vectors are verified in blocks; a task returns sums and a
spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, dealt, keys_join, map_arrow, parts, table
from .graph import components

LEAST = 0.9
#: Vectors that a width's codebooks are fitted on, and their bytes, at most; all are indexed.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
#: Widths with codebooks; the vectors of any other width are one cell, in blocks.
BOOKS = 8
#: Vectors that a cell should hold, and codes of a half at least and at most.
CELL, CODES_LEAST, CODES_MOST = 800, 2, 2048
#: Recall to reach on links of the sample, and on pairs made to lie at the limit.
RECALL, RECALL_AT_LIMIT = 0.999, 0.93
#: Query rows of the sample whose links are tried, and links of each, all drawn at random.
TRIED, LINKS = 4_000, 20
#: Vectors of a cell that are verified at once, at most; blocks of larger cells have a sixteenth, at least and at most.
ONCE, BLOCK, BLOCK_MOST = 8192, 1024, 4096
#: Bytes of vectors that are verified at once.
ONCE_BYTES = 64 << 20


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from the first rows, which are in random order; an empty code keeps its place."""
    k = min(k, len(x))
    c = x[:k].copy()
    for _ in range(rounds):
        n, s = np.zeros(k), np.zeros_like(c)
        for at in range(0, len(x), 2048):
            y = x[at : at + 2048]
            near = distances(y, c).argmin(1)
            n += np.bincount(near, minlength=k)
            np.add.at(s, near, y)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1)[None, :] - 2 * x @ c.T + (x * x).sum(1)[:, None]


class Index:
    """Two codebooks and the number of cells to visit, from unit vectors in random order."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        self.a, self.b = kmeans(sample[:, : self.half], codes), kmeans(sample[:, self.half :], codes)
        self.visit = self.needed(sample)
        self.places = np.nonzero(np.outer(np.arange(1, len(self.a) + 1), np.arange(1, len(self.b) + 1)) <= self.visit)

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.a), distances(x[:, self.half :], self.b)

    def order(self, x: np.ndarray, visit: int) -> np.ndarray:
        """The first ``visit`` cells of each row's multi-sequence traversal.

        When cell (i, j) of the sorted codes is visited, the (i + 1)(j + 1) cells
        that are at most as far have been; so only pairs with that product up to
        ``visit`` can be among the first.
        """
        da, db = self.apart(x)
        ia, ib = np.argsort(da, 1, kind="stable"), np.argsort(db, 1, kind="stable")
        da, db = np.take_along_axis(da, ia, 1), np.take_along_axis(db, ib, 1)
        i, j = self.places if visit == getattr(self, "visit", 0) else np.nonzero(np.outer(np.arange(1, len(self.a) + 1), np.arange(1, len(self.b) + 1)) <= visit)
        near = np.argsort(da[:, i] + db[:, j], axis=1, kind="stable")[:, :visit]
        return ia[np.arange(len(x))[:, None], i[near]] * len(self.b) + ib[np.arange(len(x))[:, None], j[near]]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        da, db = self.apart(x)
        return da.argmin(1) * len(self.b) + db.argmin(1)

    def needed(self, sample: np.ndarray) -> int:
        """Cells to visit for the target recall, as measured on the sample."""
        rng = np.random.default_rng(7)
        some = sample[:TRIED]
        noise = rng.standard_normal(some.shape)
        noise -= (noise * some).sum(1, keepdims=True) * some
        made = LEAST * some + np.sqrt(1 - LEAST**2) * unit(noise)
        rank = [np.quantile(self.ranks(some, made), RECALL_AT_LIMIT)]
        heads, tails = [], []
        for at in range(0, len(some), 256):
            link = some[at : at + 256] @ sample.T >= LEAST
            for k, row in enumerate(link, at):
                others = np.flatnonzero(row)
                others = others[others != k]
                others = rng.choice(others, LINKS, replace=False) if len(others) > LINKS else others
                heads += [k] * len(others)
                tails += others.tolist()
        if heads:
            rank.append(np.quantile(self.ranks(sample[heads], sample[tails]), RECALL))
        return int(min(len(self.a) * len(self.b), max(1, np.ceil(max(rank)))))

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place, from 1, at which one of each pair visits the other's cell."""
        return np.minimum(self.place(x, self.home(y)), self.place(y, self.home(x)))

    def place(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The place, from 1, of a cell in each row's traversal."""
        out = np.empty(len(x), np.int64)
        for at in range(0, len(x), 1024):
            da, db = self.apart(x[at : at + 1024])
            db_sorted = np.sort(db, 1)
            for k, c in enumerate(cell[at : at + 1024].tolist()):
                far = da[k, c // len(self.b)] + db[k, c % len(self.b)]
                out[at + k] = np.searchsorted(db_sorted[k], far - da[k]).sum() + 1
        return np.maximum(out, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever finite size they have."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 5e-324)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def to_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit(nodes: DataFrame, most: int = BOOKS) -> dict[int, Index]:
    """By width, the index of the commonest widths, each from a sample drawn by hash; few vectors need none."""
    found = {}
    for w, total in nodes.groupBy("w").agg(F.count("*").alias("n")).where(f"n > {2 * CELL} and w > 1").orderBy(F.desc("n"), "w").limit(most).collect():
        bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * w)))
        share = min(1.0, 1.2 * bound / total)
        some = nodes.where(f"w = {w} and pmod(xxhash64(node, 5), 1000000) < {share * 1_000_000}").orderBy(F.xxhash64("node", F.lit(11))).limit(bound)
        v = np.array([r.v for r in some.select("v").collect()], np.float64)
        codes = 1 << int(np.clip(np.round(np.log2(np.sqrt(total / CELL))), np.log2(CODES_LEAST), np.log2(CODES_MOST)))
        found[w] = Index(unit(v[np.random.default_rng(3).permutation(len(v))]), codes)
    return found


def visits(batch: pa.RecordBatch, books: dict[int, Index]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cells that they visit, their own first) of a batch, by width.  A width without an index is one cell."""
    widths = batch.column("w").to_numpy()
    for w in np.unique(widths).tolist():
        for rows in np.array_split(at := np.flatnonzero(widths == w), -(-len(at) // 512)):
            if w not in books:
                yield rows, np.full((len(rows), 1), -w, np.int64)
                continue
            x = unit(to_matrix(batch.column("v").take(pa.array(rows))))
            yield rows, books[w].order(x, books[w].visit).astype(np.int64) + (w << 32)


def verified(nodes: DataFrame, books: dict[int, Index], least: float, work: Workspace) -> DataFrame:
    """(node, n, root): links of a node that a task found, and its root in the task's forest."""
    sent = nodes.sparkSession.sparkContext.broadcast(books)

    def count(batches):
        for batch in batches:
            for _, cells in visits(batch, sent.value):
                c, at = np.unique(cells, return_inverse=True)
                own = np.bincount(at.reshape(cells.shape)[:, 0], minlength=len(c))
                yield pa.RecordBatch.from_pydict({"cell": c, "ni": own, "nq": np.bincount(at.ravel(), minlength=len(c)) - own})

    def spread(batches):
        kind = None
        for batch in batches:
            kind = kind or batch.schema.field("v").type
            for rows, cells in visits(batch, sent.value):
                k = cells.shape[1]
                # a held row has the cells that it visits; a row that asks elsewhere has its own
                lists = np.concatenate([np.arange(len(rows) + 1) * k, len(rows) * k + np.arange(1, len(rows) * (k - 1) + 1)])
                flat = np.concatenate([cells.ravel(), np.repeat(cells[:, 0], k - 1)])
                at = pa.array(np.concatenate([rows, np.repeat(rows, k - 1)]))
                part = batch.take(at)
                role = np.repeat([0, 1], [len(rows), len(rows) * (k - 1)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"cell": np.concatenate([cells[:, 0], cells[:, 1:].ravel()]), "role": role, "node": part.column("node"), "copies": part.column("copies"), "v": part.column("v"), "cells": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(flat))})

    size = map_arrow(nodes, count, "cell long, ni long, nq long").groupBy("cell").agg(F.sum("ni").alias("ni"), F.sum("nq").alias("nq")).where("ni > 0")
    most = f"greatest({BLOCK}, least({ONCE}, {ONCE_BYTES // 8} div greatest(1, if(cell < 0, -cell, cell >> 32))))"
    blocks = f"cast(ceil({{0}} / greatest({BLOCK}, least({BLOCK_MOST}, most, {{0}} / 16))) as int)"
    size = size.withColumn("most", F.expr(most)).withColumn("small", F.expr("ni + nq <= most"))
    # the blocks of held rows, and of rows that ask; 0: they come to the held rows' only block
    size = size.select("cell", F.expr(f"if(small, 1, {blocks.format('ni')})").alias("mi"), F.expr(f"if(small or nq = 0, 0, {blocks.format('nq')})").alias("mq"), "ni", "nq")
    size = work.save(size, "sizes")
    total = size.agg(F.expr("coalesce(sum(ni * (mi + mq) + nq * if(mq = 0, 1, mi)), 0)")).first()[0]
    rows = map_arrow(nodes, spread, f"cell long, role int, node long, copies long, v {dict(nodes.dtypes)['v']}, cells array<long>")
    rows = keys_join(rows, size.select("cell", "mi", "mq"), "cell")
    rows = rows.withColumn("p", F.expr("cast(if(role = 0, pmod(xxhash64(node, cell), mi), if(mq = 0, 0, mi + pmod(xxhash64(node, cell), mq))) as int)"))
    rows = rows.withColumn("q", F.explode(F.expr("if(role = 0, sequence(0, mi + mq - 1), if(mq = 0, array(0), sequence(0, mi - 1)))")))
    rows = rows.select("cell", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "role", "node", "copies", "v", "cells")

    def pairs(g: pa.Table) -> dict | None:
        i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
        p, role = g.column("p").to_numpy(), g.column("role").to_numpy()
        x = np.flatnonzero((p == i) & (role == 0))
        y = np.arange(len(p)) if i == j else np.flatnonzero(p == j)
        if not len(x) or not len(y):
            return None
        node, copies = g.column("node").to_numpy(), g.column("copies").to_numpy()
        v = unit(to_matrix(g.column("v").combine_chunks()))
        single, eps = v.astype(np.float32), 1e-6 + 1e-7 * v.shape[1]
        lists = g.column("cells").combine_chunks()
        flat, start = lists.values.to_numpy(), lists.offsets.to_numpy()
        visited = flat[start[x][:, None] + np.arange(start[x[0] + 1] - start[x[0]])]
        asks = role[y] == 1
        homes, code = np.unique(flat[start[y]], return_inverse=True)
        n, links = np.zeros(len(node), np.int64), np.zeros((len(x), len(y)), bool)
        for at in range(0, len(x), 1024):
            a = x[at : at + 1024]
            near = single[a] @ single[y].T
            link = near >= least
            s, t = np.nonzero(np.abs(near - least) <= eps)
            for k in range(0, len(s), 65536):  # too near to tell: in double precision
                b, c = s[k : k + 65536], t[k : k + 65536]
                link[b, c] = np.einsum("ij,ij->i", v[a[b]], v[y[c]]) >= least
            if i == j:  # each pair once
                link &= asks | (a[:, None] < y)
            links[at : at + 1024] = link
            n[a] += link @ copies[y]
            seen = np.stack([(visited[at : at + 1024] == h).any(1) for h in homes], 1)
            # a link that the held row finds in the other's cell counts there for the other
            n[y] += copies[a] @ (link & ~(seen[:, code] & asks))
        if not links.any():
            return None
        root, places = node.copy(), np.unique(node, return_inverse=True)[1]
        while True:
            new, big = root.copy(), np.iinfo(np.int64).max
            for at in range(0, len(x), 1024):
                a, link = x[at : at + 1024], links[at : at + 1024]
                new[a] = np.minimum(new[a], np.where(link, root[y], big).min(1))
                new[y] = np.minimum(new[y], np.where(link, root[a][:, None], big).min(0))
            low = np.full(places.max() + 1, big)
            np.minimum.at(low, places, new)
            new = low[places]
            if (new == root).all():
                break
            root = new
        keep = np.unique(np.concatenate([x[links.any(1)], y[links.any(0)]]))
        return {"node": node[keep], "n": n[keep], "root": root[keep]}

    def run(batches):
        rest = None
        for batch in batches:
            for part in parts([batch], 4096):
                t = pa.Table.from_batches([part])
                t = pa.concat_tables([rest, t]) if rest is not None else t
                k = np.stack([t.column(c).to_numpy() for c in ("cell", "i", "j")])
                cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()]
                for a, b in zip(cut, cut[1:], strict=False):
                    if out := pairs(t.slice(a, b - a)):
                        yield pa.RecordBatch.from_pydict(out)
                rest = t.slice(cut[-1])
        if rest is not None and (out := pairs(rest)):
            yield pa.RecordBatch.from_pydict(out)

    found = work.save(map_arrow(dealt(rows, total, ["cell", "i", "j"], 20_000), run, "node long, n long, root long"), "found")
    work.drop(size)
    return found


def link_components(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", least: float = LEAST) -> DataFrame:
    """One row for each row: the key, ``n_links``, ``component_id`` and ``kept``.

    Vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing and are their own component.  All others are compared with
    those of their own width, whatever their size.  Equal vectors are one node:
    each row links with all others.  Rows that share a key, or have none, are
    vectors of their own; a null key names a component only if there is no other.
    An empty table gives no rows; other columns are not read.
    """
    work = Workspace(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    good = F.expr("x is not null and size(x) > 0 and not exists(x, y -> y is null or isnan(y) or abs(y) = double('infinity')) and exists(x, y -> y <> 0)")
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast(kind).alias("x")).select("key", F.when(good, F.col("x")).alias("v"))
    one = F.when(F.size("v") == 1, F.transform("v", lambda x: F.signum(x).cast(kind[6:-1]))).otherwise(F.col("v"))  # of one component, only the sign counts
    rows = work.save(rows.withColumn("v", one).select(F.monotonically_increasing_id().alias("id"), "key", "v", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b"))).alias("h")), "vectors")
    several = work.save(rows.where("v is not null").groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.min("key").alias("low")).where("copies > 1"), "several")
    nodes = keys_join(rows.where("v is not null"), several.select("h", "node", "copies"), "h", "left").where("node is null or node = id")
    nodes = nodes.select(F.col("id").alias("node"), F.coalesce("copies", F.lit(1)).alias("copies"), "v", F.size("v").alias("w"))
    books = fit(nodes)
    found = verified(nodes, books, least, work)
    label = components(found.select("node", "root"), work)
    linked = found.groupBy("node").agg(F.sum("n").alias("n")).join(label, "node")
    named = keys_join(rows.select(F.col("id").alias("node"), "key"), linked.select("node"), "node", "left_semi")
    linked = linked.join(named, "node").join(several.select("node", "copies", "low"), "node", "left")
    known = linked.select("node", "label", (F.col("n") + F.coalesce("copies", F.lit(1)) - 1).alias("n"), F.least("key", "low").alias("low"))
    alone = several.join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"), (F.col("copies") - 1).alias("n"), "low")
    known = work.save(known.union(alone), "known")
    least_ = known.groupBy("label").agg(F.min("low").alias("component"))
    known = work.save(known.join(least_, "label").select("node", "n", "component"), "known")
    work.keep(rows, several, known)
    out = keys_join(rows.select("id", "key", "h"), several.select("h", "node"), "h", "left").select("key", F.coalesce("node", "id").alias("node"))
    out = keys_join(out, known, "node", "left")
    out = out.select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id")))


#: The query's rows from all pairs, without an index.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.9),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT a, min(b) AS low FROM t GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, c.low) AS component_id, vec_id = least(vec_id, c.low) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "embeddings"))
