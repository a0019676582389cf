"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets are one node.  Of each node's ``HASHES``
minima, the first give band keys; the low ``BITS`` bits of all are packed in a
signature of a few longs.  Nodes that share a band key are candidates.  With C
equal lanes of k, a share 2**-b of which are chance collisions, the similarity
is (C / k - 2**-b) / (1 - 2**-b); C is counted by bit operations.  Candidates
whose estimate is within ``margin`` of the limit are confirmed on full sets.

No step emits all pairs of a bucket.  First each member is held against the
bucket's least member.  Pairs are then only of interest across the components
that this leaves: each row's nearest rows in other components follow.  Last, the
rows that still have candidates across components are brought together with
their full sets, block by block, and confirmed there, so no link is lost.

A group of near copies shares most of its buckets.  A row's largest bucket is its
home; rows of one home meet there and nowhere else, so each other bucket sends
only what its rows of different homes need.  A bucket's blocks are bounded in
number, not in size: a row is sent about ``BLOCKS`` times at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, dealt, free, keys_join, map_arrow, parts, table, utf8
from .graph import components

SHINGLE, PER, OF = 5, 85, 100
#: Bands of 4 minima; how often they may miss a pair at the limit, as far as there are minima.
ROWS, HASHES, BITS, MISS = 4, 256, 2, 1e-5
#: Standard deviations of the estimate at the limit, and the least margin.
DEVIATIONS, MARGIN = 4.5, 0.12
#: A bucket has about so many blocks at most, fewer if they would have less than so many nodes; rows that a task compares.
BLOCKS, BLOCK = 16, 128
TASK_ROWS = 4096
#: Pairs of rows that are looked at at once.
AT_ONCE = 1 << 21
#: Neighbours of a row in other components that are tried before all.
NEAREST = 3
TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fixed odd multipliers and offsets of the hash functions.
_seed = np.random.default_rng(20_240_229)
MULTIPLY = _seed.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _seed.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
LANES = 64 // BITS
LONGS = HASHES // LANES
CACHE = 1 << 16


class Words(dict):
    """64-bit hashes of words; forgets them all when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(raw: bytes, known: Words, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles."""
    ws = raw.translate(TABLE).split()
    n = len(ws)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, n)
    k = min(width, n)
    s = np.full(n - k + 1, n if n < width else 0, np.uint64)  # a short text's sequence equals no shingle
    for i in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ s >> np.uint64(32))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (found ^ found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = x[at : at + 2048, None] * MULTIPLY
        h += ADD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(out, h.min(0), out)
    return out


def bands_for(per: int, of: int) -> int:
    """The bands that miss a pair at the limit at most ``MISS`` times: 16 at 0.85, 22 at 0.8."""
    one = (per / of) ** ROWS
    return HASHES // ROWS if one <= 0 else 1 if one >= 1 else min(HASHES // ROWS, math.ceil(math.log(MISS) / math.log1p(-one)))


def margin(per: int, of: int) -> float:
    """How far below the limit the estimate of a pair may be."""
    c = 2.0**-BITS
    equal = c + (1 - c) * per / of
    return max(MARGIN, DEVIATIONS * math.sqrt(equal * (1 - equal) / HASHES) / (1 - c))


def band_keys(m: np.ndarray, bands: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(bands)], np.uint64).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, lane by lane, in longs."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64)


def signatures(documents: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(key, n, fp, bands, sig) of each row, with ``width`` bands; fp, bands and sig are null for empty texts."""

    def make():
        known, seen = Words(), {}

        def work(batch: pa.RecordBatch) -> dict:
            n, fp, bands, sig = [], [], [], []
            for raw in utf8(batch.column(1)):
                s = shingles(raw, known)
                n.append(len(s))
                if not len(s):
                    fp.append(None)
                    bands.append(None)
                    sig.append(None)
                    continue
                f = xxhash.xxh3_128_digest(s.tobytes())
                if f not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    m = minima(s)
                    seen[f] = band_keys(m, width), packed(m)
                fp.append(f)
                bands.append(seen[f][0])
                sig.append(seen[f][1])
            longs = pa.list_(pa.int64())
            return {"key": batch.column(0), "n": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.binary()), "bands": pa.array(bands, longs), "sig": pa.array(sig, longs)}

        return work

    return arrow_map(documents.select(key, text), make, f"key {dict(documents.dtypes)[key]}, n long, fp binary, bands array<long>, sig array<long>")


def sets(documents: DataFrame, text: str, key: str) -> DataFrame:
    """(key, fp, shingles) of each row, the sorted hashes as bytes."""

    def make():
        known = Words()

        def work(batch: pa.RecordBatch) -> dict:
            found = [shingles(raw, known).tobytes() for raw in utf8(batch.column(1))]
            return {"key": batch.column(0), "fp": pa.array([xxhash.xxh3_128_digest(s) if s else None for s in found], pa.binary()), "shingles": pa.array(found, pa.binary())}

        return work

    return arrow_map(documents.select(key, text), make, f"key {dict(documents.dtypes)[key]}, fp binary, shingles binary")


def estimate(equal, k: int = HASHES):
    """The similarity that a number of equal lanes stands for."""
    c = 2.0**-BITS
    return (equal / k - c) / (1 - c)


def equal_lanes(a: str, b: str):
    """The number of equal lanes of two signature columns, as a Spark expression."""
    mask = int("5" * 16, 16)
    differ = " + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & {mask}L)" for i in range(LONGS))
    return F.expr(f"{HASHES} - ({differ})")


def sized(a: str, b: str, per: int, of: int):
    """Whether two set sizes allow a link at all."""
    return (F.col(a) * of >= F.col(b) * per) & (F.col(b) * of >= F.col(a) * per)


def linked(x: np.ndarray, y: np.ndarray, per: int, of: int) -> bool:
    """Whether two sorted sets link."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return of * both >= per * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, full: DataFrame, per: int, of: int, work: Workspace) -> DataFrame:
    """The pairs (a, b) of fingerprints whose full sets link."""
    left = keys_join(full.withColumnRenamed("fp", "b"), pairs, "b").withColumnRenamed("shingles", "sb")
    right = keys_join(full.withColumnRenamed("fp", "a"), pairs.select("a").distinct(), "a", "left_semi").withColumnRenamed("shingles", "sa")

    def run(batches):
        for batch in parts(batches, 256):
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                keep.append(linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), per, of))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    joined = left.join(right, "a").select("a", "b", "sa", "sb")
    return work.save(map_arrow(joined, run, "a binary, b binary"), "links")


def across(members: DataFrame, mode: str, per: int, of: int, work: Workspace) -> DataFrame:
    """What is open between different components within a bucket, compared in blocks.

    ``members``: bk, fp, n, sig, bands, home, label.  Candidates are pairs of
    different labels whose estimate allows a link: of rows of one home in that
    bucket, of others in the first bucket that they share.
    Mode ``nearest``: (bk, a, b), of each row a its ``NEAREST`` most similar
    candidates b in a block, so each row with candidates is an a.  Mode ``open``: (bk, fp) of the rows with candidates.
    Mode ``links``, with the column shingles: links (a, b) confirmed on full sets
    that join the components of a block.  All return about as many rows as they
    read, however many candidates there are.
    """
    # rows of a bucket's largest label, or else of its largest foreign home, are blocks of their own, which need not meet one another
    sizes = members.groupBy("bk", "label").agg(F.count("*").alias("c")).groupBy("bk").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size")).where("top.c < size")
    homes = members.where("home <> bk").groupBy("bk", "home").agg(F.count("*").alias("c")).groupBy("bk").agg(F.max(F.struct("c", "home")).alias("far"))
    sizes = sizes.join(homes, "bk", "left").withColumn("most", F.greatest("top.c", "far.c")).where("most < size")
    each, others = f"greatest({BLOCK}, size / {BLOCKS})", F.expr("size - most")
    open_ = sizes.select("bk", F.expr("if(top.c = most, top.label, null)").alias("top"), F.expr("if(top.c = most, null, far.home)").alias("far"), F.expr(f"cast(ceil(most / {each}) as int)").alias("m"), F.expr(f"cast(ceil((size - most) / {each}) as int)").alias("k"), others.alias("others"), "most")
    open_ = work.save(open_, "buckets")
    total = open_.agg(F.expr("coalesce(sum(most * k + others * (m + k - 1)), 0)")).first()[0]
    rows = keys_join(members, open_.select("bk", "top", "far", "m", "k"), "bk").withColumn("top", F.expr("coalesce(label = top, home = far)"))
    rows = rows.withColumn("p", F.expr("cast(if(top, pmod(xxhash64(fp, bk), m), m + pmod(xxhash64(fp, bk), k)) as int)"))
    rows = rows.withColumn("q", F.explode(F.expr("if(top, sequence(m, m + k - 1), array_remove(sequence(0, m + k - 1), p))")))
    rows = rows.withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q")}).drop("q", "m", "k", "top", "far")
    schema = {"nearest": "bk long, a binary, b binary", "open": "bk long, fp binary", "links": "a binary, b binary"}[mode]
    mask, one, least = np.uint64(int("5" * 16, 16)), np.uint64(1), per / of - margin(per, of)

    def longs(column, width: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy().reshape(-1, width)

    def found(g: pa.Table) -> list[tuple]:
        fp = g.column("fp").to_pylist()
        label = np.unique(np.array(g.column("label").to_pylist(), object), return_inverse=True)[1]
        if label.max() == 0:
            return []
        n, p, home, bk = g.column("n").to_numpy(), g.column("p").to_numpy(), g.column("home").to_numpy(), g.column("bk")[0].as_py()
        sig, bands = longs(g.column("sig"), LONGS).view(np.uint64), longs(g.column("bands"), bands_for(per, of))
        band = int(np.flatnonzero(bands[0] == bk)[0])
        i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
        out, step = [], max(1, min(512, AT_ONCE // len(fp)))
        if mode == "links":
            shingles_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("shingles")]
        up = list(range(label.max() + 1))

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        for at in range(0, len(fp), step):
            s = slice(at, at + step)
            differ = np.zeros((len(label[s]), len(label)), np.int32)
            for k in range(LONGS):
                x = sig[s, None, k] ^ sig[None, :, k]
                differ += np.bitwise_count((x | x >> one) & mask)
            near = estimate(HASHES - differ)
            ok = (near >= least) & (label[s, None] != label) & (n[s, None] * of >= n * per) & (n * of >= n[s, None] * per)
            # rows of one block, which is not of the largest label or home, meet where it meets block 0
            ok &= (p[s, None] != p) | ((i == 0) & (p == j))
            one_home, first = home[s, None] == home, np.ones_like(ok)
            for k in range(band):
                first &= bands[s, None, k] != bands[None, :, k]
            ok &= np.where(one_home, home == bk, first)
            if mode == "open":
                out += [(bk, fp[at + x]) for x in np.flatnonzero(ok.any(1))]
                continue
            if mode == "nearest":
                near = np.where(ok, near, -1.0)
                keep = np.zeros_like(ok)
                np.put_along_axis(keep, np.argsort(-near, axis=1, kind="stable")[:, :NEAREST], True, 1)
                out += [(bk, fp[at + x], fp[y]) for x, y in zip(*np.nonzero(ok & keep), strict=True)]
                continue
            x, y = np.nonzero(ok & (np.arange(at, at + len(near))[:, None] < np.arange(len(fp))))
            order = np.argsort(-near[x, y], kind="stable")
            for x, y in zip((x[order] + at).tolist(), y[order].tolist(), strict=True):
                c, d = root(label[x]), root(label[y])
                if c != d and linked(shingles_[x], shingles_[y], per, of):
                    up[d] = c
                    out.append((fp[x], fp[y]))
        return out

    def made(out: list[tuple]) -> pa.RecordBatch:
        out, names = sorted(set(out)), [f.split() for f in schema.split(", ")]
        return pa.RecordBatch.from_pydict({name: pa.array([x[i] for x in out], pa.int64() if kind == "long" else pa.binary()) for i, (name, kind) in enumerate(names)})

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            k = np.stack([t.column(c).to_numpy() for c in ("bk", "i", "j")])
            cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()]
            out = [x for a, b in zip(cut, cut[1:], strict=False) for x in found(t.slice(a, b - a))]
            rest = t.slice(cut[-1])
            yield made(out)
        if rest is not None:
            yield made(found(rest))

    return map_arrow(dealt(rows, total, ["bk", "i", "j"], TASK_ROWS), run, schema).distinct()


def groups(documents: DataFrame, work: Workspace, text: str = "text", key: str = "doc_id", per: int = PER, of: int = OF) -> tuple[DataFrame, DataFrame]:
    """The rows' (key, n, fp), and (fp, component, again) of fingerprints with company.

    ``component`` is the least key of the component, ``again`` whether several
    rows hold that key.  Fingerprints that are alone are not in the second table.
    """
    least = per / of - margin(per, of)
    rows = work.save(signatures(documents, text, key, bands_for(per, of)), "signatures")
    some = rows.where(F.col("fp").isNotNull())
    nodes = work.save(some.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    in_bands = nodes.select(F.explode("bands").alias("bk"), "fp")
    shared = work.save(in_bands.groupBy("bk").agg(F.count("*").alias("size"), F.min("fp").alias("a")).where("size > 1"), "shared")
    homes = keys_join(in_bands, shared.select("bk", "size"), "bk").groupBy("fp").agg(F.max(F.struct("size", "bk")).alias("home"))
    homes = work.save(homes.select("fp", "home.bk").withColumnRenamed("bk", "home"), "homes")
    near = keys_join(nodes.select("fp", "n", "sig", "bands"), homes, "fp")
    members = work.save(keys_join(near.withColumn("bk", F.explode("bands")), shared.select("bk", "a"), "bk"), "members")
    used = work.save(keys_join(nodes.select("fp", "rep", "n", "sig"), homes.select("fp"), "fp", "left_semi"), "used")
    full = keys_join(documents.select(key, text), used.select(F.col("rep").alias(key)).distinct(), key, "left_semi")
    full = keys_join(sets(full, text, key).drop("key"), used.select("fp"), "fp", "left_semi")
    full = work.save(full.groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")

    stars = members.where("fp <> a").select("a", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")).distinct()
    stars = keys_join(stars, used.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    stars = stars.where(sized("na", "nb", per, of) & (estimate(equal_lanes("sa", "sb")) >= least)).select("a", "b")
    tried = work.save(stars, "pairs")
    links = confirm(tried, full, per, of, work)

    def merged_labels(label: DataFrame, more: DataFrame) -> DataFrame:
        """The labels once more links are known: components of components, so only those that they join are looked at."""
        if more.isEmpty():
            return label
        names = label.select(F.col("node"), F.col("label"))
        ends = keys_join(more.select(F.col("a").alias("node"), "b"), names, "node", "left").select(F.coalesce("label", "node").alias("a"), F.col("b").alias("node"))
        ends = keys_join(ends, names, "node", "left").select("a", F.coalesce("label", "node").alias("b"))
        joined = work.save(components(work.save(ends, "ends"), work).withColumnRenamed("label", "low"), "joined")
        moved = keys_join(label, joined.select(F.col("node").alias("label"), "low"), "label", "left").select("node", F.coalesce("low", "label").alias("label"))
        # nodes that had no link before
        new = joined.join(label.select("node"), "node", "left_anti").select("node", F.col("low").alias("label"))
        return work.save(moved.union(new), "labels")

    def named(label: DataFrame) -> DataFrame:
        return keys_join(members.drop("a"), label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))

    label = work.save(components(links, work), "labels")
    both = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nearest = work.save(across(named(label), "nearest", per, of, work), "nearest")
    more = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = work.save(keys_join(more, both, ["a", "b"], "left_anti"), "pairs")
    label = merged_labels(label, confirm(more, full, per, of, work))
    # labels only grow, so rows that had no candidates in a bucket have none now
    rows_ = keys_join(named(label), nearest.select("bk", F.col("a").alias("fp")).distinct(), ["bk", "fp"], "left_semi")
    open_ = work.save(across(rows_, "open", per, of, work), "open")
    if not open_.isEmpty():
        some_ = keys_join(rows_, open_, ["bk", "fp"], "left_semi")
        sets_ = keys_join(full, open_.select("fp").distinct(), "fp", "left_semi")
        label = merged_labels(label, work.save(across(some_.join(sets_, "fp"), "links", per, of, work), "links"))
    label = label.withColumnRenamed("node", "fp")
    linked = label.join(used.select("fp", "rep"), "fp")
    least_key = linked.groupBy("label").agg(F.min("rep").alias("component"))
    linked = linked.join(least_key, "label").select("fp", "component")
    alone = nodes.where("copies > 1").select("fp", F.col("rep").alias("component")).join(linked.select("fp"), "fp", "left_anti")
    found = linked.union(alone)
    repeated = some.groupBy("fp", "key").agg(F.count("*").alias("c")).where("c > 1").select("fp", F.col("key").alias("component"), F.lit(True).alias("again"))
    found = work.save(found.join(repeated, ["fp", "component"], "left").withColumn("again", F.coalesce("again", F.lit(False))), "found")
    work.keep(rows, found)
    return rows.select("key", "n", "fp"), found


def components_of(documents: DataFrame, text: str = "text", key: str = "doc_id", per: int = PER, of: int = OF) -> DataFrame:
    """One row for each row: the key, ``n_shingles``, ``component_id`` and ``kept``.

    Null, empty and blank texts have no shingles and stand alone, each its own
    component.  Equal rows are linked with each other.  A null key is never a
    component's name unless nothing else is in it; an empty table gives no rows;
    other columns are not read.
    """
    rows, found = groups(documents, Workspace(documents.sparkSession), text, key, per, of)
    out = keys_join(rows, found.select("fp", "component"), "fp", "left")
    out = out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def distinct_documents(documents: DataFrame, text: str = "text", key: str = "doc_id", per: int = PER, of: int = OF) -> DataFrame:
    """The rows of which one of each component stays, the one with the least key, in their own columns, whatever their names."""
    _, found = groups(documents, Workspace(documents.sparkSession), text, key, per, of)
    names = documents.columns
    at = names.index(text)
    print_, component, again = free(documents, "__fp", "__component", "__again")

    def run(batches):
        known = Words()
        for batch in parts(batches):
            s = [shingles(raw, known) for raw in utf8(batch.column(at))]
            yield batch.append_column(print_, pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in s], pa.binary()))

    from pyspark.sql.types import BinaryType, StructType

    marked = map_arrow(documents, run, StructType([*documents.schema.fields]).add(print_, BinaryType()))
    mine = found.select(F.col("fp").alias(print_), F.col("component").alias(component), F.col("again").alias(again))
    kept = keys_join(marked, mine, print_, "left").where(F.col(print_).isNull() | F.col(again).isNull() | F.col(f"`{key}`").eqNullSafe(F.col(component)))
    own = [F.col(f"`{c}`") for c in names]
    once = kept.where(~F.coalesce(again, F.lit(False))).select(own)
    if found.where("again").isEmpty():
        return once
    return once.union(kept.where(F.col(again)).dropDuplicates([print_]).select(own))


#: The query's rows from all shared shingles, without MinHash.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct([array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 3, 2))])) AS g FROM d WHERE len(ws) > 0),
r AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS g FROM r),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT a, min(b) AS low FROM t GROUP BY a)
SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_shingles, least(coalesce(r.rep, d.doc_id), c.low) AS component_id, d.doc_id = least(coalesce(r.rep, d.doc_id), c.low) AS kept
FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN r ON s.g = r.g LEFT JOIN c ON r.rep = c.a
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents", "doc_id", "text"))
