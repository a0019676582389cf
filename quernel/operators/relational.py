"""Row-wise operators, joins, aggregates, sets, sorts and samples, as DataFrame functions.

Columns are named or given by position.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Compiler, Typed, is_multi
from ..functions.rows import Rows
from ..model import PlanError, merged_names


def names(df: DataFrame, columns) -> list[str]:
    return [df.columns[c] if isinstance(c, int) else c for c in columns]


def at(c: str) -> Column:
    return F.col(f"`{c}`")


# rows


def filter_rows(df: DataFrame, predicate: dict, functions: dict | None = None) -> DataFrame:
    return df.where(Compiler(df, functions=functions)(predicate))


def apply(df: DataFrame, expressions: list[dict], counter: bool = False, functions: dict | None = None) -> DataFrame:
    """Generalised projection.

    Lists of multi-valued expressions are multiplied out for each row; an empty
    list drops it.  ``counter`` adds flatmapid, the position in the list, if one
    expression is multi-valued.
    """
    compile_ = Compiler(df, functions=functions)
    roots = [e["rootExpressionOperator"] for e in expressions]
    out = [e.get("outputName") or f"col{i}" for i, e in enumerate(expressions)]
    many = [i for i, e in enumerate(roots) if is_multi(e)]
    if counter and len(many) != 1:
        raise PlanError("a counter needs exactly one multi-valued expression")
    df = df.select(*[compile_(e).alias(f"__{i}") for i, e in enumerate(roots)])
    for i in many:
        rest = [c for c in df.columns if c != f"__{i}"]
        df = df.select(*rest, F.posexplode(f"__{i}").alias("flatmapid", f"__{i}") if counter else F.explode(f"__{i}").alias(f"__{i}"))
    return df.select(*[F.col(f"__{i}").alias(n) for i, n in enumerate(out)], *(["flatmapid"] if counter else []))


def stateful_apply(df: DataFrame, partition_by: list, order_by: list, initial: list[dict], update: list[dict], emit: list[dict]) -> DataFrame:
    """A scan with a state, in an explicit order within each partition.

    The state is updated before a row is emitted, all parts from the old state.
    States that are sums, maxima or minima of what a row gives, or counts, are
    Spark's running aggregates.  Any other goes through the sorted rows of a task
    one after the other, a batch at a time: time is linear in the rows, memory
    that of a batch, however long a partition is.
    """
    if not len(initial) == len(update):
        raise PlanError("as many updaters as initializers are needed")
    if not order_by:
        raise PlanError("an order is needed")
    for e in [*update, *emit]:
        if is_multi(e["rootExpressionOperator"]):
            raise PlanError("a stateful expression has one value")
    keys, order = names(df, partition_by), names(df, order_by)
    start = [Compiler(df)(e) for e in initial]
    # the types of the state are those that the updaters give
    probe = Compiler(df, start)
    kinds = [probe.type(probe(e)) for e in update]
    probe = Compiler(df, [F.lit(None).cast(k) for k in kinds])
    out_kinds = [probe.type(probe(e)) for e in emit]
    shown = [e.get("outputName") or f"col{i}" for i, e in enumerate(emit)]
    w = Window.partitionBy(*[at(k) for k in keys]).orderBy(*[at(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = [algebraic(df, i, s.cast(k), e, w) for i, (s, k, e) in enumerate(zip(start, kinds, update, strict=True))]
    if all(c is not None for c in plain):
        own = [f"__s{i}" for i in range(len(kinds))]
        held = df.select("*", *[c.cast(k).alias(n) for c, k, n in zip(plain, kinds, own, strict=True)])
        state = Compiler(held, [F.col(n) for n in own])
        return held.select(*[state(e).alias(n) for e, n in zip(emit, shown, strict=True)])
    first = df.sparkSession.range(1).select(*[s.cast(k).alias(f"s{i}") for i, (s, k) in enumerate(zip(start, kinds, strict=True))]).first()
    rows = Rows(probe)
    return folded(df, keys, order, tuple(first), [rows(e) for e in update], kinds, [rows(e) for e in emit], T.StructType([T.StructField(n, k) for n, k in zip(shown, out_kinds, strict=True)]), True)


def folded(df: DataFrame, keys: list[str], order: list[str], first: tuple, update: list, kinds: list, emit: list, schema: T.StructType, each: bool) -> DataFrame:
    """The sorted rows of each key through a state; what is emitted for each row, or after the last one, with the key before it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    at_keys = [df.columns.index(k) for k in keys]
    dealt = df.repartition(*[at(k) for k in keys]) if keys else df.coalesce(1) if df.isEmpty() else df.repartition(1)
    arrow = to_arrow_schema(schema)

    def run(batches):
        from quernel.functions.rows import fit

        state, now, some = None, None, []
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                columns = [c.to_pylist() for c in batch.slice(a, 4096).columns]
                for row in zip(*columns, strict=True):
                    key = tuple(row[i] for i in at_keys)
                    if state is None or key != now:
                        if state is not None and not each:
                            some.append((*now, *[f((), state) for f in emit]))
                        state, now = first, key
                    state = tuple(fit(f(row, state), k) for f, k in zip(update, kinds, strict=True))
                    if each:
                        some.append(tuple(f(row, state) for f in emit))
                if some:
                    yield made(some)
                    some = []
        if state is not None and not each:
            yield made([(*now, *[f((), state) for f in emit])])

    def made(some):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.sortWithinPartitions(*[at(c) for c in [*keys, *order]]).mapInArrow(run, schema)


def running(df: DataFrame, partition_by: list[str], order_by: list[str], **columns: Column) -> DataFrame:
    """Running aggregates up to each row, in an order within partitions."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({n: c.over(w) for n, c in columns.items()})


def counter(df: DataFrame, column: str, order_by: list | None = None) -> DataFrame:
    """Appends 0, 1, 2, ...: over an order that the whole table has, or within each partition.

    The global count ranges the rows, numbers each partition by itself and adds
    the sizes of those before, so no task sees all rows.
    """
    inner = (F.monotonically_increasing_id() % (1 << 33)).cast("long")
    if not order_by:
        return df.withColumn(column, inner)
    # written once: both the sizes and the rows must come from the same ranges
    from .iterate import cut

    df = cut(df.repartitionByRange(*[at(c) for c in names(df, order_by)]).sortWithinPartitions(*names(df, order_by)).withColumns({"__p": F.spark_partition_id(), "__at": inner}))
    size = df.groupBy("__p").count()
    before = size.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return df.join(F.broadcast(before), "__p").withColumn(column, F.col("__at") + F.col("__b")).drop("__p", "__at", "__b")


def cross_with_singleton(df: DataFrame, one: DataFrame) -> DataFrame:
    """Each row with the only row of ``one``; any other number of rows there raises."""
    out = merged_names(df.columns, one.columns)
    single = one.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[at(c) for c in one.columns])).alias("r"))
    single = single.select(F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("one row is needed, not "), F.col("n")))).alias("r"))
    rows = df.toDF(*[f"__l{i}" for i in range(len(df.columns))]).crossJoin(F.broadcast(single))
    return rows.select(*[F.col(f"__l{i}") for i in range(len(df.columns))], *[F.col("r")[c] for c in one.columns]).toDF(*out)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


# joins


def join(left: DataFrame, right: DataFrame, on1, on2, select1=None, select2=None, out=None, how: str = "inner", hint: str | None = None, set_left: bool = False, set_right: bool = False, residual=None) -> DataFrame:
    """Equi-join on columns of identical types, with the selected columns of both sides.

    A set side keeps one row a key.  ``hint``: shuffle_hash, merge or broadcast,
    for the right side, which is broadcast only where its estimated size allows it.
    ``residual``: a function of both sides' column finders.
    """
    on1, on2 = names(left, on1), names(right, on2)
    if len(on1) != len(on2):
        raise PlanError("as many columns on both sides are needed")
    for a, b in zip(on1, on2, strict=True):
        if left.schema[a].dataType != right.schema[b].dataType:
            raise PlanError(f"{a} and {b} differ in type")
    select1 = names(left, select1 if select1 is not None else left.columns)
    select2 = names(right, select2 if select2 is not None else right.columns)
    left = left.dropDuplicates(on1) if set_left else left
    right = right.dropDuplicates(on2) if set_right else right
    l, r = left.toDF(*[f"l__{c}" for c in left.columns]), right.toDF(*[f"r__{c}" for c in right.columns])  # noqa: E741
    test = reduce(lambda a, b: a & b, [at(f"l__{a}") == at(f"r__{b}") for a, b in zip(on1, on2, strict=True)])
    if residual is not None:
        test &= residual(lambda c: at(f"l__{c}"), lambda c: at(f"r__{c}"))
    if hint == "broadcast":
        r = small(r)
    elif hint:
        r = r.hint(hint)
    joined = l.join(r, test, how)
    chosen = [at(f"l__{c}") for c in select1] + ([] if how in ("left_semi", "left_anti") else [at(f"r__{c}") for c in select2])
    shown = out or (select1 if how in ("left_semi", "left_anti") else merged_names(select1, select2))
    return joined.select(*chosen).toDF(*shown)


def counting_join(left: DataFrame, right: DataFrame, on1, on2, name: str = "col0") -> DataFrame:
    """The number of join results, from the keys' counts on both sides; no result is made."""
    a = left.groupBy(*[at(c).alias(f"k{i}") for i, c in enumerate(names(left, on1))]).agg(F.count("*").alias("a"))
    b = right.groupBy(*[at(c).alias(f"k{i}") for i, c in enumerate(names(right, on2))]).agg(F.count("*").alias("b"))
    return a.join(b, [f"k{i}" for i in range(len(on1))]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("long").alias(name))


def multiway_join(tables: list[DataFrame], classes: list[list[tuple[int, int]]], output: list[tuple[int, int]], out: list[str] | None = None) -> DataFrame:
    """Inner join of any number of tables on classes of equal (table, column) positions, with bag semantics.

    The joins are chained over shared classes; where a table shares several with
    those joined so far, all are used at once, which closes cycles early.
    """
    flat = [df.toDF(*[f"t{i}_{j}" for j in range(len(df.columns))]) for i, df in enumerate(tables)]
    done, rest = {0}, set(range(1, len(tables)))
    now = flat[0]
    for c in classes:
        mine = [f"t{t}_{f}" for t, f in c if t == 0]
        for b in mine[1:]:
            now = now.where(F.col(mine[0]) == F.col(b))
    while rest:
        tests = lambda t: [(f"t{a}_{f}", f"t{t}_{g}") for c in classes for a, f in c[:] if a in done for u, g in c if u == t]
        t = max(sorted(rest), key=lambda t: len(tests(t)))
        pairs = tests(t)
        if not pairs:
            raise PlanError("a table shares no variable with the others")
        now = now.join(flat[t], reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in pairs]))
        done.add(t)
        rest.remove(t)
    chosen = now.select(*[f"t{t}_{f}" for t, f in output])
    return chosen.toDF(*(out or [tables[t].columns[f] if sum(tables[u].columns[g] == tables[t].columns[f] for u, g in output) == 1 else f"{tables[t].columns[f]}_{i}" for i, (t, f) in enumerate(output)]))


# aggregates

OPS = {
    "COUNT": lambda c, k: F.count(F.lit(1)),
    "MIN": lambda c, k: F.min(c),
    "MAX": lambda c, k: F.max(c),
    "SUM": lambda c, k: F.sum(c) if isinstance(k, T.IntegralType) else F.sum(c.cast("double")),
    "AVG": lambda c, k: F.avg(c),
    "STDEV": lambda c, k: F.stddev_pop(c.cast("double")),
}


def aggregators(df: DataFrame, specs: list[dict], functions: dict | None = None) -> list[Column]:
    out = []
    for spec in specs:
        kind = spec["type"]
        if kind == "CountAll":
            out.append(F.count(F.lit(1)).alias("count_all"))
        elif kind in ("Primitive", "SingleColumn"):
            c = names(df, [spec["column"]])[0]
            dtype = df.schema[c].dataType
            for op in spec["aggOps"]:
                if op not in OPS:
                    raise PlanError(f"unknown aggregate {op!r}")
                numeric = isinstance(dtype, T.NumericType)
                if isinstance(dtype, T.BinaryType) or op in ("SUM", "AVG", "STDEV") and not numeric or op in ("MIN", "MAX") and isinstance(dtype, T.BooleanType):
                    raise PlanError(f"{op} of {dtype.simpleString()}")
                out.append(OPS[op](at(c), dtype).alias(f"{op.lower()}_{c}"))
        elif kind == "UserDefined":
            out += user_defined(df, spec)
        elif kind == "Python":
            out += python_aggregate(df, spec, functions)
        else:
            raise PlanError(f"unknown aggregator {kind!r}")
    return out


def reads_state(e) -> bool:
    if isinstance(e, list):
        return any(map(reads_state, e))
    return isinstance(e, dict) and (e.get("type") == "STATE" or any(map(reads_state, e.values())))


def algebraic(df: DataFrame, i: int, start: Column, update: dict, window=None) -> Column | None:
    """State ``i`` after all rows (or those of a window up to each), as an aggregate, if its update adds to it or keeps an extreme of it.

    A sum passes a null on, as adding it to a state would.
    """
    e = update.get("rootExpressionOperator", update)
    mine = lambda x: x == {"type": "STATE", "columnIdx": i}
    over = (lambda c: c.over(window)) if window is not None else lambda c: c
    if mine(e):
        return start
    if e["type"] not in ("PLUS", "GREATER", "LESSER") or mine(e["left"]) == mine(e["right"]):
        return None
    x = e["right"] if mine(e["left"]) else e["left"]
    if reads_state(x):
        return None
    c = Compiler(df)(x)
    if e["type"] == "PLUS":
        whole = over(F.count(F.lit(1))) == over(F.count(c))
        return F.when(whole, start + F.coalesce(over(F.sum(c)), F.lit(0)))
    return F.greatest(start, over(F.max(c))) if e["type"] == "GREATER" else F.least(start, over(F.min(c)))


def user_defined(df: DataFrame, spec: dict) -> list[Column]:
    """An aggregate by initializers, updaters and emitters.

    States that are sums, maxima or minima of what a row gives become Spark's own
    aggregates, with partial sums before the shuffle.  Any other is folded over a
    group's rows in column order, in a task, as one array, with the types that
    rows and states have.
    """
    initial, update, emit = spec["initializers"], spec["updaters"], spec["emitters"]
    if len(initial) != len(update) or not emit:
        raise PlanError("as many updaters as initializers, and an emitter, are needed")
    start = [Compiler(df)(e) for e in initial]
    probe = Compiler(df, start)
    kinds = [probe.type(probe(e)) for e in update]
    plain = [algebraic(df, i, s.cast(k), e) for i, (s, k, e) in enumerate(zip(start, kinds, update, strict=True))]
    if all(c is not None for c in plain):
        state = Compiler(df, [c.cast(k) for c, k in zip(plain, kinds, strict=True)])
        return [state(e).alias(e.get("outputName") or f"uda{i}") for i, e in enumerate(emit)]

    def step(acc: Column, x: Column) -> Column:
        c = Typed(df, lambda n: x[n], [acc[f"s{i}"] for i in range(len(kinds))], kinds)
        return F.struct(*[c(e).cast(k).alias(f"s{i}") for i, (e, k) in enumerate(zip(update, kinds, strict=True))])

    rows = F.array_sort(F.collect_list(F.struct(*[at(c) for c in df.columns])))
    first = F.struct(*[s.cast(k).alias(f"s{i}") for i, (s, k) in enumerate(zip(start, kinds, strict=True))])

    def finish(e: dict):
        return lambda state: Typed(df, None, [state[f"s{i}"] for i in range(len(kinds))], kinds)(e)

    return [F.aggregate(rows, first, step, finish(e)).alias(e.get("outputName") or f"uda{i}") for i, e in enumerate(emit)]


def python_aggregate(df: DataFrame, spec: dict, functions: dict | None) -> list[Column]:
    """Registered Python aggregates: ``function`` of the columns ``columns``, each group in batches of Arrow."""
    f = (functions or {}).get(spec["function"])
    if f is None:
        raise PlanError(f"no function {spec['function']!r}")
    return [f(*[at(c) for c in names(df, spec["columns"])]).alias(spec.get("outputName") or spec["function"])]


def aggregate(df: DataFrame, group: list, specs: list[dict], empty_compat: bool = False, functions: dict | None = None) -> DataFrame:
    """Group columns, then aggregates.  ``empty_compat``: a global aggregate of nothing has no row, but a lone COUNT."""
    cols = aggregators(df, specs, functions)
    keys = names(df, group)
    if keys:
        return df.groupBy(*[at(k) for k in keys]).agg(*cols)
    lone = len(specs) == 1 and (specs[0]["type"] == "CountAll" or specs[0].get("aggOps") == ["COUNT"])
    if not empty_compat or lone:
        return df.agg(*cols)
    return df.agg(F.count(F.lit(1)).alias("__n"), *cols).where("__n > 0").drop("__n")


# sets and order


def union_all(*dfs: DataFrame) -> DataFrame:
    for df in dfs[1:]:
        if [f.dataType for f in df.schema] != [f.dataType for f in dfs[0].schema]:
            raise PlanError("a union needs equal types")
    return reduce(DataFrame.union, dfs)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    if [f.dataType for f in left.schema] != [f.dataType for f in right.schema]:
        raise PlanError("a difference needs equal types")
    return left.subtract(right)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def order_by(df: DataFrame, columns: list, ascending: list[bool] | None = None) -> DataFrame:
    cols = names(df, columns)
    return df.orderBy(*[at(c).asc() if up else at(c).desc() for c, up in zip(cols, ascending or [True] * len(cols), strict=True)])


def merge(dfs: list[DataFrame], columns: list, ascending: list[bool] | None = None) -> DataFrame:
    return order_by(union_all(*dfs), columns, ascending)


# samples


def sample_exact(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Exactly k rows without replacement, each set of k rows as likely; more than there are raises."""
    if df.limit(k).count() < k:
        raise PlanError(f"fewer than {k} rows")
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(k).drop("__r")


def sample_with_replacement(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Exactly k rows with replacement: k drawn row numbers, joined to the numbered rows."""
    total = df.count()
    if k and not total:
        raise PlanError("no rows to draw from")
    draws = df.sparkSession.range(k).select(F.floor(F.rand(seed) * total).cast("long").alias("__i"))
    return counter(df, "__i", order_by=df.columns).join(draws, "__i").drop("__i")


def sample_workers(df: DataFrame, distribution: DataFrame, seed: int = 0) -> DataFrame:
    """Of each worker's rows as many as the distribution allots it, with or without replacement as it says.

    ``distribution``: (WorkerID, StreamSize, SampleSize, SampleType) rows, one a
    worker, which are few.  A worker's rows are those of its partition, from 1.
    Repeated or non-positive ids raise, and so does a worker with too few rows.
    """
    from .iterate import cut

    sizes = {r.WorkerID: r for r in distribution.collect()}
    if len(sizes) < distribution.count() or any(w is None or w < 1 for w in sizes):
        raise PlanError("each worker's id must be positive, and come once")
    kinds = {r.SampleType for r in sizes.values()}
    if len(kinds) > 1:
        raise PlanError("samples of one kind are needed")
    rows = cut(df.select("*", (F.spark_partition_id() + 1).alias("__w"), (F.monotonically_increasing_id() % (1 << 33)).alias("__i"), F.rand(seed).alias("__r")))
    held = dict(map(tuple, rows.groupBy("__w").agg(F.count("*").alias("n")).collect()))
    want = [(w, int(r.SampleSize), held.get(w, 0)) for w, r in sizes.items() if r.SampleSize]
    replace = kinds == {"WithReplacement"}
    if short := [w for w, k, n in want if not n or k > n and not replace]:
        raise PlanError(f"worker {short[0]} has too few rows")
    wanted = df.sparkSession.createDataFrame(want, "__w int, __k long, __n long")
    if replace:
        draws = wanted.select("__w", F.explode(F.sequence(F.lit(1), "__k")).alias("__d"), "__n").select("__w", F.floor(F.rand(seed + 1) * F.col("__n")).cast("long").alias("__i"))
        return rows.join(draws, ["__w", "__i"]).select(*df.columns)
    ranks = rows.join(F.broadcast(wanted), "__w").withColumn("__at", F.row_number().over(Window.partitionBy("__w").orderBy("__r")))
    return ranks.where("__at <= __k").select(*df.columns)


def sampling_distribution(df: DataFrame, size: int | None = None, percent: float | None = None, replace: bool = False, seed: int = 0) -> DataFrame:
    """(WorkerID, StreamSize, SampleSize, SampleType) from (WorkerID, count[, actual count]) rows.

    There are as few rows as there are workers; they are allotted on the driver.
    """
    import numpy as np

    if (size is None) == (percent is None):
        raise PlanError("either a size or a percentage is needed")
    rows = sorted(df.collect())
    if len({r[0] for r in rows}) < len(rows) or any(r[0] is None or r[0] < 1 for r in rows):
        raise PlanError("each worker's id must be positive, and come once")
    counts = [int(r[1]) for r in rows]
    total = sum(counts)
    n = size if size is not None else round(total * percent / 100)
    if n < 0 or n > (total if not replace else n if total else 0):
        raise PlanError(f"{n} of {total} rows")
    rng, sizes, left, rest = np.random.default_rng(seed), [], n, total
    for c in counts:  # each worker's share, given those before it
        rest -= c
        if not left or not c:
            k = 0
        elif not rest:
            k = left
        elif replace:
            k = int(rng.binomial(left, c / (c + rest)))
        elif max(c, rest) < 10**9:
            k = int(rng.hypergeometric(c, rest, left))
        else:  # beyond what numpy draws from: the normal limit, kept possible
            p, all_ = c / (c + rest), c + rest
            k = round(rng.normal(left * p, (left * p * (1 - p) * (all_ - left) / (all_ - 1)) ** 0.5))
            k = min(max(k, 0, left - rest), c, left)
        sizes.append(k)
        left -= k
    kind = "WithReplacement" if replace else "WithoutReplacement"
    return df.sparkSession.createDataFrame([(int(r[0]), int(r[2] if len(r) > 2 else r[1]), s, kind) for r, s in zip(rows, sizes, strict=True)], "WorkerID int, StreamSize int, SampleSize int, SampleType string")


def reservoir(df: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """k rows of each partition, which stay in it, and (WorkerID, PartitionSize, PartitionSampleSize)."""
    from .iterate import cut

    rows = cut(df.withColumns({"__w": F.spark_partition_id() + 1, "__r": F.rand(seed)}))
    n = rows._jdf.rdd().getNumPartitions()
    kept = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__w").orderBy("__r"))).where(F.col("__n") <= k)
    size = rows.groupBy(F.col("__w").alias("WorkerID")).agg(F.count("*").cast("int").alias("PartitionSize"))
    kept = kept.repartitionById(max(n, 1), F.col("__w") - 1)
    return cut(kept.drop("__w", "__r", "__n")), size.withColumn("PartitionSampleSize", F.least("PartitionSize", F.lit(k)))


# distribution


def distribute(df: DataFrame, how: str, n: int | None = None, columns: list | None = None) -> DataFrame:
    """Hash, RoundRobin, Broadcast, Identity (the column names the partition) or Single.

    Broadcast asks for a broadcast where Spark's own estimate of the size allows it.
    """
    if how == "Hash":
        cols = [at(c) for c in names(df, columns or [])]
        return df.repartition(n, *cols) if n else df.repartition(*cols)
    if how == "RoundRobin":
        return df.repartition(n) if n else df.repartition()
    if how == "Broadcast":
        return small(df)
    if how == "Identity":
        n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartitionById(n, at(names(df, columns)[0]).cast("int") - 1)
    if how == "Single":
        return df.coalesce(1)
    raise PlanError(f"unknown distribution {how!r}")


#: Bytes, as Spark estimates them, of a side that is broadcast when asked for.
BROADCAST = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """The rows, marked for a broadcast if they are estimated to be small enough."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST else df


def shares(rows: list[int], variables: list[set[int]], cells: int) -> list[int]:
    """The dimensions of a cube of at most ``cells`` cells, one for each variable, in which a cell gets the fewest rows.

    ``rows`` are the tables' sizes, ``variables`` those that each table has.  Of
    equal ones the cube with the more even dimensions is taken.
    """
    n, best = 1 + max(set().union(*variables)), None

    def grow(dims: list[int], left: int) -> None:
        nonlocal best
        if len(dims) == n:
            load = sum(r / math.prod(dims[v] for v in vs) for r, vs in zip(rows, variables, strict=True))
            if best is None or (load, max(dims), dims) < best:
                best = load, max(dims), dims
            return
        for d in range(1, left + 1):
            grow([*dims, d], left // d)

    grow([], max(1, cells))
    return best[2]


def hypercube(df: DataFrame, dimensions: list[int], hashed: dict[int, str]) -> DataFrame:
    """The rows with ``cell``, once for each cell of the cube to which they belong.

    A row's place is fixed in the dimensions that its columns are hashed to and
    free in the others.
    """
    cell, stride = F.lit(0), 1
    for d in reversed(range(len(dimensions))):
        if d in hashed:
            place = F.pmod(F.xxhash64(at(hashed[d]), F.lit(d)), F.lit(dimensions[d])).cast("int")
        else:
            df = df.withColumn(f"__d{d}", F.explode(F.sequence(F.lit(0), F.lit(dimensions[d] - 1))))
            place = F.col(f"__d{d}")
        cell, stride = cell + place * stride, stride * dimensions[d]
    return df.withColumn("cell", cell).drop(*[f"__d{d}" for d in range(len(dimensions))])
