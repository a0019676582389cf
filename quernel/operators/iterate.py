"""Recursive relations to a fix-point, with pluggable states, and loops.

Each round joins only what is new (the delta) with the rest, and appends only
that: a delta is a reliable checkpoint in the shared folder, so the plan stays
short, a lost executor costs nothing but its own tasks, and what was held before
is not written again.  Now and then the deltas are compacted into one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PlanError

MOST = 1000
#: Deltas of a relation that are kept before they become one.
DELTAS = 12


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, a local master gets one of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise PlanError("spark.checkpoint.dir must name a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="quernel-")


def cut(df: DataFrame) -> DataFrame:
    """The DataFrame, written to the checkpoint folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def shared(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{folder(spark)}/quernel-{uuid.uuid4().hex}"


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled: a broadcast in each round would bring its rows to the driver."""
    return df.hint("merge")


class State:
    """How a recursive relation takes up candidate rows.

    ``first`` gives the rows to begin with; ``fresh`` those of ``new`` that are to
    be appended to ``held``, the rows appended so far; ``view`` what the relation
    is, made from them; ``told`` what others see of it.
    """

    def first(self, df: DataFrame) -> DataFrame:
        return df

    def view(self, held: DataFrame) -> DataFrame:
        return held

    def told(self, df: DataFrame) -> DataFrame:
        return df

    def merge(self, held: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The relation with ``new`` taken up, and what that changed."""
        delta = cut(self.fresh(held, new))
        return self.view(held.union(delta)), delta


@dataclass(frozen=True)
class DupElim(State):
    """Keeps the first sight of a row; new are the rows not seen."""

    def fresh(self, held: DataFrame, new: DataFrame) -> DataFrame:
        seen = apart(held.toDF(*[f"__{i}" for i in range(len(held.columns))]))
        return new.distinct().join(seen, reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(new.columns)]), "left_anti")

    def first(self, df: DataFrame) -> DataFrame:
        return df.distinct()


@dataclass(frozen=True)
class KeepMinValue(State):
    """Keeps, for each key, the row of the least values; new are rows of new keys or lesser values.

    With ``ordered`` the relation comes in the order of its values.
    """

    keys: tuple[str, ...]
    values: tuple[str, ...]
    ordered: bool = False

    def least(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.keys and c not in self.values]
        best = df.groupBy(*self.keys).agg(F.min(F.struct(*self.values, *rest)).alias("m"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"m.{c}").alias(c) for c in df.columns])

    def first(self, df: DataFrame) -> DataFrame:
        return self.sorted(self.least(df))

    def sorted(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*self.values, *self.keys) if self.ordered else df

    def view(self, held: DataFrame) -> DataFrame:
        return self.sorted(self.least(held))

    def fresh(self, held: DataFrame, new: DataFrame) -> DataFrame:
        old = held.groupBy(*self.keys).agg(F.min(F.struct(*self.values)).alias("__old"))
        return self.least(new).join(apart(old), list(self.keys), "left").where(F.col("__old").isNull() | (F.struct(*self.values) < F.col("__old"))).select(*new.columns)


@dataclass(frozen=True)
class CountFilter(State):
    """Holds distinct rows; a key is out once it has ``threshold`` of them."""

    keys: tuple[str, ...]
    threshold: int

    def first(self, df: DataFrame) -> DataFrame:
        return df.distinct()

    def fresh(self, held: DataFrame, new: DataFrame) -> DataFrame:
        return DupElim().fresh(held, new)

    def merge(self, held: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        fresh = cut(self.fresh(held, new))
        return held.union(fresh), cut(self.out(held, fresh))

    def out(self, held: DataFrame, fresh: DataFrame) -> DataFrame:
        """The keys that have passed with ``fresh`` and had not before."""
        return self.passed(held.union(fresh)).join(apart(self.passed(held)), list(self.keys), "left_anti")

    def told(self, df: DataFrame) -> DataFrame:
        return self.passed(df)

    def passed(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= self.threshold).select(*self.keys)


@dataclass(frozen=True)
class SimpleAppender(State):
    """Keeps all; everything is new."""

    def fresh(self, held: DataFrame, new: DataFrame) -> DataFrame:
        return new


class Held(dict):
    """The relations so far, by name; ``old``: as they were before the last round's rows."""

    def __init__(self, now: dict, old: dict):
        super().__init__(now)
        self.old = old


STATES = {"DupElim": DupElim, "KeepMinValue": KeepMinValue, "KeepAndSortOnMinValue": lambda k, v: KeepMinValue(k, v, True), "CountFilter": CountFilter, "SimpleAppender": SimpleAppender}


def fixpoint(initial: dict[str, DataFrame], states: dict, rules: Callable[[Held, dict], dict[str, DataFrame]], most: int = MOST) -> dict[str, DataFrame]:
    """Mutually recursive relations.

    ``rules(all, delta)`` gives the candidate rows of each relation, from the
    relations so far and what the last round added; ``all.old`` are the relations
    without that.  All relations take up their rows at the end of a round; it ends
    when nothing is new anywhere.
    """
    parts: dict[str, list[DataFrame]] = {}
    old, delta = {}, {}
    now = lambda n: reduce(DataFrame.union, parts[n])
    view = lambda n: states[n].view(now(n))
    for name, df in initial.items():
        parts[name] = [cut(states[name].first(df))]
        old[name] = initial[name].limit(0)
        delta[name] = cut(states[name].told(parts[name][0])) if isinstance(states[name], CountFilter) else parts[name][0]

    def take(name: str, new: DataFrame) -> None:
        held, state = now(name), states[name]
        fresh = cut(state.fresh(held, new))
        old[name] = state.view(held)
        delta[name] = cut(state.out(held, fresh)) if isinstance(state, CountFilter) else fresh
        parts[name].append(fresh)
        if len(parts[name]) > DELTAS:
            parts[name] = [cut(state.view(now(name)))]

    for _ in range(most):
        if all(d.isEmpty() for d in delta.values()):
            return {n: view(n) for n in initial}
        new = rules(Held({n: view(n) for n in initial}, dict(old)), dict(delta))
        for name in initial:
            if name in new:
                take(name, new[name])
            else:
                old[name], delta[name] = view(name), delta[name].limit(0)
    raise PlanError(f"no fix-point in {most} rounds")


#: Nodes of a piece of a group in ``generations``, about.
PIECE = 1000


def generations(arcs: DataFrame) -> DataFrame:
    """The pairs (x, y) of one generation: different children of a parent, and children of such a pair.

    ``arcs``: (a, b) rows, from parent to child.  There are as many pairs as the
    square of a generation, so only those of parents go through the recursion.
    Nodes that have the same parents are alike: what groups of them meet is found
    for the groups, and their pairs are spread out at the end, a piece of one
    group with a piece of another at a time, without a shuffle of pairs.
    """
    from .relational import join

    arcs = cut(arcs.toDF("a", "b").distinct())
    inner = cut(arcs.join(arcs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    start = join(inner, inner, ["a"], ["a"], ["b"], ["b"], ["x", "y"]).where("x <> y")

    def step(held, delta):
        down = join(delta["sg"], inner, ["x"], ["a"], ["y"], ["b"], ["y", "x2"])
        return {"sg": join(down, inner, ["y"], ["a"], ["x2"], ["b"], ["x", "y"])}

    sg = fixpoint({"sg": start}, {"sg": DupElim()}, step)["sg"]
    nodes = cut(arcs.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("g")))
    groups = cut(nodes.groupBy("g").agg(F.count("*").alias("n")))
    one = groups.select(F.col("g").alias("g1"), F.explode("g").alias("x"))
    two = groups.select(F.col("g").alias("g2"), F.explode("g").alias("y"))
    same = one.join(two, F.col("x") == F.col("y")).select("g1", "g2", F.lit(False).alias("itself"))
    kin = one.join(sg, "x").join(two, "y").select("g1", "g2", F.lit(True).alias("itself"))
    met = same.union(kin).groupBy("g1", "g2").agg(F.max("itself").alias("itself"))
    piece = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PIECE))
    pieces = cut(nodes.join(groups, "g").groupBy("g", piece.alias("p")).agg(F.collect_list("b").alias("nodes")))
    side = lambda k: pieces.toDF(f"g{k}", f"p{k}", f"nodes{k}")
    # a number of its own, since Spark would take these few rows into one task
    dealt = met.join(side(1), "g1").join(side(2), "g2").repartition(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g1", "p1", "g2", "p2")
    pairs = dealt.select(F.explode("nodes1").alias("x"), "nodes2", "itself").select("x", F.explode("nodes2").alias("y"), "itself")
    return pairs.where("itself or x <> y").select("x", "y")


def do_while(state: dict, body: Callable[[dict], dict], condition: Callable[[dict], DataFrame], most: int = MOST) -> dict:
    """Runs the body, then reads the condition's only value, and repeats while it is true."""
    for _ in range(most):
        state = {k: cut(v) if isinstance(v, DataFrame) else v for k, v in body(state).items()}
        if not single(condition(state)):
            return state
    raise PlanError(f"more than {most} rounds")


def single(df: DataFrame):
    """The value of one row and its first column; another number of rows raises."""
    rows = df.take(2)
    if len(rows) != 1:
        raise PlanError("one row is needed")
    return rows[0][0]
