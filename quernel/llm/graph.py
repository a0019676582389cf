"""Connected components by alternating large and small stars.

Every step is an aggregation with a partial minimum and a join that Spark may
split where a key is hot; each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    near = both.join(low, "u")
    near = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return near.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one node that hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.where("hangs > 1 or hangs + holds > 1").isEmpty()


def components(edges: DataFrame, work: Workspace, most: int = 60) -> DataFrame:
    """(node, label): the least node of the component of each node that has an edge.

    ``edges`` has two columns of one orderable type; direction, loops, nulls and
    repeated edges don't matter.  Without edges the result is empty.
    """
    a, b = edges.columns[:2]
    first = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = work.save(first.distinct(), "edges")
    for _ in range(most):
        if _settled(now):
            break
        new = work.save(_star(_star(now, True), False), "edges")
        work.drop(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
