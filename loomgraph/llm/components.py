"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step is an aggregation (which combines before the shuffle) and a join of two written tables, so that the
adaptive planner can split the partition of a hub.  Edges live in the shared folder between the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node hangs on two others, or on one that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return per.where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns (node, root): the smallest node reachable, for every node that has an edge.

    Nodes are integers.  Loops, repeated and reversed edges are allowed; edges with a null end are left out.  An
    empty table gives an empty one.  Rounds are few: the number of steps grows with the logarithm of a component.
    """
    spark = edges.sparkSession
    first = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path = cut(first, "edges")
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, p1 = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        large, p2 = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least2, p3 = cut(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        hung = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, p4 = cut(hung.union(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for p in (path, p1, p2, p3):
            drop(spark, p)
        now, path = new, p4
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
