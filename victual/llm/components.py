"""Connected components by alternating large and small stars.

Every round works on a distributed edge table, which is written to the shared
folder, so that a lost executor costs one round at most.  No node's
neighbours are gathered in one task: minima are pre-aggregated and joined back
(the join's skewed partitions can be split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (hi, lo) with hi > lo."""
    if large:
        around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    else:
        around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select("u", "m"))
    return out.where("hi > lo").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is below one other at most, and none has nodes both above and below."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(edges.select("lo", F.lit(0), F.lit(1)))
    around = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return around.where("above > 1 or (above > 0 and below > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``: each node's smallest reachable node.

    Nodes without an edge to another node, and null ends, are left out; so
    empty edges give an empty table.
    """
    state = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    while not _are_stars(state):
        # One at a time: a plan of both holds the large star three times over, and the driver all of its stages.
        for large in (True, False):
            state = written(_stars(state, large), "edges")
    roots = state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(state.select("lo", "lo").distinct())
