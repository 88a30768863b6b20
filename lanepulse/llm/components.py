"""Connected components by alternating large and small stars.

Only joins, grouping and distinct: each round links every node to the least node of its
neighbourhood, and the edges shrink to one star per component in about log n rounds. A node
with very many neighbours is only ever the probe side of a join, which the adaptive skew join
splits; its neighbourhood is reduced by a partial minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long); the component is its least node."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = scratch.keep(now, "edges")
    while not now.isEmpty():
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v"))
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = scratch.keep(moved.union(least).distinct(), "small")
        scratch.drop(now, large)
        now = small
        # a node's parents, and whether it is a parent: all stars once no node has two or is both
        roles = now.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        roles = roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if roles.filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select("v", "v").distinct())
