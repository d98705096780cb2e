"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node; minima are taken before the
shuffle, so that a node with very many edges costs no single task its whole
neighbourhood in memory, and such a node's join is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of all nodes with an edge to another node; component is the smallest node."""
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    e = cut(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        now = _state(e)
        if now == state:
            break
        state = now
    # now every node but the smallest of a component has one edge, to the smallest
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
