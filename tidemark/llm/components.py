"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, written


def components(edges: DataFrame) -> DataFrame:
    """node, component: for every node of edges (a, b: longs) the smallest node that it reaches.

    Nulls and loops don't count. Each round replaces the edges by fewer or equally many that join the same nodes; minima
    are taken with partial aggregates, so a node with very many neighbours is not gathered anywhere. Ends when all edges
    are stars: no node has two of them upward, or one upward and one from below.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(last)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        ups = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count_if(F.col("up") == 0).alias("downs"))
        if ups.where("ups > 1 or ups > 0 and downs > 0").isEmpty():
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
