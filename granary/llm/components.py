"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node it is connected with.

    Each round hangs nodes on their smallest neighbour; rounds grow with the logarithm of a component's diameter.
    Only minima are aggregated, so a node with very many neighbours is no single task's load.
    """
    stars = cut(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").select("b", "low").union(least.select(F.col("a").alias("b"), "low"))
        stars = cut(small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
