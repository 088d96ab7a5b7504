"""Connected components by alternating large-star and small-star steps, in DataFrame operations only.

Each step replaces a node's edges by edges to the smallest node known around it. The minima are aggregated map-side
and joined back, so a hub's edges are split over tasks by adaptive execution and never gathered. Every round is
written to the shared folder. The rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that an edge (a, b) joins to another; the edges may repeat."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(pairs.where("u != v").distinct())
    mark = _mark(now)
    while mark[0]:
        now = written(_small(_large(now)))
        after = _mark(now)
        if after == mark:
            break
        mark = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
