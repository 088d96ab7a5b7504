"""Deduplication and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_first(df: DataFrame, digest: Column, order: str) -> DataFrame:
    """One row of least order for each digest; null is a digest like others, and of rows that tie any one stays.

    An aggregation that combines before the shuffle finds the least order, so only its rows meet the final choice.
    """
    rows = df.withColumn("digest__", digest)
    keep = rows.groupBy("digest__").agg(F.min(order).alias("least__"))
    first = rows.join(keep, rows["digest__"].eqNullSafe(keep["digest__"]) & rows[order].eqNullSafe(keep["least__"]), "left_semi")
    return first.dropDuplicates(["digest__"]).drop("digest__")


def duplicate_counts(df: DataFrame, digest: Column) -> DataFrame:
    """n_rows, n_distinct and n_duplicates: digests are counted first, so no task sees all of them."""
    per = df.groupBy(digest.alias("d")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("d").alias("n_distinct"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


def priority_winner(df: DataFrame, digest: str, priority: list[str]) -> DataFrame:
    """For each digest the row that is least by the priority columns."""
    w = Window.partitionBy(digest).orderBy(*priority)
    return df.withColumn("k__", F.row_number().over(w)).where("k__ = 1").drop("k__")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def overlap_matrix(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """a, b, n: how many distinct keys each pair of splits shares; one pass over the tagged union."""
    return overlaps(reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("split"), F.col(key).alias("key")) for name, df in splits.items()]))


def overlaps(tagged: DataFrame) -> DataFrame:
    """a, b, n of all splits found in rows of (split, key); null splits and keys count nowhere."""
    sets = tagged.where("key is not null").groupBy("key").agg(F.array_sort(F.collect_set("split")).alias("s"))  # at most one entry a split
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def set_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either side only, with side: missing or unexpected."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def union_sources(frames: dict[str, DataFrame], tag: str = "source_id") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def greedy_accept(nodes: DataFrame, edges: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """The rows that a scan in rank order accepts when each accepted row bars its neighbours: node, rank -> node.

    Copies are rows b that equal a row a, which stands for them in edges: they bar each other and have the same neighbours,
    so only the lowest-ranked of them can be accepted and takes the place of a.

    A row is accepted once all its lower-ranked neighbours are barred, and barred once one of them is accepted; rounds
    settle all rows whose lower neighbours are settled. Equal to the sequential scan, without one.
    """
    from millrace.session import written

    ranks = nodes.select("node", "rank")
    if copies is not None:
        groups = copies.select("a", F.col("b").alias("node")).unionByName(copies.select("a", F.col("a").alias("node"))).distinct()
        groups = written(groups.join(ranks, "node"))
        leads = written(groups.groupBy("a").agg(F.min_by("node", F.struct("rank", "node")).alias("lead")))
        ranks = written(ranks.join(groups.select("node"), "node", "left_anti").unionByName(ranks.join(leads.select(F.col("lead").alias("node")), "node", "left_semi")))
        for end in ("a", "b"):
            edges = edges.join(leads.withColumnRenamed("a", end), end, "left").withColumn(end, F.coalesce("lead", end)).drop("lead")
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.a", "e.b").distinct()
    low = both.join(ranks.withColumnsRenamed({"node": "a", "rank": "ra"}), "a").join(ranks.withColumnsRenamed({"node": "b", "rank": "rb"}), "b")
    # (node, lower neighbour)
    waits = written(low.where((F.col("rb") < F.col("ra")) | ((F.col("rb") == F.col("ra")) & (F.col("b") < F.col("a")))).select(F.col("a").alias("node"), F.col("b").alias("lower")))
    accepted = written(ranks.join(waits, "node", "left_anti").select("node"))
    while not waits.isEmpty():
        barred = written(waits.join(accepted.withColumnRenamed("node", "lower"), "lower", "left_semi").select("node").distinct())
        left = waits.join(barred, "node", "left_anti").join(barred.withColumnRenamed("node", "lower"), "lower", "left_anti")
        left = written(left.select("node", "lower"))
        freed = waits.select("node").distinct().join(barred, "node", "left_anti").join(left, "node", "left_anti")
        accepted = written(accepted.unionByName(freed))
        waits = left
    return accepted
