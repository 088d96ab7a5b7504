"""Global orders without a global task: running totals, ranks, quotas, shards and allocations.

A total order over all rows is a range partition. Each range is summed, the sums of earlier ranges (one row a range)
are added, and only then does a window run inside each range. No window runs over an unpartitioned table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written


def running(df: DataFrame, order: list[str], value: Column | None = None, ranges: int | None = None, total: str = "running_total", rank: str = "global_rank") -> DataFrame:
    """df with the rank from 1 and the running total of value in the given order (which must be unique, or its ties equal)."""
    n = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.withColumn("v__", F.coalesce(value, F.lit(0)).cast("decimal(38,0)") if value is not None else F.lit(1).cast("decimal(38,0)"))
    rows = written(rows.repartitionByRange(n, *order).withColumn("range__", F.spark_partition_id()))
    sums = rows.groupBy("range__").agg(F.sum("v__").alias("sum__"), F.count("*").alias("count__"))
    before = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("range__", F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("base__"), F.coalesce(F.sum("count__").over(before), F.lit(0)).alias("seen__"))
    inside = Window.partitionBy("range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(sums), "range__")
    out = out.withColumn(total, (F.sum("v__").over(inside) + F.col("base__")).cast("long")).withColumn(rank, (F.count("*").over(inside) + F.col("seen__")).cast("long"))
    return out.drop("range__", "v__", "base__", "seen__")


def quota_prefix(df: DataFrame, order: list[str], tokens: str, quota: int) -> DataFrame:
    """Rows in order while their tokens fit the quota, and the part of the first that does not: taken (tokens kept) fills it exactly."""
    rows = running(df, order, F.col(tokens))
    start = F.col("running_total") - F.col(tokens)
    return rows.where(start < quota).withColumn("taken", F.least(F.col(tokens), F.lit(quota) - start)).drop("global_rank", "running_total").where("taken > 0")


def running_in_groups(df: DataFrame, groups: list[str], order: list[str], value: Column | None = None, total: str = "running_total", rank: str = "group_rank") -> DataFrame:
    """df with the rank from 1 and the running total of value inside each group, null groups included.

    One range partition by (groups, order) and the sums of earlier ranges of the same group (a row for each range and
    group in it): a group of any size is spread over as many ranges as it fills.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.withColumn("v__", (F.coalesce(value, F.lit(0)) if value is not None else F.lit(1)).cast("decimal(38,0)"))
    rows = written(rows.repartitionByRange(n, *groups, *order).withColumn("range__", F.spark_partition_id()))
    sums = rows.groupBy(*groups, "range__").agg(F.sum("v__").alias("sum__"), F.count("*").alias("count__"))
    before = Window.partitionBy(*groups).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"g{i}__") for i, g in enumerate(groups)]
    sums = sums.select(*keys, F.col("range__").alias("at__"), F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("base__"), F.coalesce(F.sum("count__").over(before), F.lit(0)).alias("seen__"))
    same = rows["range__"] == F.col("at__")
    for i, g in enumerate(groups):
        same = same & rows[g].eqNullSafe(F.col(f"g{i}__"))
    inside = Window.partitionBy(*groups, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(sums, same)
    out = out.withColumn(total, (F.sum("v__").over(inside) + F.col("base__")).cast("long")).withColumn(rank, (F.count("*").over(inside) + F.col("seen__")).cast("long"))
    return out.drop("range__", "v__", "base__", "seen__", "at__", *[f"g{i}__" for i in range(len(groups))])


def grouped_quota(df: DataFrame, groups: list[str], order: list[str], tokens: str, quota: Column) -> DataFrame:
    """Rows of each group in order until its tokens reach the quota; the last one may overshoot."""
    rows = running_in_groups(df, groups, order, F.col(tokens))
    return rows.where(F.col("running_total") - F.coalesce(F.col(tokens), F.lit(0)) < quota).drop("running_total", "group_rank")


def round_robin(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """df with shard = (rank - 1) mod shards in a global order."""
    return running(df, order).withColumn("shard", ((F.col("global_rank") - 1) % shards).cast("int")).drop("running_total")


def write_shards(df: DataFrame, path: str, order: list[str], shards: int, fmt: str = "json") -> None:
    """The shards as folders of files, each sorted by rank; existing output is an error."""
    rows = round_robin(df, order, shards)
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "global_rank").write.partitionBy("shard").format(fmt).mode("errorifexists").save(path)


def hash_order_split(df: DataFrame, order: Column, sizes: list[tuple[str, int]], rest: str) -> DataFrame:
    """df with split: the first rows in hash order go to the named splits by their sizes, all others to rest."""
    rows = running(df.withColumn("order__", order), ["order__"])
    at, split = 0, None
    for name, size in sizes:
        hit = F.col("global_rank") <= at + size
        split = F.when(hit, name) if split is None else split.when(hit, name)
        at += size
    return rows.withColumn("split", split.otherwise(rest) if split is not None else F.lit(rest)).drop("order__", "running_total")


def bottom_k(df: DataFrame, groups: list[str], score: Column, k: int) -> DataFrame:
    """The k rows of least score in each group, score included."""
    w = Window.partitionBy(*groups).orderBy("score")
    return df.withColumn("score", score).withColumn("k__", F.row_number().over(w)).where(F.col("k__") <= k).drop("k__")


def first_in_group(df: DataFrame, groups: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("k__", F.row_number().over(w)).where(F.col("k__") <= n).drop("k__")


def allocate(weights: DataFrame, total: int, name: str = "name", weight: str = "weight") -> DataFrame:
    """Largest remainder: floors, then one more by descending (fraction, name); weights is a short list."""
    share = F.lit(float(total)) * (F.col(weight) / F.sum(weight).over(Window.partitionBy(F.lit(1))))
    rows = weights.withColumn("raw__", share).withColumn("floor__", F.floor("raw__"))
    whole = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy((F.col("raw__") - F.col("floor__")).desc(), F.col(name).desc())
    rows = rows.withColumn("left__", F.lit(total) - F.sum("floor__").over(whole)).withColumn("k__", F.row_number().over(order))
    return rows.withColumn("quota", (F.col("floor__") + (F.col("k__") <= F.col("left__")).cast("long")).cast("long")).drop("raw__", "floor__", "left__", "k__")


def last_takes_rest(weights: DataFrame, total: int, position: str = "position", weight: str = "weight") -> DataFrame:
    """Truncated shares; the last entry takes what is left."""
    rows = weights.withColumn("q__", F.floor(F.lit(total) * F.col(weight)).cast("long"))
    whole = Window.partitionBy(F.lit(1))
    last = F.col(position) == F.max(position).over(whole)
    return rows.withColumn("quota", F.when(last, F.lit(total) - (F.sum("q__").over(whole) - F.col("q__"))).otherwise(F.col("q__"))).drop("q__")


def keep_earliest(df: DataFrame, key: str, split_rank: Column) -> DataFrame:
    """Rows whose split is the earliest that holds their key."""
    least = df.groupBy(key).agg(F.min(split_rank).alias("least__"))
    return df.join(least, key).where(split_rank == F.col("least__")).drop("least__")


def group_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """(reward - mean) / (population deviation + 1e-4) inside each group."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("mean__"), F.stddev_pop(reward).alias("std__"))
    return df.join(stats, group).withColumn("advantage", (F.col(reward) - F.col("mean__")) / (F.col("std__") + 1e-4)).drop("mean__", "std__")


def token_windows(df: DataFrame, order: list[str], tokens: str, budget: int) -> DataFrame:
    """df with the first and last training window that each row's tokens fall in; windows hold exactly budget tokens."""
    rows = running(df, order, F.col(tokens))
    start = F.col("running_total") - F.col(tokens)
    return rows.withColumn("first_window", F.floor(start / budget).cast("long")).withColumn("last_window", F.floor((F.col("running_total") - 1) / budget).cast("long")).drop("running_total")


def stratified_batches(df: DataFrame, stratum: str, order: Column, per_stratum: int) -> DataFrame:
    """df with batch: each batch takes per_stratum rows of every stratum in hash order."""
    rows = running_in_groups(df.withColumn("order__", order), [stratum], ["order__"])
    return rows.withColumn("batch", F.floor((F.col("group_rank") - 1) / per_stratum).cast("int")).drop("order__", "running_total", "group_rank")


def reservoir(df: DataFrame, k: int, identity: Column, seed: str) -> DataFrame:
    """A uniform sample of k rows without replacement, the same in every run: those of least seeded hash of their identity.

    Every task keeps its own k least, so at most k rows a task meet.
    """
    from millrace.functions.hashing import sha256

    draw = sha256(F.concat(F.lit(f"{seed}:"), identity.cast("string")))
    return df.withColumn("draw__", draw).orderBy("draw__").limit(k).drop("draw__")
