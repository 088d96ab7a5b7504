"""Roll-ups of per-item scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(df: DataFrame, groups: list[str], flags: dict[str, Column]) -> DataFrame:
    """n and the share of rows with each flag, by group."""
    return df.groupBy(*groups).agg(F.count("*").alias("n"), *[F.avg(v.cast("int")).alias(k) for k, v in flags.items()])


def pass_at_k(samples: Column) -> Column:
    return F.exists(samples, lambda s: s)


def ratio_of_sums(df: DataFrame, groups: list[str], over: str, under: str, name: str) -> DataFrame:
    return df.groupBy(*groups).agg((F.sum(over) / F.greatest(F.sum(under), F.lit(1))).alias(name))


def weighted_nll(df: DataFrame, groups: list[str], loss: str, n: str, cap: float = 80.0) -> DataFrame:
    """Token-weighted loss and perplexity, by group."""
    mean = F.sum(F.col(loss) * F.col(n)) / F.sum(n)
    return df.groupBy(*groups).agg(mean.alias("nll"), F.exp(F.least(mean, F.lit(cap))).alias("ppl"), F.sum(n).alias("tokens"))


def macro(df: DataFrame, groups: list[str], first: str, second: str) -> DataFrame:
    """The unweighted mean over tasks of the first metric, or of the second where it is null."""
    return df.groupBy(*groups).agg(F.avg(F.coalesce(first, second)).alias("macro"), F.count("*").alias("tasks"))


def paired(left: DataFrame, right: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Both scores of each key; keys on one side only raise an error when the rows are read."""
    rows = left.select(*keys, F.col(score).alias("left")).join(right.select(*keys, F.col(score).alias("right")), keys, "full_outer")
    one_sided = F.col("left").isNull() | F.col("right").isNull()
    return rows.withColumn("left", F.when(one_sided, F.raise_error(F.lit("a key has no partner"))).otherwise(F.col("left")).cast("double"))


def wins(pairs: DataFrame, groups: list[str] | None = None) -> DataFrame:
    d = F.col("left") - F.col("right")
    one = lambda c: F.sum(c.cast("long"))
    return pairs.groupBy(*(groups or [])).agg(one(d > 0).alias("win"), one(d == 0).alias("tie"), one(d < 0).alias("loss"), F.avg(d).alias("mean_difference"))


def paired_bootstrap(pairs: DataFrame, group: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """group, mean, lower, upper: percentile interval of the mean difference.

    Differences are first counted by value, so a group of any size is a short histogram; resampling rows with
    replacement is then multinomial over the counts.
    """
    counts = pairs.groupBy(group, (F.col("left") - F.col("right")).cast("double").alias("d")).agg(F.count("*").alias("n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("d")
        d, n = frame["d"].to_numpy(float), frame["n"].to_numpy()
        total, rng = int(n.sum()), np.random.default_rng(seed)
        means = rng.multinomial(total, n / total, size=replicates) @ d / total
        lower, upper = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({group: [frame[group].iloc[0]], "mean": [float((d * n).sum() / total)], "lower": [lower], "upper": [upper], "n": [total]})

    kind = dict(pairs.dtypes)[group]
    return counts.groupBy(group).applyInPandas(run, f"{group} {kind}, mean double, lower double, upper double, n bigint")


def cluster_bootstrap(df: DataFrame, group: str, cluster: str, over: str, under: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Interval of a ratio of sums when whole clusters are resampled; clusters are summed, then counted by their sums."""
    sums = df.groupBy(group, cluster).agg(F.sum(over).cast("double").alias("a"), F.sum(under).cast("double").alias("b"))
    counts = sums.groupBy(group, "a", "b").agg(F.count("*").alias("n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "b"])
        a, b, n = (frame[c].to_numpy(float) for c in ("a", "b", "n"))
        draws = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=replicates)
        ratio = draws @ a / np.maximum(draws @ b, 1e-12)
        lower, upper = np.quantile(ratio, [0.025, 0.975])
        return pd.DataFrame({group: [frame[group].iloc[0]], "ratio": [float((a * n).sum() / (b * n).sum())], "lower": [lower], "upper": [upper]})

    return counts.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, ratio double, lower double, upper double")


def stratified_bootstrap(pairs: DataFrame, stratum: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: the mean over strata of mean differences in -1, 0, 1, with its multinomial interval."""
    d = F.signum(F.col("left") - F.col("right"))
    counts = pairs.groupBy(stratum).agg(*[F.sum((d == v).cast("long")).alias(k) for k, v in (("lose", -1), ("tie", 0), ("win", 1))])
    counts = counts.withColumn("one", F.lit(0))  # one row a stratum

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, rng = frame.sort_values(stratum), np.random.default_rng(seed)
        n = frame[["lose", "tie", "win"]].to_numpy()
        means = np.mean([rng.multinomial(int(r.sum()), r / r.sum(), size=replicates) @ np.array([-1, 0, 1]) / r.sum() for r in n], axis=0)
        lower, upper = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"macro": [float(np.mean([(r[2] - r[0]) / r.sum() for r in n]))], "lower": [lower], "upper": [upper], "strata": [len(n)]})

    return counts.groupBy("one").applyInPandas(run, "macro double, lower double, upper double, strata bigint")


def pearson(df: DataFrame, x: str, y: str, groups: list[str] | None = None) -> DataFrame:
    """Correlation, null where a side does not vary."""
    varies = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return df.groupBy(*(groups or [])).agg(F.when(varies, F.corr(x, y)).alias("r"), F.count("*").alias("n"))


def conditional_means(df: DataFrame, value: str, conditions: dict[str, Column], groups: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(groups or [])).agg(*[F.avg(F.when(c, F.col(value))).alias(k) for k, c in conditions.items()])


def collapse(df: DataFrame, groups: list[str], choice: str, limit: float = 0.9) -> DataFrame:
    """The largest share of one choice, and whether it passes the limit."""
    per = df.groupBy(*groups, choice).agg(F.count("*").alias("n"))
    return per.groupBy(*groups).agg((F.max("n") / F.sum("n")).alias("top_share"), ((F.max("n") / F.sum("n")) > limit).alias("collapsed"))


def throughput(df: DataFrame, key: str, order: str, value: str, last: int = 100) -> DataFrame:
    """Mean, sample deviation and the mean of the last rows, by key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    rows = df.withColumn("k__", F.row_number().over(w))
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.avg(F.when(F.col("k__") <= last, F.col(value))).alias("last_mean"))


def rolling_mean(df: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    return df.withColumn("rolling_mean", F.avg(value).over(w))


def median_ratios(df: DataFrame, scenario: str, arm: str, value: str, arms: list[str]) -> DataFrame:
    """Each arm's median by scenario, and the first arm's over each other's."""
    wide = df.groupBy(scenario).pivot(arm, arms).agg(F.percentile(value, 0.5))
    return wide.select(scenario, *[F.col(a).alias(f"median_{a}") for a in arms], *[(F.col(arms[0]) / F.col(a)).alias(f"ratio_{a}") for a in arms[1:]])


def halves(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Last value, maximum, and the means of the first int(n / 2) rows and of the rest, by key."""
    w = Window.partitionBy(key)
    rows = df.withColumn("k__", F.row_number().over(w.orderBy(order))).withColumn("n__", F.count("*").over(w))
    first = F.col("k__") <= F.floor(F.col("n__") / 2)
    return rows.groupBy(key).agg(F.max_by(value, order).alias("last"), F.max(value).alias("max"), F.avg(F.when(first, F.col(value))).alias("first_half"), F.avg(F.when(~first, F.col(value))).alias("second_half"))


def gates(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """gate, passed for each named check of a one-row table, and the gate "all"."""
    every = F.lit(True)
    for c in checks.values():
        every = every & F.coalesce(c, F.lit(False))
    named = [F.struct(F.lit(k).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()]
    return row.select(F.explode(F.array(*named, F.struct(F.lit("all").alias("gate"), every.alias("passed")))).alias("g")).select("g.*")


def balance(df: DataFrame, value: str, support: list, most_gap: int) -> DataFrame:
    """One row: distinct values, missing ones, gap between the most and least frequent, and whether it is balanced."""
    per = df.groupBy(value).agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("n_values"), (F.lit(len(support)) - F.sum(F.col(value).isin(*support).cast("long"))).alias("missing"),
        (F.max("n") - F.min("n")).alias("gap"), ((F.max("n") - F.min("n") <= most_gap) & (F.count("*") == len(support))).alias("balanced"),
    )


def preference_credit(margin: Column) -> Column:
    return F.when(margin > 1e-7, 1.0).when(margin < -1e-7, 0.0).otherwise(0.5)
