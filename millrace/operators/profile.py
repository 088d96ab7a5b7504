"""Corpus profiles: counters, histograms, percentiles, token accounting and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


def histogram(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """value and freq; the counts combine before the shuffle, so percentiles never sort the rows."""
    return df.groupBy(*(groups or []), value).agg(F.count("*").alias("freq"))


def nearest_rank(hist: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles (rank ceil(p n), 1 at least) of a histogram: one row."""
    w = Window.partitionBy(F.lit(0)).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = hist.agg(F.sum("freq").alias("total"))
    rows = hist.select(value, "freq", F.sum("freq").over(w).alias("upto")).join(F.broadcast(total), F.lit(True))
    picks = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * p), F.lit(1)), F.col(value))).alias(name) for name, p in fractions.items()]
    return rows.agg(*picks)


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, sum, min, max, mean and nearest-rank p50, p90, p95 and p99, from the histogram."""
    hist = histogram(df.where(F.col(value).isNotNull()), value)
    base = hist.agg(F.sum("freq").alias("count"), F.sum(F.col(value) * F.col("freq")).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    base = base.withColumn("mean", F.col("sum") / F.col("count"))
    return base.join(nearest_rank(hist, value, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}), F.lit(True))


def ranked(hist: DataFrame, value: str, rank: Column) -> DataFrame:
    """The value at a zero-based rank, an expression over the column total: one row, column value."""
    w = Window.partitionBy(F.lit(0)).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = hist.agg(F.sum("freq").alias("total"))
    rows = hist.select(value, F.sum("freq").over(w).alias("upto")).join(F.broadcast(total), F.lit(True))
    return rows.agg(F.min(F.when(F.col("upto") > rank, F.col(value))).alias("value"))


def percentile_variants(df: DataFrame, value: str, p: float) -> DataFrame:
    """Five readings of one percentile, which differ by their rank: one row."""
    hist = histogram(df.where(F.col(value).isNotNull()), value)
    n = F.col("total")
    variants = {
        "ceil_rank": F.greatest(F.ceil(n * p) - 1, F.lit(0)),
        "floor_index": F.least(F.floor(n * p), n - 1),
        "bankers_index": F.bround((n - 1) * p),
    }
    out = None
    for name, rank in variants.items():
        one = ranked(hist, value, rank).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, F.lit(True))
    # linear between the two neighbours, and the next observed value
    low = ranked(hist, value, F.floor((n - 1) * p)).withColumnRenamed("value", "low__")
    high = ranked(hist, value, F.ceil((n - 1) * p)).withColumnRenamed("value", "high__")
    total = hist.agg(F.sum("freq").alias("total"))
    rows = out.join(low, F.lit(True)).join(high, F.lit(True)).join(total, F.lit(True))
    part = (F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p)
    return rows.withColumn("linear", F.col("low__") + (F.col("high__") - F.col("low__")) * part).withColumn("higher", F.col("high__")).drop("low__", "high__", "total")


def length_summary(df: DataFrame, length: str, most: int) -> DataFrame:
    """min, p50, p95, max and mean length, share truncated at most, and mean padding up to it."""
    hist = histogram(df, length)
    n = F.sum("freq")
    base = hist.agg(
        F.min(length).alias("min"), F.max(length).alias("max"), (F.sum(F.col(length) * F.col("freq")) / n).alias("mean"),
        (F.sum(F.when(F.col(length) > most, F.col("freq")).otherwise(0)) / n).alias("truncated"),
        (F.sum(F.greatest(F.lit(most) - F.col(length), F.lit(0)) * F.col("freq")) / n).alias("padding"),
    )
    return base.join(nearest_rank(hist, length, {"p50": 0.5, "p95": 0.95}), F.lit(True))


def token_accounting(df: DataFrame, tokens: str, length: int, groups: list[str] | None = None) -> DataFrame:
    """Rows, raw and kept tokens, loss targets, padded slots, truncated rows and discarded tails at a sequence length.

    A row keeps length - 2 tokens between begin and end; it has one target more than tokens kept.
    """
    kept = F.least(F.col(tokens), F.lit(length - 2))
    return df.groupBy(*(groups or [])).agg(
        F.count("*").alias("n_rows"), F.sum(tokens).alias("raw_tokens"), F.sum(kept).alias("kept_tokens"), F.sum(kept + 1).alias("loss_tokens"),
        F.sum(kept + 2).alias("nonpad_tokens"), (F.count("*") * length).alias("padded_slots"), F.sum((F.col(tokens) > length - 2).cast("long")).alias("truncated_rows"),
        F.sum(F.col(tokens) - kept).alias("discarded_tokens"),
    )


def recount(hist: DataFrame, tokens: str, lengths: list[int]) -> DataFrame:
    """The accounting at other sequence lengths from a histogram of token counts alone."""
    rows = hist.select(tokens, "freq", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("sequence_length"))
    kept = F.least(F.col(tokens), F.col("sequence_length") - 2)
    return rows.groupBy("sequence_length").agg(
        F.sum((kept + 1) * F.col("freq")).alias("loss_tokens"), F.sum(F.when(F.col(tokens) > F.col("sequence_length") - 2, F.col("freq")).otherwise(0)).alias("truncated_rows"),
        F.sum(F.col("freq") * F.col("sequence_length")).alias("padded_slots"),
    )


def top_tokens(df: DataFrame, ids: Column, k: int) -> DataFrame:
    """The k most frequent items of an array column, ties by the smaller item."""
    return df.select(F.explode(ids).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(k)


def scripts(df: DataFrame, text: str, groups: list[str] | None = None) -> DataFrame:
    """Characters of each script in normalised text, and rows that hold them."""
    n = T.alnum_lower(F.col(text))
    cjk, latin, digit = T.count_class(n, T.CJK), T.count_class(n, "a-z"), T.count_class(n, r"\p{Nd}")
    rows = df.select(*(groups or []), cjk.alias("c"), latin.alias("l"), digit.alias("d"), F.length(n).alias("t"))
    has = {"rows_with_cjk": F.col("c") > 0, "rows_with_latin": F.col("l") > 0, "rows_with_both": (F.col("c") > 0) & (F.col("l") > 0)}
    sums = {"cjk_chars": F.col("c"), "latin_chars": F.col("l"), "digit_chars": F.col("d"), "other_chars": F.col("t") - F.col("c") - F.col("l") - F.col("d")}
    return rows.groupBy(*(groups or [])).agg(*[F.sum(v).alias(k) for k, v in sums.items()], *[F.sum(v.cast("long")).alias(k) for k, v in has.items()])


def levels(df: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """Totals by every set of keys in one pass (grouping sets); level names the keys that a row is by."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    level = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(level.alias("level"), *measures)


def many_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value, and how many."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def capacity(layer: DataFrame, weights: DataFrame, total: int, bucket: str = "bucket", tokens: str = "tokens") -> DataFrame:
    """target, available, ratio and shortfall by bucket."""
    have = layer.groupBy(bucket).agg(F.sum(tokens).alias("available"))
    rows = weights.join(have, bucket, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    target = F.bround(F.lit(float(total)) * F.col("weight")).cast("long")
    return rows.select(bucket, target.alias("target"), "available", F.when(target > 0, F.col("available") / target).alias("ratio"), F.greatest(F.lit(0).cast("long"), target - F.col("available")).alias("shortfall"))


def fingerprint(df: DataFrame, fields: list[str]) -> DataFrame:
    """SHA-256 over the rows in order, a line each, of a list of files.

    One digest over all lines is sequential by definition: the sorted rows stream through the driver, a range at a time,
    and neither a task nor the driver ever holds all of them.
    """
    import hashlib

    row = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in fields])
    state, first = hashlib.sha256(), True
    for batch in df.select(row.alias("r")).orderBy("r").toLocalIterator(prefetchPartitions=False):
        state.update(("" if first else "\n").encode() + batch["r"].encode())
        first = False
    return df.sparkSession.createDataFrame([(state.hexdigest(),)], "fingerprint string")
