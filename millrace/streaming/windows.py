"""Windows over event time, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, keys: tuple[str, ...] = ("event_type",), late: str = "1 day") -> DataFrame:
    """start, keys, n and total of each window; a stream drops events later than late."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str = "1 day") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of each key; a stream forgets keys after late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
