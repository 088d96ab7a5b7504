"""Compositions: mixing sources to exact quotas, auditing a corpus, and the evidence that binds them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.operators import contamination as C
from millrace.operators import dedup as D
from millrace.operators import ordered as W
from millrace.session import written


def quotas(weights: dict[str, float], total: int) -> dict[str, int]:
    """Largest remainder over a short list of sources."""
    names = sorted(weights)
    whole = sum(weights.values())
    raw = {n: total * (weights[n] / whole) for n in names}
    out = {n: int(raw[n]) for n in names}
    for n in sorted(names, key=lambda n: (raw[n] - out[n], n), reverse=True)[: total - sum(out.values())]:
        out[n] += 1
    return out


def mix(docs: DataFrame, weights: dict[str, float], train: int, validation: int, shards: int, seed: str = "mix", benchmark: DataFrame | None = None) -> DataFrame:
    """doc_id, source, split, taken, shard: exact character quotas of each source, train first.

    Sources come one after another, as a text that an earlier source or split has taken is barred from later ones,
    while texts passed over bar nothing. With a benchmark, contaminated documents are barred first.
    """
    rows = docs.select("doc_id", "source", "text", F.length("text").cast("long").alias("tokens"), H.sha256(F.col("text")).alias("content"))
    if benchmark is not None:
        rows = rows.join(C.ledger(docs, benchmark, []).select("doc_id").distinct(), "doc_id", "left_anti")
    rows = written(rows.drop("text"))
    seen = None
    chosen = None
    for split, total in (("train", train), ("validation", validation)):
        for source, quota in quotas(weights, total).items():
            left = rows.where(F.col("source") == source)
            left = left if seen is None else D.unseen(left, seen, ["content"])
            order = H.sha256(F.concat(F.lit(f"{seed}:{split}:"), F.col("doc_id").cast("string")))
            left = D.exact_first(left.withColumn("order", F.concat_ws(":", order, F.col("doc_id").cast("string"))), F.col("content"), "order")
            took = written(W.quota_prefix(left, ["order"], "tokens", quota).withColumn("split", F.lit(split)))
            got = took.agg(F.sum("taken")).first()[0] or 0
            if got != quota:
                raise ValueError(f"{split} of {source} is short: {got} of {quota}")
            chosen = took if chosen is None else chosen.unionByName(took)
            seen = took.select("content") if seen is None else seen.unionByName(took.select("content"))
    key = H.sha256(F.concat(F.lit(f"{seed}:shard:"), "split", F.lit(":"), F.col("doc_id").cast("string")))
    out = None
    for split, n in (("train", shards), ("validation", 1)):
        part = W.round_robin(chosen.where(F.col("split") == split).withColumn("key", key), ["key"], n)
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "source", "split", "taken", "shard")


def audit(docs: DataFrame, benchmark: DataFrame, length: int) -> DataFrame:
    """One row: sizes, duplicates, token accounting and contaminated documents."""
    kept = F.least(F.length("text"), F.lit(length - 2))
    per = docs.groupBy(H.sha256(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.sum(kept + 1).alias("t"))
    base = per.agg(F.sum("n").alias("n_rows"), F.count("h").alias("n_distinct"), F.sum("t").alias("loss_tokens"))
    events = C.ledger(docs, benchmark, [])
    per_reason = events.groupBy("reason").agg(F.count("*").alias("n"))
    sums = per_reason.agg(*[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(c) for r, c in (("exact", "exact_docs"), ("containment", "contained_docs"), ("empty_text", "empty_docs"))])
    return base.join(sums, F.lit(True))  # one row each


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def manifest(parts: dict[str, Any]) -> dict[str, Any]:
    """The parts with a digest that binds them; the digest covers everything but itself."""
    return parts | {"sha256": hashlib.sha256(canonical_json(parts).encode()).hexdigest()}


def bound(record: dict[str, Any]) -> bool:
    return manifest({k: v for k, v in record.items() if k != "sha256"})["sha256"] == record.get("sha256")


def accept(record: dict[str, Any], gates: DataFrame) -> dict[str, Any]:
    """The record with its gates, once all of them passed; else an error that names those that did not."""
    rows = {r["gate"]: r["passed"] for r in gates.collect()}  # one row a gate
    if failed := sorted(g for g, ok in rows.items() if not ok):
        raise ValueError(f"gates failed: {', '.join(failed)}")
    return manifest(record | {"gates": rows})


def write_metrics(metrics: DataFrame, path: str, keys: list[str]) -> None:
    """A small table of measures as one CSV file with a header, long: keys, metric, value."""
    numbers = [c for c in metrics.columns if c not in keys]
    rows = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(keys, numbers, "metric", "value")
    rows.coalesce(1).sortWithinPartitions(*keys, "metric").write.mode("errorifexists").csv(path, header=True)


def reused(spark: SparkSession, path: str, fingerprint: dict[str, Any], build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was built whole from the same fingerprint, else build()'s rows, written there.

    The marker beside the table is written last and holds the fingerprint's digest and the number of rows.
    """
    want = manifest(fingerprint)["sha256"]
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    marker, table = fs_path(f"{path}/done"), f"{path}/rows"
    store = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(marker):
        done = json.loads(spark.read.text(f"{path}/done").first()[0])
        if done["fingerprint"] == want and spark.read.parquet(table).count() == done["rows"]:
            return spark.read.parquet(table)
    store.delete(fs_path(path), True)
    build().write.parquet(table)
    made = spark.read.parquet(table)
    record = canonical_json({"fingerprint": want, "rows": made.count()})
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.text(f"{path}/done")
    return made


def materialize(sources: dict[str, DataFrame], rates: dict[str, float], length: int, seed: str = "pool") -> DataFrame:
    """The candidate pool of all sources: source, doc_id, chunk, text, tokens, rank, digest.

    Blank rows go; a source's rows are sampled by the hash of their id before their text is read, cut into chunks of
    length - 2 characters, and ranked by hash.
    """
    from millrace.functions import text as T
    from millrace.operators.reshape import code_point_chunks

    out = None
    for name, rows in sorted(sources.items()):
        identity = H.sha256(F.concat(F.lit(f"{seed}:{name}:"), F.col("doc_id").cast("string")))
        rows = rows.select("doc_id", "text").where(H.unit_less_than(identity, rates.get(name, 1.0))).where(~T.is_blank(F.col("text")))
        pieces = code_point_chunks(rows, "text", length - 2)
        rank = H.sha256(F.concat_ws(":", F.lit(seed), F.lit(name), F.col("doc_id").cast("string"), F.col("chunk").cast("string")))
        pool = pieces.select(F.lit(name).alias("source"), "doc_id", "chunk", F.col("piece").alias("text"), F.length("piece").cast("long").alias("tokens"), rank.alias("rank"), H.sha256(F.col("piece")).alias("digest"))
        out = pool if out is None else out.unionByName(pool)
    return out
