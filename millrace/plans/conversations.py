"""The conversation dataset: candidates, selection by quota, audit, and repair against an evaluation set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.functions import text as T
from millrace.operators import contamination as C
from millrace.operators import conversations as V
from millrace.operators import dedup as D
from millrace.operators import metrics as M
from millrace.operators import ordered as W
from millrace.session import written


def candidates(messages: DataFrame, most: int, rate: float = 1.0, seed: str = "sft") -> DataFrame:
    """conv_id, first_turn, last_turn, chars, prompt, split, rank: one chunk of whole turns of each sampled, valid conversation.

    A conversation is sampled by its id's hash before anything of it is read; its split follows from its prompt's.
    """
    identity = lambda tag: H.sha256(F.concat(F.lit(f"{seed}:{tag}:"), F.col("conv_id").cast("string")))
    sampled = messages.where(H.unit_less_than(identity("sample"), rate))
    nested = V.nest(sampled).withColumn("messages", V.canonical(F.col("messages")))
    valid = nested.where(V.rejection(F.col("messages")).isNull()).select("conv_id", T.ws_lower(V.prompt(F.col("messages"))).alias("prompt"))
    rows = sampled.join(valid.select("conv_id"), "conv_id", "left_semi")
    chunks = V.choose_chunk(V.turn_chunks(rows, most), "conv_id", F.concat_ws("|", F.col("conv_id").cast("string"), F.col("chunk").cast("string")))
    return chunks.drop("chunk").join(valid, "conv_id").withColumn("split", H.prompt_split(H.sha256(F.col("prompt")))).withColumn("rank", identity("rank"))


def select(rows: DataFrame, quota: Column, bucket: str | None = None) -> DataFrame:
    """Candidates in rank order, one for each prompt, until every split (and bucket) has its quota of characters."""
    distinct = D.exact_first(rows, H.sha256(F.col("prompt")), "rank")
    return W.grouped_quota(distinct, ["split", *([bucket] if bucket else [])], ["rank", "conv_id"], "chars", quota)


def audit(rows: DataFrame) -> DataFrame:
    """gate, passed: prompts are unique, no prompt is in two splits, and every row has characters."""
    per = rows.groupBy("prompt").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s"), F.min("chars").alias("least"))
    one = per.agg(F.max("n").alias("n"), F.max("s").alias("s"), F.min("least").alias("least"))
    return M.gates(one, {"unique_prompts": F.col("n") == 1, "one_split": F.col("s") == 1, "filled": F.col("least") > 0})


def repair(pool: DataFrame, chosen: DataFrame, items: DataFrame, quota: Column) -> DataFrame:
    """The selection without rows that meet the evaluation set, topped up in rank order from the clean rest of the pool.

    Rows that stay keep their place: the refill is a selection over what is clean, in which they come first.
    """
    keyed = pool.select(F.col("conv_id").alias("key"), "prompt")
    # written once: the selection reads its rows twice
    bad = written(C.guard(keyed, items).select(F.col("key").alias("conv_id")))
    clean = pool.join(bad, "conv_id", "left_anti")
    kept = chosen.select("conv_id").withColumn("kept__", F.lit("0"))
    order = F.concat(F.coalesce("kept__", F.lit("1")), "rank")
    return select(clean.join(kept, "conv_id", "left").withColumn("rank", order).drop("kept__"), quota).withColumn("rank", F.expr("substr(rank, 2)"))
