"""Rows by source: statistics of pretraining and conversation sources, behaviour summaries, record texts, origin claims, re-fetched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.functions import text as T
from millrace.operators.profile import histogram, nearest_rank

#: Fixed openings of a refusal.
REFUSALS = ("i cannot", "i can't", "i'm sorry", "i am sorry", "as an ai", "抱歉", "无法")


def pretrain_source_stats(rows: DataFrame, source: str, text: str, tokens: Column, length: int) -> DataFrame:
    """By source: rows, empty rows, raw and kept tokens, truncated rows and their share. A row keeps length - 2 tokens."""
    counted = rows.select(source, T.is_blank(F.col(text)).alias("blank"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n"))
    kept = F.least(F.col("n"), F.lit(length - 2).cast("long"))
    cut = (F.col("n") > length - 2).cast("long")
    return counted.groupBy(source).agg(
        F.count("*").alias("n_rows"), F.sum(F.col("blank").cast("long")).alias("empty_rows"), F.sum("n").alias("raw_tokens"),
        F.sum(kept).alias("kept_tokens"), F.sum(cut).alias("truncated_rows"), F.avg(cut).alias("truncation_rate"),
    )


def conversation_source_stats(messages: DataFrame, source: Column, length: int) -> DataFrame:
    """By source of messages (conv_id, role, text): conversations, input and target tokens (characters), those without a target and those too long."""
    size = F.length("text")
    per = messages.groupBy("conv_id").agg(F.sum(size).alias("n"), F.sum(F.when(F.col("role") == "assistant", size).otherwise(0)).alias("t"))
    return per.withColumn("source", source).groupBy("source").agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("input_tokens"), F.sum("t").alias("target_tokens"),
        F.sum((F.col("t") == 0).cast("long")).alias("zero_target_rows"), F.sum((F.col("n") > length).cast("long")).alias("truncated_rows"),
    )


def behaviour_summary(answers: DataFrame, text: str, latency: str, most_repetition: float = 0.3) -> DataFrame:
    """One row: shares of answers that are empty, refuse or repeat themselves, and nearest-rank percentiles of the latency."""
    low = F.lower(F.trim(F.col(text)))
    refuses = F.lit(False)
    for opening in REFUSALS:
        refuses = refuses | low.startswith(opening)
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    rates = answers.agg(F.count("*").alias("n"), rate(T.is_blank(F.col(text))).alias("empty_rate"), rate(refuses).alias("refusal_rate"), rate(T.repetition_ratio(F.col(text)) > most_repetition).alias("repetition_rate"))
    return rates.join(nearest_rank(histogram(answers.where(F.col(latency).isNotNull()), latency), latency, {"p50": 0.5, "p95": 0.95}), F.lit(True))  # one row each


def record_text(kind: Column, text: Column, question: Column, answer: Column, messages: Column) -> Column:
    """The text of a record by its kind: plain text, question and answer, or all contents of a conversation."""
    pair = F.concat_ws("\n", question, answer)
    return F.when(kind == "conversation", F.array_join(F.transform(messages, lambda m: m["content"]), "\n")).when(kind == "qa", pair).otherwise(text)


def claimed(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """candidates whose (origin, variant) is claimed by their own source; a variant of an origin belongs to one source only."""
    return candidates.join(claims.select("origin", "variant", F.col("source").alias("owner__")), ["origin", "variant"]).where(F.col("source") == F.col("owner__")).drop("owner__")


def refetched(provenance: DataFrame, rows: DataFrame) -> DataFrame:
    """line, record, status of each line that provenance (line, sha256) names: found, changed or missing in rows (line, record)."""
    met = provenance.join(rows, "line", "left")
    status = F.when(F.col("record").isNull(), "missing").when(H.sha256(F.col("record")) != F.col("sha256"), "changed").otherwise("found")
    return met.select("line", F.when(status == "found", F.col("record")).alias("record"), status.alias("status"))


def resumed(batches: DataFrame, done: int, batch: str = "batch") -> DataFrame:
    """The batches that are left after the first done ones."""
    return batches.where(F.col(batch) >= done)


def tool_messages(prompt: Column, tools: Column, calls: Column, results: Column, final: Column) -> Column:
    """A tool conversation: the schemas in the system message, the prompt, each call (JSON) with its result, and the final answer."""
    said = lambda role, content, call=None: F.struct(F.lit(role).alias("role"), content.alias("content"), (F.lit(None).cast("string") if call is None else call).alias("tool_calls"))
    steps = F.flatten(F.zip_with(calls, results, lambda c, r: F.array(said("assistant", F.lit(""), c), said("tool", r))))
    return F.concat(F.array(said("system", tools), said("user", prompt)), steps, F.array(said("assistant", final)))


def expected_chain(families: dict[str, list[str]], family: Column, calls: Column) -> Column:
    """Whether the names of calls are the chain that the family expects; an unknown family expects none."""
    chains = F.create_map(*[x for k, v in families.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return calls == F.coalesce(F.try_element_at(chains, family), F.array().cast("array<string>"))
