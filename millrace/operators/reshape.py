"""Chunking, explosion and flattening."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_point_chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """df with chunk (from 0) and piece: runs of size characters; the tail is kept, empty text has none."""
    rows = df.where(F.length(text) > 0)
    places = F.sequence(F.lit(0).cast("long"), F.floor((F.length(text) - 1) / size))
    return rows.withColumn("chunk", F.explode(places)).withColumn("piece", F.substring(F.col(text), (F.col("chunk") * size + 1).cast("int"), F.lit(size))).drop(text)


def token_chunks(df: DataFrame, text: str, size: int, vocabulary: str) -> DataFrame:
    """doc_id, chunk, piece, n: runs of at most size tokens of a tokenizers file that encode again to no more than size.

    A run is shortened by a token at a time until its decoded text does; the tail is kept.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        for batch in batches:
            out = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, at, k = encode(body or ""), 0, 0
                while at < len(ids):
                    n = min(size, len(ids) - at)
                    piece = tokenizer.decode(ids[at : at + n], skip_special_tokens=False)
                    while n > 1 and len(encode(piece)) > size:
                        n -= 1
                        piece = tokenizer.decode(ids[at : at + n], skip_special_tokens=False)
                    out.append((doc_id, k, piece, n))
                    at, k = at + n, k + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "chunk", "piece", "n"])

    return df.select("doc_id", text).mapInArrow(run, "doc_id bigint, chunk bigint, piece string, n bigint")


def nested_files(df: DataFrame, files: str) -> DataFrame:
    """One row a nested file with its index; rows without files give none."""
    return df.select("*", F.posexplode(files).alias("file_index", "file")).drop(files)


def first_present(*columns: Column) -> Column:
    return F.coalesce(*columns)


def flat_metrics(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, name, value of every finite number in a JSON object; names join the path by "/", two-element arrays give lower and upper."""
    tree = df.select(key, F.try_parse_json(json).alias("v"))
    level, out = tree.select(key, F.lit("").alias("name"), "v"), None
    while out is None or not level.isEmpty():
        level.createOrReplaceTempView("millrace_metric_level")
        step = level.sparkSession.sql(
            f"select l.`{key}`, concat(l.name, case when l.name = '' then '' else '/' end, coalesce(e.key, case e.pos when 0 then 'lower' else 'upper' end)) as name, e.value as v, schema_of_variant(e.value) as kind "
            "from millrace_metric_level l, lateral variant_explode(l.v) e"
        )
        numbers = step.where("kind rlike '^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)'").select(key, "name", F.expr("try_variant_get(v, '$', 'double')").alias("value"))
        numbers = numbers.where(~F.isnan("value") & (F.abs("value") < float("inf")))
        out = numbers if out is None else out.unionByName(numbers)
        level = step.where("kind rlike '^(OBJECT|ARRAY)'").select(key, "name", "v")
    return out


def translation_pairs(df: DataFrame, left: str, right: str, ask: dict[str, str]) -> DataFrame:
    """Two aligned fields as up to two instruction pairs; missing or equal sides give none."""
    rows = df.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.trim(left) != F.trim(right)))
    both = F.array(
        F.struct(F.concat(F.lit(ask["forth"]), F.col(left)).alias("user"), F.col(right).alias("assistant")),
        F.struct(F.concat(F.lit(ask["back"]), F.col(right)).alias("user"), F.col(left).alias("assistant")),
    )
    return rows.select("*", F.explode(both).alias("p")).select(*df.columns, "p.user", "p.assistant")


def instruction_pairs(df: DataFrame, instruction: str, context: str | None, answer: str, glue: str = "\n") -> DataFrame:
    """messages: a user's instruction (and context) and the assistant's answer; rows with an empty side give none."""
    ask = F.trim(F.col(instruction))
    if context:
        ask = F.when(F.trim(F.coalesce(F.col(context), F.lit(""))) != "", F.concat(ask, F.lit(glue), F.trim(context))).otherwise(ask)
    rows = df.where((F.trim(F.coalesce(F.col(instruction), F.lit(""))) != "") & (F.trim(F.coalesce(F.col(answer), F.lit(""))) != ""))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.withColumn("messages", F.array(message("user", ask), message("assistant", F.trim(answer))))
