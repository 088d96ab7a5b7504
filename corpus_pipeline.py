"""The corpus pipeline: documents to packed training sequences, in five stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet in the
shared folder and read again. All but the last return the columns of documents. A stage drops whole rows or rewrites
text; it never drops a clean document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, neardup, packing, pii
from millrace.llm.common import set_aside
from millrace.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; those without letters or far from every language go."""
    rows, back = set_aside(docs, "lang_pred", "score", "cross_entropy", "rejected")
    return langid.identify(rows, langid.train(docs)).where("not rejected").select(*back.values())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near-duplicates."""
    return neardup.deduplicated(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars follows the text."""
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of all documents."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", contamination),
    ("pii", personal_data),
    ("packing", pack),
]

#: Trained models and a tokenizer decide; SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i + 1 < len(STAGES):
            rows = written(rows, spark)
    return rows
