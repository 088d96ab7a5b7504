"""Readers: Parquet text, gzip JSON lines, verified and profiled line files, and the names of source objects."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.text import is_blank


def parquet_text(spark: SparkSession, path: str | list[str], text: str, more: list[str] | None = None) -> DataFrame:
    """Only the named columns of Parquet files; a missing one is an error."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    columns = [text, *(more or [])]
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return df.select(*columns)


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """JSON lines, plain or gzip; the first line that is no object of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Names of formats and the reader of each.
FORMATS = {"parquet": "parquet", "jsonl": "json", "jsonl_gzip": "json", "jsonl.gz": "json", "gzip_jsonl": "json"}


def source_rows(spark: SparkSession, path: str, fmt: str, text: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    return parquet_text(spark, path, text) if FORMATS[fmt] == "parquet" else json_lines(spark, path, f"`{text}` string").where(F.col(text).isNotNull())


def object_uri(endpoint: str, source: dict[str, Any], item: dict[str, Any]) -> str:
    """An object's address: its url, else its absolute path, else its place in the hub's repository."""
    if url := item.get("url"):
        return url
    path = str(item["path"])
    if "://" in path or path.startswith("/"):
        return path
    return f"{endpoint.rstrip('/')}/datasets/{source['repo_id']}/resolve/{source['revision']}/{path}"


def safe_name(value: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", value).strip("-")


def object_identity(source: dict[str, Any], item: dict[str, Any], index: int) -> str:
    return safe_name(f"{source['id']}-{index:05d}-{item.get('path') or item.get('url')}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value (bytes) and file of every physical line, bytes untouched."""
    return spark.read.format("text").load(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"))


def line_class(value: Column, text: str = "text") -> Column:
    """What a physical line is: blank, invalid_json, invalid_schema, empty or valid."""
    body = F.get_json_object(value, f"$.{text}")
    is_object = F.substring(F.trim(value), 1, 1) == "{"
    parsed = F.try_parse_json(value)
    return (
        F.when(is_blank(value), "blank").when(parsed.isNull(), "invalid_json").when(~is_object | body.isNull(), "invalid_schema").when(is_blank(body), "empty").otherwise("valid")
    )


def quality_scan(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """file, class, n over all physical lines."""
    return lines(spark, path).groupBy("file", line_class(F.col("value"), text).alias("class")).agg(F.count("*").alias("n"))


def strict_profile(spark: SparkSession, path: str, required: list[str]) -> dict[str, Any]:
    """Rows, bytes and the union of top-level fields; any line that is no object, or a required field never seen, is an error."""
    rows = lines(spark, path).select("value", F.json_object_keys("value").alias("keys"))
    row = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("value")).alias("bytes"), F.sum(F.col("keys").isNull().cast("long")).alias("bad")).first()
    if row["bad"] or not row["rows"]:
        raise ValueError(f"{path}: {row['bad'] or 0} of {row['rows']} lines are no objects")
    fields = sorted(r[0] for r in rows.select(F.explode("keys")).distinct().collect())  # field names, not rows
    if missing := set(required) - set(fields):
        raise ValueError(f"{path}: missing {', '.join(sorted(missing))}")
    return {"rows": row["rows"], "bytes": row["bytes"], "fields": fields}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Expected name, bytes and sha256 against what is there: name, ok."""
    name = F.element_at(F.split("path", "/"), -1)
    found = file_digests(spark, path).select(name.alias("name"), F.col("bytes").alias("b__"), F.col("sha256").alias("s__"))
    rows = expected.join(found, "name", "full_outer")
    return rows.select("name", F.coalesce((F.col("bytes") == F.col("b__")) & (F.col("sha256") == F.col("s__")), F.lit(False)).alias("ok"))


def gated(df: DataFrame, expected_rows: int) -> DataFrame:
    """df, once its row count is what it should be."""
    if (n := df.count()) != expected_rows:
        raise ValueError(f"{n} rows, expected {expected_rows}")
    return df


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that the patterns match, on any file system that Spark reads: sorted and each once. A pattern without files is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: set[str] = set()
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        files = [x.getPath().toString() for x in (path.getFileSystem(conf).globStatus(path) or []) if x.isFile()]
        if not files:
            raise FileNotFoundError(f"no files match {pattern}")
        found.update(files)
    return sorted(found)
