"""Table-valued generators: seeded tasks as cross products of ranges, chosen by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import bucket, sha256

OPS = ("add", "sub", "mul")


def expected(op: Column, a: Column, b: Column) -> Column:
    return F.when(op == "add", a + b).when(op == "sub", a - b).otherwise(a * b)


def pool(spark: SparkSession, below: int, ops: tuple[str, ...] = OPS) -> DataFrame:
    """op, a, b for all operands below a bound: positions of one range, without a join."""
    rows = spark.range(below * below * len(ops))
    names = F.array(*[F.lit(x) for x in ops])
    return rows.select(
        F.element_at(names, (F.floor(F.col("id") / (below * below)) + 1).cast("int")).alias("op"),
        (F.floor(F.col("id") / below) % below).cast("long").alias("a"), (F.col("id") % below).alias("b"),
    )


def _identity(seed: str) -> Column:
    return sha256(F.concat(F.lit(seed), F.concat_ws(":", "op", F.col("a").cast("string"), F.col("b").cast("string"))))


def mod10_tasks(spark: SparkSession, below: int, per_answer: int, seed: str) -> DataFrame:
    """op, a, b, answer: per_answer tasks for each operation and last digit, by least hash."""
    rows = pool(spark, below).withColumn("answer", F.pmod(expected(F.col("op"), F.col("a"), F.col("b")), F.lit(10)))
    w = Window.partitionBy("op", "answer").orderBy("h__")
    return rows.withColumn("h__", _identity(seed)).withColumn("k__", F.row_number().over(w)).where(F.col("k__") <= per_answer).drop("h__", "k__")


def choice_tasks(spark: SparkSession, below: int, n: int, seed: str) -> DataFrame:
    """op, a, b, options, answer: n tasks by least hash; the right option's place cycles, so places are balanced.

    Wrong options are the right value shifted by distinct hashed amounts.
    """
    rows = pool(spark, below).withColumn("h__", _identity(seed)).orderBy("h__").limit(n)
    rows = rows.withColumn("k__", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h__")) - 1)  # n rows
    right = expected(F.col("op"), F.col("a"), F.col("b"))
    shift = bucket(F.col("h__"), 7) + 1
    wrong = F.array(right + shift, right - shift, right + shift + 1)
    place = (F.col("k__") % 4).cast("int")
    options = F.concat(F.slice(wrong, F.lit(1), place), F.array(right), F.slice(wrong, place + 1, 3 - place))
    return rows.select("op", "a", "b", options.alias("options"), F.substring(F.lit("ABCD"), place + 1, F.lit(1)).alias("answer"))


def extract_tasks(spark: SparkSession, n: int, seed: str, templates: list[str]) -> DataFrame:
    """prompt, answer: unique digit strings and the digit at a hashed place, over templates with {digits} and {place}."""
    h = sha256(F.concat(F.lit(seed), F.col("id").cast("string")))
    digits = F.substring(F.regexp_replace(h, "[^0-9]", ""), 1, 8)
    rows = spark.range(n * 2).select("id", h.alias("h"), digits.alias("d")).where(F.length("d") == 8)
    place = (bucket(F.col("h"), 8) + 1).cast("int")
    text = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("id") % len(templates) + 1).cast("int"))
    prompt = F.replace(F.replace(text, F.lit("{digits}"), F.col("d")), F.lit("{place}"), place.cast("string"))
    return rows.select("id", prompt.alias("prompt"), F.substring(F.col("d"), place, F.lit(1)).alias("answer")).dropDuplicates(["prompt"]).orderBy("id").limit(n).drop("id")


def format_tasks(spark: SparkSession, n: int, seed: str) -> DataFrame:
    """kind, prompt, answer: seeded JSON, CSV, XML and bullet tasks whose answers are exact."""
    h = sha256(F.concat(F.lit(seed), F.col("id").cast("string")))
    name, age = F.concat(F.lit("item"), F.substring(h, 1, 4)), (bucket(h, 90) + 10).cast("string")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("json", "csv", "xml", "bullets")]), (F.col("id") % 4 + 1).cast("int"))
    answer = (
        F.when(kind == "json", F.concat(F.lit('{"name":"'), name, F.lit('","value":'), age, F.lit("}")))
        .when(kind == "csv", F.concat(F.lit("name,value\n"), name, F.lit(","), age))
        .when(kind == "xml", F.concat(F.lit("<item><name>"), name, F.lit("</name><value>"), age, F.lit("</value></item>")))
        .otherwise(F.concat(F.lit("- "), name, F.lit("\n- "), age))
    )
    return spark.range(n).select(kind.alias("kind"), F.concat(F.lit("Write name "), name, F.lit(" and value "), age, F.lit(" as "), kind, F.lit(".")).alias("prompt"), answer.alias("answer"))
