"""The conversation build on the driver's tables; reuse, metrics, globs and tool conversations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import records
from millrace.plans import conversations as plan
from millrace.plans import corpus
from millrace.sources import readers


def test_build_and_repair(spark, sf):
    messages = spark.read.parquet(f"{sf}/conversations.parquet")
    pool = plan.candidates(messages, 4000)
    everything = plan.select(pool, F.lit(10**9))
    assert {r["gate"]: r["passed"] for r in plan.audit(everything).collect()} == {"unique_prompts": True, "one_split": True, "filled": True, "all": True}
    chosen = plan.select(pool, F.lit(3000))
    totals = {r["split"]: r["n"] for r in chosen.groupBy("split").agg(F.sum("chars").alias("n")).collect()}
    ids = {r["conv_id"] for r in chosen.collect()}
    assert ids and totals["train"] >= 3000
    taken = chosen.orderBy("rank").first()
    items = spark.createDataFrame([(1, taken["prompt"])], "item_id long, prompt string")
    fixed = {r["conv_id"] for r in plan.repair(pool, chosen, items, F.lit(3000)).collect()}
    assert taken["conv_id"] not in fixed and ids - {taken["conv_id"]} <= fixed and len(fixed) >= len(ids)


def test_reuse_depends_on_the_fingerprint(spark, tmp_path):
    built = []

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    path = f"file://{tmp_path}/pool"
    assert corpus.reused(spark, path, {"seed": 1}, build(3)).count() == 3
    assert corpus.reused(spark, path, {"seed": 1}, build(4)).count() == 3 and built == [3]
    assert corpus.reused(spark, path, {"seed": 2}, build(5)).count() == 5 and built == [3, 5]


def test_metrics_as_one_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2.5), ("b", None, 4.0)], "name string, n long, x double")
    corpus.write_metrics(rows, f"{tmp_path}/m", ["name"])
    files = list(tmp_path.glob("m/*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines() == ["name,metric,value", "a,n,1.0", "a,x,2.5", "b,n,", "b,x,4.0"]


def test_glob_is_sorted_and_unique(spark, tmp_path):
    for name in ("b.json", "a.json", "c.txt"):
        (tmp_path / name).write_text("{}")
    got = readers.expand(spark, [f"{tmp_path}/*.json", f"{tmp_path}/a.*"])
    assert [g.rsplit("/", 1)[1] for g in got] == ["a.json", "b.json"]
    with pytest.raises(FileNotFoundError):
        readers.expand(spark, [f"{tmp_path}/*.csv"])


def test_tool_messages_and_chains(spark):
    df = spark.createDataFrame([("ask", "[]", ["c1", "c2"], ["r1", "r2"], "end", "two"), ("ask", "[]", [], [], "end", "none")], "p string, t string, c array<string>, r array<string>, f string, k string")
    chain = records.expected_chain({"two": ["c1", "c2"], "one": ["c1"]}, F.col("k"), F.col("c"))
    rows = df.select(records.tool_messages(*[F.col(x) for x in "ptcrf"]).alias("m"), chain.alias("ok")).collect()
    assert [m["role"] for m in rows[0]["m"]] == ["system", "user", "assistant", "tool", "assistant", "tool", "assistant"]
    assert [m["tool_calls"] for m in rows[0]["m"]][2:5:2] == ["c1", "c2"] and len(rows[1]["m"]) == 3 and all(r["ok"] for r in rows)
