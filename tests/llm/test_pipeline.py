from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
from millrace.llm import decontaminate, pii
from millrace.session import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = written(stage(spark, rows, sf))
        kept.append((name, rows.count()))
        if name != "packing":
            assert rows.columns == docs.columns
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate.report(rows, bench).where("contaminated").count() == 0
            clean = decontaminate.report(before, bench).where("not contaminated").count()
            assert rows.count() == clean
        if name == "pii":
            assert rows.count() == before.count()
            assert pii.report(rows).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
            assert rows.where("n_chars != length(text)").count() == 0
            last = rows
    assert [n for n, _ in kept] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    assert kept[0][1] == docs.count()  # every clean document is in a learned language
    assert {r[0] for r in rows.select("doc_id").distinct().collect()} == {r[0] for r in last.select("doc_id").collect()}
    sample = rows.limit(50).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in sample)


def test_odd_documents(spark, sf, tmp_path):
    """Nulls, empty texts and repeated rows pass every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7001, "", "en", "s", 0), (7001, "", "en", "s", 0), (None, "the and of " * 30, None, "s", 5)], docs.schema)
    docs.unionByName(odd).unionByName(docs.limit(5)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r[0] for r in rows.select("doc_id").distinct().collect()}
    assert 7001 not in ids and len(ids) > 100
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
