from __future__ import annotations

import base64
import hashlib
import json
import os

import pytest

from millrace.llm import oracles, queries, warc
from millrace.session import shared_dir
from tests.oracle import same


def test_equals_sql(spark, sf):
    same(queries.op2_warc(spark, sf), oracles.ORACLES["op2_warc"], sf)


ROWS = [(7, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (5, "u", "Ünï\r\n\r\nWARC/1.1\r\n"), (None, "n", "other"), (8, "u", "other"), (4, "d", "twice"), (4, "d", "twice")]


def brute(rows):
    first, out = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (html or "").encode()
        kind = "revisit" if data in first else "response"
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first.get(data)))
        first.setdefault(data, page_id)
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 4])
def test_round_trip(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_SHARE", hot)
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == brute(ROWS)


def test_files_roll_and_repeat(spark):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(sha2(string(id), 256), 20) as html")
    listed = []
    for parts in (2, 5):
        folder = shared_dir(spark)
        warc.write(pages.repartition(parts), folder, roll_bytes=4000, shards=3)
        rows = [(r["path"], r["records"], r["bytes"], r["sha1"]) for r in spark.read.parquet(f"{folder}/manifest").orderBy("path").collect()]
        listed.append(rows)
        back = warc.read(spark, folder)
        assert back.count() == 300 and back.where("url = concat('http://h/', page_id)").count() == 300
        root = folder.removeprefix("file://")
        assert json.load(open(f"{root}/_COMMITTED.json")) == {"files": len(rows), "records": 300}
    assert listed[0] == listed[1] and len(listed[0]) > 3
    assert all(b < 4000 + 3000 for _, _, b, _ in listed[0])


def test_commit_may_run_again(spark):
    folder = shared_dir(spark)
    pages = spark.range(40).selectExpr("id as page_id", "'u' as url", "repeat(sha2(string(id), 256), 20) as html")
    manifest = warc.write(pages, folder, roll_bytes=4000, shards=2)
    warc.commit(manifest, folder)
    root = folder.removeprefix("file://")
    # a failure before the marker, with some files renamed and some not
    os.remove(f"{root}/_COMMITTED.json")
    first = manifest.orderBy("path").first()
    os.makedirs(f"{root}/_temporary")
    os.rename(f"{root}/{first['path']}", f"{root}/{first['temporary']}")
    open(f"{root}/_temporary/left-by-a-lost-task.warc.gz", "wb").close()
    warc.resume(spark, folder)
    assert json.load(open(f"{root}/_COMMITTED.json"))["records"] == 40 and not os.path.exists(f"{root}/_temporary")
    assert warc.read(spark, folder).count() == 40


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
