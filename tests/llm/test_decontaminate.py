from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common, decontaminate, oracles, queries
from tests.oracle import same

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item_id, item in items:
        v = WORD.findall(lower(item))
        n = min(len(v), 10)
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if item_id is not None:
                    found.add(str(item_id))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_equals_sql(spark, sf):
    same(queries.op1_decontamination(spark, sf), oracles.ORACLES["op1_decontamination"], sf)


@pytest.mark.parametrize(("max_windows", "max_ids"), [(10**6, 64), (10**6, 1), (30, 64), (40, 1)])
def test_equals_brute_force(spark, monkeypatch, max_windows, max_ids):
    monkeypatch.setattr(decontaminate, "MAX_IDS", max_ids)
    rng = random.Random(7)
    vocabulary = ["a", "B", "é1", "C3", "dd", "Ö"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "-", "\n"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 5, 9, 10, 11, 14]))) for i in range(2, 14)] + [(14, None), (15, "..."), (None, "B dd dd B"), (3, make(10)), (3, make(10))]
    items = [x for x in items if x[1] is None or len(WORD.findall(x[1])) != 1]
    docs = [(i, make(rng.randint(0, 60)) + (" " + items[i % 12][1] if i % 3 == 0 and items[i % 12][1] else "")) for i in range(40)]
    docs += [(40, None), (41, ""), (42, "?!"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[6][1])]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(df, bench, max_windows=max_windows).collect()
    want = sorted([(d, *brute(t, items)) for d, t in docs], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    row = decontaminate.report(docs, bench.limit(0)).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)


def test_actions(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two, three! And this.", 5), (2, "clean", 6), (3, None, 7)], "doc_id long, text string, hit_items long")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    cut = {r["doc_id"]: (r["text"], r["hit_items"]) for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert cut == {1: ("Keep this. ! And this.", 5), 2: ("clean", 6), 3: (None, 7)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3]


def test_long_words_and_windows():
    texts = ["x" * (3 << 20) + " a b", "x" * (3 << 20) + " a b", "y" + "x" * (3 << 20) + " a b", "", None, "a", "é a"]
    words = common.Words(pa.array(texts))
    assert np.diff(words.first).tolist() == [3, 3, 3, 0, 0, 1, 2]
    h = words.hash
    assert h[0] == h[3] != h[6] and h[1] == h[4] == h[9] == h[11]
    at, _ = words.windows(3)
    assert at.tolist() == [0, 3, 6]


def test_very_long_text(spark):
    filler = " ".join(f"w{i % 9973}" for i in range(1_500_000))
    docs = spark.createDataFrame([(1, filler + " the secret answer of item one is forty two and so on"), (2, filler)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The secret answer of item one is forty two and so on")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (1_500_012, 12, 1), 2: (1_500_000, 0, 0)}
