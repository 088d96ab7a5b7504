"""Every registered query that SQL can express gives DuckDB's rows."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import pytest

from millrace.queries import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


#: Queries that SQL cannot express: each has a test of its rows here or, by the operator, in another module.
ELSEWHERE = {
    "a20_paired_bootstrap", "a21_cluster_bootstrap", "a22_stratified_bootstrap", "j07_self_simhash_pairs", "o04_remix", "o06_conversation_build", "o07_conversation_audit",
    "o08_conversation_repair",
}
HERE = {"d05_greedy_accepted", "f05_strict_verdicts", "g01_choice_tasks", "g03_extract_tasks", "g04_format_tasks", "j06_simhash_vs_benchmark", "j07_simhash", "j10_eval_guard", "o02_mix", "x20_response_reward"}


def test_every_query_without_sql_is_tested():
    assert set(QUERIES) - set(ORACLES) == ELSEWHERE | HERE


@pytest.mark.parametrize("name", sorted(ELSEWHERE))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and all(r[c] is not None for r in rows for c in df.columns if c != "piece")


def read(spark, sf, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()]


def alnum(text):
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").lower() if c.isalnum())


def grams(text, n=5):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def simhash(items):
    if not items:
        return 2**64 - 1
    hashes = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in items]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) >= len(hashes))


def test_simhash_queries_equal_brute_force(spark, sf):
    docs = {i: grams(alnum(t)) for i, t in read(spark, sf, "documents", "doc_id", "text")}
    items = {i: grams(alnum(t)) for i, t in read(spark, sf, "benchmark", "item_id", "text")}
    left, right = {i: simhash(g) for i, g in docs.items()}, {i: simhash(g) for i, g in items.items()}
    got = {r["doc_id"]: r["simhash"] % 2**64 for r in QUERIES["j07_simhash"](spark, sf).collect()}
    assert got == left
    want = {}
    for i, a in left.items():
        for k, b in right.items():
            x = a ^ b
            if docs[i] and items[k] and x.bit_count() <= 20 and any(not x >> 8 * p & 255 for p in range(8)) and 0.5 <= (j := jaccard(docs[i], items[k])) < 1:
                want[i, k] = (x.bit_count(), j)
    found = {(r["doc_id"], r["item_id"]): (r["distance"], r["jaccard"]) for r in QUERIES["j06_simhash_vs_benchmark"](spark, sf).collect()}
    assert found == want


def test_eval_guard_equals_brute_force(spark, sf):
    from millrace.queries import _items, _prompts

    prompts = [(r["key"], r["prompt"]) for r in _prompts(spark, sf).collect()]
    items = [r["prompt"] for r in _items(spark, sf).collect()]
    sets = [grams(n) if len(n := alnum(i)) >= 5 else {n} - {""} for i in items]
    want = {}
    for key, prompt in prompts:
        own = grams(n) if len(n := alnum(prompt)) >= 5 else {n} - {""}
        inside = any(p != prompt and min(len(p), len(prompt)) >= 20 and (p in prompt or prompt in p) for p in items)
        reason = "eval_exact" if prompt in items else "eval_containment" if inside else "eval_near" if any(jaccard(own, s) >= 0.8 for s in sets) else None
        if reason:
            want[key] = reason
    got = {r["key"]: r["reason"] for r in QUERIES["j10_eval_guard"](spark, sf).collect()}
    assert got == want and len(want) > 5


def test_greedy_scan_equals_the_sequential_one(spark, sf):
    near = [(r["a"], r["b"]) for r in QUERIES["j08_self_near"](spark, sf).collect()]
    around = {}
    for a, b in near:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    ids = sorted((i for (i,) in read(spark, sf, "documents", "doc_id")), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    accepted = set()
    for i in ids:
        if not around.get(i, set()) & accepted:
            accepted.add(i)
    got = {r["node"] for r in QUERIES["d05_greedy_accepted"](spark, sf).collect()}
    assert got == accepted and near


def test_greedy_scan_leaves_no_near_pair(spark, sf):
    """Against all pairs of documents: copies bar each other and whatever is near to one of them, without anchors."""
    sets = {i: grams(alnum(t)) for i, t in read(spark, sf, "documents", "doc_id", "text")}
    accepted = []
    for i in sorted(sets, key=lambda i: hashlib.sha256(str(i).encode()).hexdigest()):
        if not any(jaccard(sets[i], sets[j]) >= 0.85 for j in accepted):
            accepted.append(i)
    got = {r["node"] for r in QUERIES["d05_greedy_accepted"](spark, sf).collect()}
    assert got == set(accepted) and len(got) < len(sets)


def test_response_reward_equals_plain_python(spark, sf):
    def penalty(text):
        tokens = re.findall(r"\w+|[^\w\s]", text.lower())
        n = len(tokens) - 2
        return min(0.5, (n - len({tuple(tokens[i : i + 3]) for i in range(n)})) / n) if n > 0 else 0.0

    want = {}
    for conv, turn, role, text in read(spark, sf, "conversations", "conv_id", "turn", "role", "text"):
        if role == "assistant":
            assert "</think>" not in text
            want[conv, turn] = round((0.5 if 20 <= len(text.strip()) <= 800 else -0.5) - penalty(text), 9)
    got = {(r["conv_id"], r["turn"]): r["reward"] for r in QUERIES["x20_response_reward"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_generated_tasks_are_right(spark, sf):
    value = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b}
    rows = QUERIES["g01_choice_tasks"](spark, sf).collect()
    assert len({(r["op"], r["a"], r["b"]) for r in rows}) == 200
    for r in rows:
        options = [int(x) for x in r["options"].split("|")]
        assert len(set(options)) == 4 and options["ABCD".index(r["answer"])] == value[r["op"]](r["a"], r["b"])
    assert Counter(r["answer"] for r in rows) == {c: 50 for c in "ABCD"}
    rows = QUERIES["g03_extract_tasks"](spark, sf).collect()
    assert len(rows) == 200
    for r in rows:
        place, digits = sorted(re.findall(r"\d+", r["prompt"]), key=len)
        assert digits[int(place) - 1] == str(r["answer"])
    assert len(QUERIES["g04_format_tasks"](spark, sf).collect()) == 200


def test_mix_fills_its_quotas(spark, sf):
    size = {i: len(t or "") for i, t in read(spark, sf, "documents", "doc_id", "text")}
    tenth = sum(size.values()) // 10
    rows = QUERIES["o02_mix"](spark, sf).collect()
    totals = Counter()
    for r in rows:
        totals[r["split"]] += r["taken"]
        assert 0 < r["taken"] <= size[r["doc_id"]]
    assert totals == {"train": tenth, "validation": tenth // 10} and len({(r["doc_id"], r["split"]) for r in rows}) == len(rows)


def test_unpivot_reads_all_events(spark, tmp_path):
    rows = [(i, i % 7 if i % 5 else None, "click" if i % 3 else None) for i in range(4990, 5030)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["p08_unpivot"](spark, str(tmp_path))
    assert got.count() == sum((u is not None) + (e is not None) for _, u, e in rows)
    same(got, ORACLES["p08_unpivot"], str(tmp_path))


def test_earlier_split_grows_with_the_table(spark, tmp_path):
    rows = [(k, 0, "user", f"What is  {k % 200}?") for k in range(1000, 1600)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    earlier = {k for k in range(1000, 1600) if int(hashlib.sha256(f"split:{k}".encode()).hexdigest()[:8], 16) % 10 == 0}
    banned = {k % 200 for k in earlier}
    got = QUERIES["j19_seen_prompts"](spark, str(tmp_path))
    assert len(banned) > 20 and {r["key"] for r in got.collect()} == {k for k in range(1000, 1600) if k not in earlier and k % 200 not in banned}
    same(got, ORACLES["j19_seen_prompts"], str(tmp_path))


def test_overlaps_take_all_splits_and_whole_texts(spark, tmp_path):
    rows = [("en", "x", "A b"), ("it", "x", "A b"), ("it", "y", "a, b"), ("de", "y", "a, b"), ("fr", "z", "other"), (None, "x", "A b"), ("pt", None, None), ("it", None, None)]
    spark.createDataFrame(rows, "lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]): r["n"] for r in QUERIES["d07_overlap_matrix"](spark, str(tmp_path)).collect()}
    assert got == {("en", "it"): 1, ("de", "it"): 1}
    texts = {(r["a"], r["b"]): (r["raw"], r["normalised"]) for r in QUERIES["d07_text_overlaps"](spark, str(tmp_path)).collect()}
    assert texts == {("en", "it"): (1, 1), ("de", "it"): (1, 1), ("de", "en"): (0, 1)}
    for name in ("d07_overlap_matrix", "d07_text_overlaps"):
        same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))


def test_strict_verdicts_try_every_family(spark, sf):
    from millrace.functions import verify as V
    from millrace.queries import F05_PROMPT

    rows = {(r["conv_id"], r["turn"]): r["failed"] for r in QUERIES["f05_strict_verdicts"](spark, sf).collect()}
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'assistant'").collect()}
    assert len(rows) == len(texts) and len(V.RULES) == 25
    for key, failed in rows.items():
        assert failed == ",".join(n for n in sorted(V.RULES) if not V.RULES[n](F05_PROMPT, texts[key] or ""))
