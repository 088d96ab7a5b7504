"""Operators against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.functions import text as T
from millrace.operators import contamination as C
from millrace.operators import conversations as V
from millrace.operators import dedup as D
from millrace.operators import filters, generate, metrics, profile, reshape
from millrace.operators import ordered as W
from millrace.plans import corpus
from millrace.session import _WRITTEN, discard, shared_dir, written
from millrace.sources import readers


def one(spark, column, **values):
    kinds = {str: "string", int: "long", list: "array<int>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_stable_sha256(spark):
    parts = ["ab", "c", "é"]
    digest = hashlib.sha256()
    for p in parts:
        digest.update(len(p.encode()).to_bytes(8, "big") + p.encode())
    assert one(spark, H.stable_sha256(F.col("a"), F.col("b"), F.col("c")), a="ab", b="c", c="é") == digest.hexdigest()


def test_token_digests(spark):
    ids = [1, 70000, 5]
    big = hashlib.sha256(b"".join(i.to_bytes(4, "big") for i in ids)).hexdigest()
    little = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in [1, *ids, 2])).hexdigest()
    assert one(spark, H.token_sha256(F.col("i")), i=ids) == big
    assert one(spark, H.chunk_digest(F.col("i"), 1, 2), i=ids) == little


def test_full_digest_modulus(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    assert one(spark, H.full_mod5(F.col("d")), d=digest) == int(digest, 16) % 5


@pytest.mark.parametrize("text", ["ＡＢＣ ﬁne", "Straße  ÉTÉ x", "", "a-b_c!"])
def test_normalisers(spark, text):
    import unicodedata

    nfkc = unicodedata.normalize("NFKC", text)
    assert one(spark, T.alnum_lower_exact(F.col("t")), t=text) == "".join(c for c in nfkc.lower() if c.isalnum())
    assert one(spark, T.folded_words(F.col("t")), t=text) == " ".join(nfkc.casefold().split())


@pytest.mark.parametrize(("text", "groups"), [("- a\n- b\n\ntext\n- c", [2, 1]), ("x", []), ("- a\n  more\n- b", [2]), ("", [])])
def test_bullet_groups(spark, text, groups):
    assert one(spark, T.bullet_groups(F.col("t")), t=text) == groups


def test_choice_and_tags(spark):
    assert one(spark, T.parse_choice(F.col("t")), t="The answer is (B).") == "B"
    assert one(spark, T.parse_choice(F.col("t")), t="A or B") is None
    assert one(spark, T.strict_choice(F.col("t")), t=" C ") == "C"
    assert one(spark, T.parse_integer(F.col("t")), t="-42") == -42
    assert one(spark, T.valid_tool_calls(F.col("t")), t='<tool_call>{"name":"f"}</tool_call><tool_call>no</tool_call>') == 1
    assert one(spark, T.strip_thinking(F.col("t")), t=" <think>a\nb</think> c") == "c"


def test_contamination_boundaries(spark):
    items = spark.createDataFrame([(1, "pan"), (2, "a" * 19), (3, "b" * 20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "prefix pan suffix"), (2, "pan"), (3, "x" + "a" * 19 + "y"), (4, "x" + "b" * 20 + "y"), (5, " \n\t "), (6, "++--")], "doc_id long, text string")
    found = {(r["doc_id"], r["reason"]) for r in C.ledger(docs, items, []).collect()}
    assert found == {(2, "exact"), (4, "containment"), (5, "empty_text")}


def test_containment_in_blocks(spark):
    rng = random.Random(1)
    items = [(i, "".join(rng.choice("ab") for _ in range(6))) for i in range(30)]
    docs = [(i, "".join(rng.choice("ab") for _ in range(40))) for i in range(20)]
    made = C.patterns(spark.createDataFrame(items, "item_id long, text string"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {tuple(r) for r in C.contained_matches(frame, made, 5).collect()}
    assert whole == {tuple(r) for r in C.contained_matches(frame, made, 5, max_patterns=4).collect()}
    assert len(whole) == sum(p in d for _, d in docs for p in {x for _, x in items})


def test_near_matches_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd") for _ in range(60)) for _ in range(6)]
    docs = [(i, b[:k] + "z" + b[k + 1 :]) for i, (b, k) in enumerate(itertools.product(base, (3, 30, 50)))]
    sets = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    want = {(i, j) for i, d in docs for j, b in enumerate(base) if len(sets(d) & sets(b)) / len(sets(d) | sets(b)) >= 0.7}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(base)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in C.near_matches(frame, items, least=0.7).collect()} == want


def test_simhash(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],)], "g array<string>").select(C.simhash("g").alias("h")).collect()
    assert rows[1]["h"] == -1
    digests = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in ("a", "b")]
    assert rows[0]["h"] % 2**64 == digests[0] | digests[1]


def test_self_simhash_pairs_equal_the_sequential_audit(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(40, 300))) for _ in range(60)]
    prompts = base + [b[:k] + "z" + b[k + 1 :] for b in base for k in (0, len(b) // 2)] + [rng.choice(base) for _ in range(30)]
    rng.shuffle(prompts)

    def audit():
        seen, out = [], set()
        for i, p in enumerate(prompts):
            if len(p) < 50:
                continue
            g = {int.from_bytes(hashlib.blake2b(p[k : k + 5].encode(), digest_size=8).digest(), "big") for k in range(len(p) - 4)}
            h = sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in g) >= len(g))
            for j, other, sign in seen:
                if any((h ^ sign) >> 16 * b & 0xFFFF == 0 for b in range(4)) and len(g & other) >= 0.85 * len(g | other):
                    out.add((j, i))
            seen.append((i, g, h))
        return out

    frame = spark.createDataFrame([(i, p, "ab"[i % 2]) for i, p in enumerate(prompts)], "key long, prompt string, split string").repartition(3)
    got = C.self_simhash_pairs(frame, "split").collect()
    assert all((r["split_a"], r["split_b"]) == ("ab"[r["a"] % 2], "ab"[r["b"] % 2]) for r in got)
    first = {p: i for i, p in reversed(list(enumerate(prompts)))}
    members = {}
    for i, p in enumerate(prompts):
        members.setdefault(first[p], []).append(i)
    copies = {(r["a"], r["b"]) for r in got if prompts[r["a"]] == prompts[r["b"]]}
    assert copies == {(a, b) for a, m in members.items() for b in m[1:] if len(prompts[a]) >= 50}
    near = {(r["a"], r["b"]) for r in got} - copies
    pairs = {tuple(sorted(p)) for a, b in near for p in itertools.product(members[a], members[b])}
    pairs |= {p for a, m in members.items() if len(prompts[a]) >= 50 for p in itertools.combinations(m, 2)}
    assert len(got) == len(near) + len(copies) and near and pairs == audit()


def test_running_totals_over_ranges(spark):
    rng = random.Random(3)
    data = [(f"{rng.random():.9f}", rng.randint(0, 9)) for _ in range(500)]
    got = W.running(spark.createDataFrame(data, "k string, v long"), ["k"], F.col("v"), ranges=7).orderBy("k").collect()
    total = 0
    for i, ((k, v), row) in enumerate(zip(sorted(data), got, strict=True)):
        total += v
        assert (row["k"], row["running_total"], row["global_rank"]) == (k, total, i + 1)


def test_exact_quota(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "k string, n long")
    assert [(r["k"], r["taken"]) for r in W.quota_prefix(rows, ["k"], "n", 8).orderBy("k").collect()] == [("a", 5), ("b", 3)]


def test_greedy_scan(spark):
    rng = random.Random(4)
    n = 60
    edges = {(a, b) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(90))}
    rank = {i: rng.random() for i in range(n)}
    accepted = set()
    for i in sorted(range(n), key=rank.get):
        if not any((min(i, j), max(i, j)) in edges for j in accepted):
            accepted.add(i)
    nodes = spark.createDataFrame([(i, rank[i]) for i in range(n)], "node long, rank double")
    got = {r["node"] for r in D.greedy_accept(nodes, spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == accepted


def test_label_mask(spark):
    got = one(spark, V.label_mask(F.col("i"), [1, 4], [2]), i=[1, 4, 5, 3, 2, 9])
    assert got == [-100, -100, 5, 3, 2, -100]


def test_rejections(spark):
    def why(messages):
        rows = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
        return rows.select(V.rejection(V.canonical(F.col("m"))).alias("x")).first()["x"]

    assert why([("human", "q"), ("gpt", " a ")]) is None
    assert why([("user", "q")]) == "last_not_assistant"
    assert why([("assistant", "a")]) == "first_not_user"
    assert why([("user", " "), ("assistant", "a")]) == "empty_content"
    assert why([("robot", "x")]) == "unknown_role"
    assert why([]) == "empty"


def test_tool_calls_must_close(spark):
    rows = [(1, 0, "user", "q", 0), (1, 1, "assistant", "", 1), (1, 2, "tool", "r", 0), (1, 3, "assistant", "a", 0), (2, 0, "user", "q", 0), (2, 1, "tool", "r", 0), (2, 2, "assistant", "a", 0)]
    got = V.turn_violations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, calls int")).collect()
    assert [(r["conv_id"], r["why"]) for r in got] == [(2, "tool_without_call")]


def test_code_file_filter(spark):
    rows = [("Python", "permissive", ["mit"], None, "src/a.py"), ("Perl", "permissive", ["mit"], "no", "a"), ("python", "copyleft", ["x"], "no", "a"), ("python", "permissive", [], "no", "a"), ("python", "permissive", ["mit"], "TRUE", "a"), ("python", "permissive", ["mit"], None, "x/node_modules/y"), ("python", "permissive", ["mit"], None, None)]
    df = spark.createDataFrame(rows, "language string, kind string, licenses array<string>, vendor string, path string")
    checks = filters.code_file_checks(F.col("language"), ["python"], F.col("kind"), "permissive", F.col("licenses"), F.col("vendor"), F.col("path"))
    assert [r["reason"] for r in filters.first_failure(df, checks).collect()] == [None, "language", "license_type", "missing_detected_license", "vendor", "vendor_path", "vendor_signal_missing"]


def test_generators(spark):
    rows = generate.mod10_tasks(spark, 20, 3, "s").collect()
    assert len(rows) == 3 * 10 * 3 and all({"add": r["a"] + r["b"], "sub": r["a"] - r["b"], "mul": r["a"] * r["b"]}[r["op"]] % 10 == r["answer"] for r in rows)
    tasks = generate.choice_tasks(spark, 12, 40, "s").collect()
    assert [sum(t["answer"] == x for t in tasks) for x in "ABCD"] == [10] * 4
    for t in tasks:
        right = {"add": t["a"] + t["b"], "sub": t["a"] - t["b"], "mul": t["a"] * t["b"]}[t["op"]]
        assert len(set(t["options"])) == 4 and t["options"]["ABCD".index(t["answer"])] == right
    for t in generate.extract_tasks(spark, 20, "s", ["Digit {place} of {digits}?"]).collect():
        place, digits = t["prompt"].split()[1], t["prompt"].split()[3].rstrip("?")
        assert digits[int(place) - 1] == t["answer"]
    assert all(json.loads(r["answer"]) for r in generate.format_tasks(spark, 20, "s").where("kind = 'json'").collect())


def test_flat_metrics(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "ok": true}, "ci": [0.5, 2], "s": "x"}')], "id long, j string")
    assert {(r["name"], r["value"]) for r in reshape.flat_metrics(df, "id", "j").collect()} == {("a/b", 1.0), ("ci/lower", 0.5), ("ci/upper", 2.0)}


def test_flat_metrics_at_any_depth(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": {"e": {"f": 6}}, "n": 4}}}}'), (2, '{"k": 1}'), (3, "no"), (4, None)], "id long, j string")
    assert {tuple(r) for r in reshape.flat_metrics(df, "id", "j").collect()} == {(1, "a/b/c/d/e/f", 6.0), (1, "a/b/c/n", 4.0), (2, "k", 1.0)}


def test_percentiles(spark):
    values = [5, 1, 9, 7, 3, 3, 8]
    row = profile.percentile_variants(spark.createDataFrame([(v,) for v in values], "v long"), "v", 0.5).first()
    assert row["ceil_rank"] == 5 and row["linear"] == 5 and row["floor_index"] == 5


def test_bootstrap_is_repeatable(spark):
    rows = spark.createDataFrame([("a", i % 3 == 0, i % 4 == 0) for i in range(200)], "g string, l boolean, r boolean").selectExpr("g", "int(l) as left", "int(r) as right")
    first, again = (metrics.paired_bootstrap(rows, "g", 500).first() for _ in range(2))
    assert first == again and first["lower"] <= first["mean"] <= first["upper"]


def test_mix_fills_quotas(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"text number {i % 150} " * 3) for i in range(200)], "doc_id long, source string, text string")
    rows = corpus.mix(docs, {"a": 0.7, "b": 0.3}, 1000, 100, 3)
    sums = {(r["split"], r["source"]): r["n"] for r in rows.groupBy("split", "source").agg(F.sum("taken").alias("n")).collect()}
    assert sums == {("train", "a"): 700, ("train", "b"): 300, ("validation", "a"): 70, ("validation", "b"): 30}
    with pytest.raises(ValueError, match="short"):
        corpus.mix(docs, {"a": 1.0}, 10**7, 10, 1)


def test_manifest(spark):
    record = corpus.accept({"rows": 3}, metrics.gates(spark.createDataFrame([(3,)], "n long"), {"rows": F.col("n") == 3}))
    assert corpus.bound(record) and not corpus.bound(record | {"rows": 4})
    with pytest.raises(ValueError, match="rows"):
        corpus.accept({}, metrics.gates(spark.createDataFrame([(3,)], "n long"), {"rows": F.col("n") == 4}))


def test_readers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"text": "x", "b": 1}\n\nnot json\n{"other": 1}\n{"text": " "}\n[1]\n')
    got = {r["class"]: r["n"] for r in readers.quality_scan(spark, str(path)).collect()}
    assert got == {"valid": 1, "blank": 1, "invalid_json": 1, "invalid_schema": 2, "empty": 1}
    good = tmp_path / "good.jsonl"
    good.write_text('{"text": "x", "b": 1}\n{"text": "y"}\n')
    assert readers.strict_profile(spark, str(good), ["text"])["fields"] == ["b", "text"]
    with pytest.raises(ValueError, match="no objects"):
        readers.strict_profile(spark, str(path), ["text"])
    expected = spark.createDataFrame([("good.jsonl", good.stat().st_size, hashlib.sha256(good.read_bytes()).hexdigest())], "name string, bytes long, sha256 string")
    assert readers.verify_files(spark, str(good), expected).first()["ok"]
    assert readers.object_uri("https://hub", {"repo_id": "r", "revision": "v"}, {"path": "p"}) == "https://hub/datasets/r/resolve/v/p"


def test_sharded_write(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "sha2(string(id), 256) as k")
    W.write_shards(rows, str(tmp_path / "out"), ["k"], 4)
    back = spark.read.json(str(tmp_path / "out"))
    assert [r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()] == [10] * 4


def test_stream_windows(spark, tmp_path):
    from millrace.streaming.windows import tumbling

    events = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id * 20) as ts, 'v' as event_type, double(id) as value from range(6)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = tumbling(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("hours").collect()} == {tuple(r) for r in tumbling(events, "1 hour").collect()}


def test_exact_first_keeps_one_row_of_ties_and_nulls(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, None), (4, None), (None, "b"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in D.exact_first(df, H.sha256(F.col("text")), "doc_id").collect()], key=str)
    assert got == [(1, "a"), (3, None), (None, "b")]


def test_alnum_lower_equals_python(spark):
    texts = ["ＡＢＣ１２３", "ﬁne ①", "Ünï-cödé", "plain Text 9", "e\u0301", None, "", "½ m²", "ǅ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.alnum_lower(F.col("t")).alias("a"), T.alnum_lower_exact(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["a"] == "abc123"


def test_self_near_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"{rng.choice('abcdefgh')}{k}" for k in range(80)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[0] + "!", None, "", "abc"]
    norm = ["".join(c for c in (t or "").lower() if c.isalnum()) for t in texts]
    sets = [{n[i : i + 5] for i in range(len(n) - 4)} for n in norm]
    low = lambda s: {int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big") >> 1 for g in s}
    first, want = {}, {}
    for i, n in enumerate(norm):
        if sets[i]:
            if n in first:
                want[first[n], i] = 1.0
            first.setdefault(n, i)
    ids = sorted(first.values())
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.85 and set(sorted(low(sets[a]))[:32]) & set(sorted(low(sets[b]))[:32]):
                want[a, b] = j
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["a"], r["b"]): r["jaccard"] for r in C.self_near_pairs(docs, salt=3).collect()}
    assert got.keys() == want.keys() and len(want) > 15 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_near_texts_need_no_shared_anchor(spark):
    """The smallest digests of each of two near texts are all of grams that the other lacks."""
    rng = random.Random(11)
    low = lambda g: int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big") >> 1
    least = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(20_000)}, key=low)[:64]
    body = "0123"
    while len(body) < 3000:
        body += next(c for c in rng.sample("0123456789", 10) if low(body[-4:] + c) > low(least[-1]))
    texts = [body + "".join(least[::2]), body + "".join(least[1::2])]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.85
    assert not set(sorted(map(low, sets[0]))[:32]) & set(sorted(map(low, sets[1]))[:32])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    copies, near = C.near_texts(docs)
    assert copies.isEmpty() and [(r["a"], r["b"]) for r in near.collect()] == [(0, 1)]


def test_bits_exclude_no_near_set():
    """Pairs at the very threshold, by grams removed, added or both, anywhere or in one stretch of the hashes."""
    rng, made, met = np.random.default_rng(5), C._Parities(0.85), 0
    fresh = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for trial in range(2000):
        a = np.unique(fresh(int(np.exp(rng.uniform(0, 7.5)))))
        gone = int(rng.integers(0, int(0.15 * len(a)) + 1))
        kept = a[gone:] if trial % 2 else rng.permutation(a)[gone:]
        new = fresh(max(0, int(len(kept) / 0.85 + 1e-9) - len(a)))
        b = np.unique(np.append(kept, new >> np.uint64(3) if trial % 3 else new))
        both = len(np.intersect1d(a, b))
        if both / (len(a) + len(b) - both) >= 0.85:
            met += 1
            small = made.classes(min(len(a), len(b)))[-1]
            assert small in made.classes(len(a)) and small in made.classes(len(b))
            apart = np.bitwise_count(made.bits(a, small) ^ made.bits(b, small)).sum()
            assert apart <= made.most(np.array([len(a)]), np.array([len(b)]))[0]
    assert met > 1500


def test_greedy_scan_with_copies(spark):
    """Of copies 1, 2, 3 the lowest-ranked stands for all, also against a neighbour of the least id."""
    nodes = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.4), (4, 0.3), (5, 0.1)], "node long, rank double")
    copies = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    edges = spark.createDataFrame([(1, 4)], "a long, b long")
    assert {r["node"] for r in D.greedy_accept(nodes, edges, copies).collect()} == {2, 5}


def test_running_in_groups(spark):
    rows = [(g, i, i % 5) for g in ("a", "b", None) for i in range(1, 200)]
    got = W.running_in_groups(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], ["i"], F.col("v")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["group_rank"] == r["i"] and r["running_total"] == sum(k % 5 for k in range(1, r["i"] + 1))


def test_reservoir_is_uniform_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r[0] for r in W.reservoir(df, 100, F.col("k"), "s").collect())
    b = sorted(r[0] for r in W.reservoir(df.repartition(7), 100, F.col("k"), "s").collect())
    assert a == b and len(set(a)) == 100 and 350 < sum(a) / 100 < 650 and W.reservoir(df.limit(0), 5, F.col("k"), "s").count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Cluster.conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_discard_deletes_what_was_written(spark):
    path = written(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and discard(spark) > 0 and not os.path.exists(path)


def test_no_set_of_grams_is_written_or_shuffled(spark):
    """Sets of grams take several times the room of the texts."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts + [t[:-20] for t in texts])), "doc_id long, text string")
    before = set(_WRITTEN.get(spark.sparkContext.applicationId, []))
    assert C.self_near_pairs(docs).count() == 40
    size = sum(f.stat().st_size for p in set(_WRITTEN[spark.sparkContext.applicationId]) - before for f in pathlib.Path(p.removeprefix("file://")).rglob("*.parquet"))
    assert size < sum(map(len, texts)) * 2


def bytes_written(spark, run):
    before = set(_WRITTEN.get(spark.sparkContext.applicationId, []))
    out = run()
    made = set(_WRITTEN.get(spark.sparkContext.applicationId, [])) - before
    return out, sum(f.stat().st_size for p in made for f in pathlib.Path(p.removeprefix("file://")).rglob("*.parquet"))


@pytest.mark.parametrize("match", [C.near_matches, C.simhash_pairs])
def test_documents_are_not_written_to_meet_items(spark, match):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(2000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(i, t[:-9]) for i, t in enumerate(texts[:4])], "item_id long, text string")
    rows, size = bytes_written(spark, lambda: {(r["doc_id"], r["item_id"]) for r in match(docs, items).collect()})
    assert rows == {(i, i) for i in range(4)} and size < sum(map(len, texts)) * 2
    # an item a block
    assert {(r["doc_id"], r["item_id"]) for r in match(docs, items, max_grams=100).collect()} == rows


def test_guard_meets_copies_once_and_lets_few_windows_out(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip()
    own, near = text(400), text(400)
    prompts = [own] * 50 + [own[:200]] * 3 + ["q" + own] + [near[:-3] + "xyz"] + [text(400) for _ in range(50)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(prompts)), "key long, prompt string")
    items = spark.createDataFrame([(1, own), (2, own), (3, near)], "item_id long, prompt string")
    got = {r["key"]: r["reason"] for r in C.guard(frame, items).collect()}
    assert got == {i: "eval_exact" for i in range(50)} | {i: "eval_containment" for i in range(50, 54)} | {54: "eval_near"}
    heads = C._heads(items, "item_id", 20)
    assert C._windows(frame, "key", heads, 20).count() <= 51 + 3 + 2
