from __future__ import annotations

import hashlib
import random
import re

from millrace.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def brute(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(said(spans).encode()).hexdigest(), (texts[r["doc_id"]], said(spans), r["spans"])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(said(spans).split(",")) <= set(r["spans"].split(","))


def test_tables_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(pii.report(docs).collect(), {r[0]: r[1] for r in docs.select("doc_id", "text").collect()})


def test_fuzz_equals_brute_force(spark):
    rng = random.Random(5)
    letters = "aZ0911 --..@@+()%_é😀\n2555"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b..c x@y.z.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 0000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (555) 123-4567"]
    texts += ["5--4111111111111111", "é😀a.b@c.d", None, "", "a@b.c-", "a@-.-", "-@-.-.-a@b"]
    check(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect(), dict(enumerate(texts)))


def test_long_runs_stay_cheap(spark):
    texts = ["x@" + "a." * 5000 + "b", "9" * 50_000, "a" * 200_000, "a@" * 20_000, "+1" + " " * 100_000, "1." * 50_000, "4111111111111111 " * 500]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_email"] for r in rows] == [1, 0, 0, 0, 0, 0, 0]
    assert rows[5]["n_ip"] == 12_500 and rows[6]["n_card"] == 0


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"Please contact me at user{i}@mail.example.com today." for i in range(40)]
    texts += ["Please contact me at jd.4471.x today.", "Other line with jd.4471.x again", "Random qq1234zz here", "Please contact me at home today 12345678 x"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert rows[40] == "email:21:30" and rows[41] == "email:16:25" and rows[42] == rows[43] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "Please contact me at [EMAIL] today." and clean[41] == "Other line with [EMAIL] again" and clean[42] == texts[42]
    assert pii.redact(docs).where("spans = 'old'").count() == len(texts)


def test_contexts_learned_from_discovered_identifiers_discover_further_ones(spark):
    texts = [f"Please contact me at user{i}@mail.example.com today." for i in range(60)]
    texts += [f"Please contact me at zz{i}456 today." for i in range(5)]
    texts += [f"The badge id zz{i}456 here" for i in range(5)]
    texts += ["The badge id qq9991 here", "Some other text with ww8881 here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert rows[60] == "email:21:27" and rows[65] == "email:13:19"
    assert rows[70] == "email:13:19" and rows[71] == ""


def test_scores_of_all_instances_count_in_the_confidence(spark):
    # four of the second pattern's thirteen instances are seeds: never confident, though each seed also stands in the first
    texts = [f"Please contact me at user{i}@mail.example.com today." for i in range(40)]
    texts += [f"The order number user{i}@mail.example.com here" for i in range(4)] + [f"The order number kk{i}777 here" for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert [rows[k] for k in range(44, 53)] == [""] * 9


def test_redaction_merges_overlaps_and_keeps_nulls(spark):
    docs = spark.createDataFrame([(1, "x +4111111111111111 y"), (2, None), (None, "1.2.3.4"), (1, "1.2.3.4")], "doc_id long, text string")
    got = sorted([tuple(r) for r in pii.redact(docs).collect()], key=str)
    assert got == sorted([(1, "x +[CARD] y"), (2, None), (None, "[IP]"), (1, "[IP]")], key=str)
    assert pii.redact(docs.limit(0)).count() == 0


def test_long_words_and_tokens_count(spark):
    """Tokens of any length are instances, and a context word of any length is one."""
    word = "x" * 300
    texts = [f"Please {word} at user{i}@mail.example.com today." for i in range(40)]
    key = "k9" * 60
    texts += [f"Please {word} at {key} today.", f"and {key} again", "id ab1234 cd5678 ef9012 end"]
    rows = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[40] == f"email:311:{311 + len(key)}" and rows[41] == f"email:4:{4 + len(key)}" and rows[42] == ""


def test_many_matches_in_one_text(spark):
    n = 20_000
    text = "mail a1@b.c \u00e9 id zz12345 and +1 (555) 123-4567 from 1.2.3.4, " * n
    docs = spark.createDataFrame([(1, text, "x"), (2, "1.2.3.4", "y")], "doc_id long, text string, reach__ string")
    rows = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert (rows[1]["n_email"], rows[1]["n_phone"], rows[1]["n_ip"]) == (n, n, n)
    assert rows[1]["base_sha256"] == hashlib.sha256(said(brute(text)).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).where("reach__ is not null").collect()}
    assert clean == {1: "mail [EMAIL] \u00e9 id zz12345 and [PHONE] from [IP], " * n, 2: "[IP]"}
