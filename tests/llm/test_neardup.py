from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import neardup
from millrace.llm.common import Words

SCHEMA = "doc_id long, text string, class_id string"


def weighted(texts, frequencies):
    words = Words(pa.array(texts))
    doc, h, tf = neardup.shingle_table(words)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    weight = (1 + np.log(tf)) * frequencies.idf(h)
    return [(h[a:b], weight[a:b].astype(float)) for a, b in itertools.pairwise(first)]


def found_frequencies(docs):
    rows = docs.select("doc_id", "text")
    return neardup.frequencies(rows, neardup.prints(rows))


def corpus(seed=11):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 300]))]
        if rng.random() < 0.5:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_classes_equal_brute_force(spark):
    texts = corpus()
    texts += [texts[0].upper(), texts[1].replace(" ", ", "), "one two", "One, two!", "one three", None, "", "!!!", None]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    vectors = weighted(texts, found_frequencies(docs))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(vectors[a][0]) and len(vectors[b][0]) and neardup.similarity(vectors[a], vectors[b]) >= neardup.SIMILARITY:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["doc_id"]: r for r in neardup.report(docs).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in range(len(texts))}
    assert all(r["representative"] == (i == find(i)) for i, r in got.items())
    members = {}
    for r in got.values():
        members.setdefault(r["class_id"], []).append(r)
    for rows in members.values():
        assert {r["class_size"] for r in rows} == {len(rows)}
        by_text = {" ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[r["doc_id"]] or "").lower())): r["n_links"] for r in rows}
        assert {r["n_texts"] for r in rows} == {len(by_text)} and sum(by_text.values()) >= 2 * (len(by_text) - 1)
        assert all(n > 0 for n in by_text.values()) or len(by_text) == 1
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(12)
    a = [f"x{rng.randrange(900)}" for _ in range(400)]
    b = a[:300] + [f"y{rng.randrange(900)}" for _ in range(80)]
    texts = [" ".join(a), " ".join(b)]
    some = np.unique(np.concatenate([v[0] for v in weighted(texts, neardup.Frequencies(np.zeros(0, np.uint32), np.zeros(0, np.float32), 1.0))]))[::2]
    vectors = weighted(texts, neardup.Frequencies(some, 1 + (some % 7).astype(np.float32), 2.0))
    want = neardup.similarity(*vectors)
    rows, neardup.ROWS, bands, neardup.BANDS = neardup.ROWS, 1, neardup.BANDS, 4000
    try:
        doc = np.repeat([0, 1], [len(v[0]) for v in vectors])
        _, keys = neardup.sample_bands(doc, np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors]))
    finally:
        neardup.ROWS, neardup.BANDS = rows, bands
    assert abs((keys[0] == keys[1]).mean() - want) < 0.03


def test_rows_without_ids_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, text + " more"), (1, "a b c"), (1, "a b c"), (1, "d e f"), (2, None), (2, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert neardup.report(docs).count() == 8
    kept = sorted([(r["doc_id"], r["text"]) for r in neardup.deduplicated(docs).collect()], key=str)
    assert [k[0] for k in kept].count(None) == 1 and kept.count((1, "a b c")) == 1 and kept.count((1, "d e f")) == 1 and kept.count((2, None)) == 2
    assert neardup.report(docs.limit(0)).count() == 0


def test_slices_do_not_change_samples(monkeypatch):
    rng = np.random.default_rng(4)
    doc = np.repeat([0, 1, 4], [900, 3, 2000])
    h, w = rng.integers(0, 1 << 32, len(doc)).astype(np.uint32), rng.uniform(1, 3, len(doc))
    at, keys = neardup.sample_bands(doc, h, w)
    monkeypatch.setattr(neardup, "SLICE", 64)
    at2, keys2 = neardup.sample_bands(doc, h, w)
    assert (at == [0, 1, 4]).all() and (at == at2).all() and (keys == keys2).all()
    assert (neardup.sample_bands(doc, h, w, 1)[1] != keys).all()


def zipf_corpus(n, rng, vocabulary=60):
    """Sentences from a short list, the first ones far more often: shingles of all frequencies."""
    sentences = [" ".join(f"s{k}x{j}" for j in range(9)) for k in range(vocabulary)]
    return [" ".join(sentences[min(int(rng.paretovariate(0.8)) - 1, vocabulary - 1)] + f" d{i}n{j}" for j in range(8)) for i in range(n)]


def test_frequencies_are_exact_at_two_sizes(spark):
    """The idf falls with the exact document frequency, by the formula, whatever the number of documents."""
    seen = []
    for n in (300, 3000):
        texts = zipf_corpus(n, random.Random(13))
        df = Counter()
        for t in texts:
            w = t.split()
            df.update({" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
        shingles = sorted(df)
        share = np.array([df[s] for s in shingles]) / n
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        # every document a group of its own, so that each counts as one
        frequencies = neardup.frequencies(docs, neardup.prints(docs).withColumn("copies", F.col("doc_id")))
        got = np.array([frequencies.idf(v[0])[0] for v in weighted(shingles, frequencies)])
        want = np.array([1 + math.log(1 / max(s, neardup.LEAST_SHARE)) / math.log(1 / neardup.LEAST_SHARE) for s in share])
        assert np.abs(got - want).max() < 1e-5
        seen.append({s: g for s, g, x in zip(shingles, got, share, strict=True) if x > 0.05})
    both = sorted(set(seen[0]) & set(seen[1]))
    assert len(both) > 50 and np.corrcoef([seen[0][s] for s in both], [seen[1][s] for s in both])[0, 1] > 0.95


def test_frequencies_count_groups_of_copies_once(spark):
    rng = random.Random(13)
    base = [f"g{i}" for i in range(200)]
    copies = [" ".join([*base, f"tail{i}"]) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    others = [passage + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(100)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string")
    frequencies = found_frequencies(docs)
    (group, _), (shared, _) = weighted([" ".join(base)], frequencies)[0], weighted([passage], frequencies)[0]
    assert np.median(frequencies.idf(group)) > 1.2 * np.median(frequencies.idf(shared))


@pytest.mark.parametrize("small", [False, True])
def test_large_buckets_equal_brute_force(spark, monkeypatch, small):
    """A large group of near copies, and many texts that share a long passage only; with small blocks every path is taken."""
    if small:
        for name, value in {"BLOCK": 8, "CHUNK": 32, "LARGE": 6, "SALT": 8, "HOT_SHARE": 1e-2}.items():
            monkeypatch.setattr(neardup, name, value)
    rng = random.Random(5)
    base = [f"g{i}" for i in range(150)]
    texts = []
    for i in range(250):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = [f"p{i}" for i in range(100)]
    texts += [" ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    vectors = weighted(texts, found_frequencies(docs))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if find(a) != find(b) and neardup.similarity(vectors[a], vectors[b]) >= neardup.SIMILARITY:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["doc_id"]: r["class_id"] for r in neardup.report(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 150


def test_planted_near_copies_are_found(spark):
    """Copies with an edit in every forty words and above, beside the same by plain Jaccard similarity of 0.8."""
    rng = random.Random(21)
    texts, plain = [], []
    for _ in range(120):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        copy = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 45))):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, copy))
        plain.append(len(a & b) / len(a | b))
        texts += [" ".join(base), " ".join(copy)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    caught = [got[2 * i] == got[2 * i + 1] for i, j in enumerate(plain) if j >= 0.8]
    assert len(caught) > 60 and np.mean(caught) > 0.97


def test_very_long_text(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 1_500_000)]
    texts = [" ".join(words), " ".join([*words[:-20], "and", "so", "on"]), "short one"]
    got = {r["doc_id"]: r["class_id"] for r in neardup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
