from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import features, quality_pu, quality_rules


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def tables(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_pu_on_held_out_labels(tables):
    docs, labels = tables
    rows = quality_pu.report(docs, labels).toPandas().set_index("doc_id")
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.index]).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    held = rows[rows["held_out"]].join(labels.toPandas().set_index("doc_id"), how="inner")
    assert auc(held["quality"].to_numpy(), held["score"].to_numpy()) > 0.95
    assert (held["predicted"] == held["quality"]).mean() > 0.9


def test_rules_on_labels(tables):
    docs, labels = tables
    rows = quality_rules.report(docs, labels).toPandas().set_index("doc_id").join(labels.toPandas().set_index("doc_id"), how="inner")
    judged = rows[~rows["base_failed"]]
    assert (judged["kept"] == (judged["quality"] == 1)).mean() > 0.95
    assert not rows["kept"][rows["base_failed"]].any()


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice(["ab", "é", "c#", "😀|"]) + rng.choice([" ", "\n", "\t ", "\x0b", " \n\n"]) for _ in range(n))
    texts = [make(rng.randint(0, 90)) for _ in range(200)] + [None, "", " \n ", "a " * 400, "x" * 100_000]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    for r in quality_rules.report(docs, labels).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]])
        assert r["kept"] is not r["base_failed"]  # without labels only the base rules reject


def test_degenerate_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (2, "")], "doc_id long, text string")
    for rows in ([], [(1, 1, 0), (2, 1, 0)], [(1, 0, 0)], [(None, 1, 0), (1, None, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = quality_pu.report(docs, labels).collect()
        assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
        assert len(quality_rules.report(docs, labels).collect()) == 4
    assert quality_pu.report(docs.limit(0), labels).count() == 0


def test_risk_is_not_negative():
    """The weights that nnPU finds separate clear clusters although positives are among the unlabelled."""
    rng = np.random.default_rng(0)

    def sample(x):
        n, d = x.shape
        return features.Sample(np.repeat(np.arange(n), d), np.tile(np.arange(d), n), x.ravel(), {}, n)

    positive = rng.normal(1, 0.3, (200, 3))
    mixed = np.concatenate([rng.normal(1, 0.3, (300, 3)), rng.normal(-1, 0.3, (300, 3))])
    w = quality_pu.nnpu(sample(positive), sample(mixed), 0.5, steps=150)
    z = sample(mixed).dot(w)
    assert (z[:300] > z[300:].max()).mean() > 0.99


def test_platt_is_calibrated():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < features.sigmoid(1.5 * z - 0.5)).astype(float)
    a, b = features.platt(z, y)
    assert abs(a - 1.5) < 0.1 and abs(b + 0.5) < 0.1


def test_the_prior_comes_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8):
        positive = rng.normal(3, 1, 2000)
        unlabelled = np.concatenate([rng.normal(3, 1, int(2000 * share)), rng.normal(-3, 1, int(2000 * (1 - share)))])
        assert abs(quality_pu.best_bin(positive, unlabelled) - share) < 0.07
    assert quality_pu.best_bin(np.zeros(0), np.zeros(3)) == 0.5


def plain_score(text, weights):
    """The linear score from plain Python counts, by the same hashes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    w = features.Words(pa.array([text]), features.NON_SPACE, lower=False)
    hashes = dict(zip(words, w.hash.tolist(), strict=True))
    one = [weights[hashes[x] >> (64 - features.WORD_BITS)] for x in words]
    pair = []
    for a, b in zip(words, words[1:]):
        h = features.mix(np.array([hashes[a]], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(hashes[b]))
        pair.append(weights[features.PAIRS + int(h[0] >> np.uint64(64 - features.PAIR_BITS))])
    gram = []
    for i in range(len(text) - 2):
        a, b, c = map(ord, text[i : i + 3])
        gram.append(weights[features.GRAMS + ((a | b << 21 | c << 42) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - features.GRAM_BITS))])
    size = max(len(text.encode()), 1)
    dense = [
        sum("A" <= x <= "Z" for x in text) / size, sum(x in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for x in text) / size, sum("0" <= x <= "9" for x in text) / size,
        sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1), np.log1p(len(words)) / 10, size * (text != "") / max(len(words), 1) / 20,
    ]
    mean = lambda v: sum(v) / max(len(v), 1)
    return features.SCALE * (mean(one) + mean(pair) + mean(gram)) + float(np.dot(dense, weights[-features.N_DENSE - 1 : -1])) + weights[-1]


def test_scores_equal_plain_counts():
    rng = random.Random(9)
    weights = np.random.default_rng(3).normal(0, 1, features.DIM)
    texts = ["".join(rng.choice("aB é😀1 .\n") for _ in range(rng.randint(0, 80))) for _ in range(120)] + ["", "a", "same same same", "ü" * 5]
    got = features.score(pa.array(texts), weights)
    assert np.allclose(got, [plain_score(t, weights) for t in texts])
    cols, values = features.rows(pa.array(texts))
    assert np.allclose(got, [float(np.dot(weights[c], v)) for c, v in zip(cols, values, strict=True)], atol=1e-3)


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(800_000))
    docs = spark.createDataFrame([(1, text, 3), (2, text + "\n" + text, 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3, 40)], "doc_id long, quality int, toxic int")
    more = docs.unionByName(spark.createDataFrame([(i, f"good words here {i}" if i % 2 else f"### {i} $$$", 0) for i in range(3, 40)], docs.schema))
    rows = {r["doc_id"]: r for r in quality_rules.report(more, labels).collect()}
    assert rows[1]["n_words"] == 800_000 and rows[1]["n_repeat_words"] == 0 and rows[2]["n_repeat_words"] == 1_600_000
    scored = {r["doc_id"]: r["score"] for r in quality_pu.report(more, labels).collect()}
    assert abs(scored[1] - scored[2]) < 0.05
    kept = quality_pu.score(more, quality_pu.train(more, labels))
    assert kept.columns == ["doc_id", "text", "score", "predicted"] and dict(kept.dtypes)["score"] == "double"
