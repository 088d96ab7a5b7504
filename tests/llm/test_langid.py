from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = langid.report(docs).toPandas().set_index("doc_id").join(docs.select("doc_id", "lang").toPandas().set_index("doc_id"))
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.index]).all()
    assert (rows["lang_pred"] == rows["lang"])[rows["held_out"]].mean() > 0.98
    assert rows["score"].between(0, 1).all() and not rows["rejected"].any()


def counts(texts):
    return np.unique(langid.Chars(texts).grams(), return_counts=True)


def test_probabilities_add_up():
    model = langid.kneser_ney({"a": counts(["abracadabra abra cad"] * 3), "b": counts(["xyzzy plugh xyz"] * 2)})
    letters = np.unique(np.concatenate([langid.Chars(["abracadabra abra cad", "xyzzy plugh xyz"]).codes]))
    for context in ("abr", "xyz", "qqq", "  a"):
        head = langid.Chars([context]).grams()[-1:] if context.strip() else None
        if head is None:
            continue
        grams = (head << np.uint64(16)) | letters
        total = np.exp(model.log_probabilities(grams)).sum(axis=0) + np.exp(model.unseen) * 0
        assert (total <= 1 + 1e-9).all() and (total > 0.85).all()


def test_lower_orders_by_hand():
    """The unigram level counts the characters that each one follows."""
    model = langid.kneser_ney({"a": counts(["ab ab ac"])})
    p = np.exp(model.tables[0].dense(np.array([ord("a"), ord("b"), ord("c"), ord(" ")], np.uint64), 1, np.nan)[:, 0])
    assert not np.isnan(p).any()
    assert abs(p.sum() + np.exp(model.unseen) * 0 - 1) < 0.25 and p[1] == p[2]


def test_hash_array_finds_all_and_only_its_own():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    table = langid.HashArray(grams)
    found = table.find(grams)
    assert (grams[table.order][found] == grams).all()
    assert (table.find(np.setdiff1d(rng.integers(0, 1 << 62, 5000, dtype=np.uint64), grams)) == -1).all()
    assert (langid.HashArray(grams[:0]).find(grams[:3]) == -1).all()


def test_blank_foreign_and_odd_texts(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.train(docs)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "Это русский текст с другим алфавитом " * 5, "x"), (5, "the and of the " * 5000, "x"), (None, "zkq qkz " * 20, "x"), (1, "the", "x")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert len(got) == 7
    assert all(by[k]["lang_pred"] == "und" and by[k]["rejected"] and by[k]["score"] == 0 for k in ((1, None), (2, ""), (3, "12 !?")))
    assert by[(4, rows[3][1])]["rejected"] and not by[(5, rows[4][1])]["rejected"] and by[(5, rows[4][1])]["lang_pred"] == "en"


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.report(docs).collect()} == {"und"}
    assert langid.report(docs.limit(0)).count() == 0


def test_all_training_rows_count_and_small_languages_are_learned(spark):
    texts = {"aa": [f"abra cadabra {'ab' * (i % 5)} word{chr(97 + i % 26)}" for i in range(400)], "bb": ["xyzzy plugh quux " * 3]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    for only in range(40):  # whichever of the ids is the language's one document
        docs = [(i, t, lang) for i, t, lang in rows if lang == "aa"] + [(only, texts["bb"][0], "bb")]
        frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        if zlib.crc32(str(only).encode()) % 4 != 2 and frame.where((langid.hash_unit(F.concat(F.lit("part:"), F.col("doc_id").cast("string"))) < 0.2) & (F.col("lang") == "bb")).count():
            break
    model = langid.train(frame, max_chars=500)
    assert model.languages == ["aa", "bb"] and model.judge(pa.array(["xyzzy quux"]))[0] == ["bb"]
    trained = [t for i, t in enumerate(texts["aa"]) if zlib.crc32(str(i).encode()) % 4 != 2]
    seen = model.tables[-1].index.find(np.unique(langid.Chars(trained).grams()))
    assert (seen >= 0).mean() > 0.95


def reference(counts, gram, order):
    """log p of the last character by the textbook recursion over dictionaries."""
    levels = {langid.ORDER: {int(g): int(c) for g, c in zip(*counts, strict=True)}}
    for k in range(langid.ORDER - 1, 0, -1):
        levels[k] = Counter(g & ((1 << 16 * k) - 1) for g in levels[k + 1])

    def p(g, k):
        if k == 0:
            return None
        table = levels[k]
        n1, n2 = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        d = min(max(n1 / (n1 + 2.0 * n2), 0.1), 0.95) if n1 else 0.5
        inside = [c for x, c in table.items() if x >> 16 == g >> 16]
        lower = p(g & ((1 << 16 * (k - 1)) - 1), k - 1) if k > 1 else 1 / vocabulary
        if not inside:
            return lower
        return max(table.get(g, 0) - d, 0) / sum(inside) + d * len(inside) / sum(inside) * lower

    vocabulary = len(levels[1]) + 1
    return np.log(p(gram, order))


def test_sparse_tables_equal_the_recursion():
    made = counts(["abracadabra abra cad bra"] * 3)
    model = langid.kneser_ney({"a": made})
    for text in ("abra cad", "brrr", "zz top", "cadabra a"):
        grams = langid.Chars([text]).grams()
        got = model.log_probabilities(grams)[:, 0]
        assert np.allclose(got, [reference(made, int(g), langid.ORDER) for g in grams])


def test_letters_beyond_the_basic_plane_differ():
    gothic, deseret = "".join(map(chr, range(0x10330, 0x10340))), "".join(map(chr, range(0x10428, 0x10438)))
    model = langid.kneser_ney({"got": counts([gothic * 3]), "des": counts([deseret * 3])})
    assert model.judge(pa.array([gothic, deseret]))[0] == ["got", "des"]


def test_very_long_text_is_scored_whole(spark):
    model = langid.kneser_ney({"a": counts(["abracadabra abra cad"] * 3), "b": counts(["xyzzy plugh xyz"] * 2)})
    long = "abra cadabra " * 1000 + "xyzzy plugh " * 200_000
    docs = spark.createDataFrame([(1, long), (2, "abra")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()} == {1: "b", 2: "a"}
