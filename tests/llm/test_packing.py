from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@given(st.integers(1, 10**6))
def test_decomposition(n):
    parts = packing.decompose(n)
    assert sum(parts) == n and all(p <= 1024 and p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)
    assert len([p for p in parts if p < 1024]) == len({p for p in parts if p < 1024})


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_fast_ids_equal_the_tokenizers_library(texts):
    from tokenizers import Tokenizer

    vocabulary = packing.default_vocabulary()
    texts = [*texts, "a<|endoftext|>b", "<|endoftext|", " \u00a0\u3000x", "don't 12 ünï 中文"]
    exact = Tokenizer.from_file(vocabulary)
    fast = packing.encoder(vocabulary, vocabulary.removesuffix(".json") + ".tiktoken")
    assert fast(texts) == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_vocabulary())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc_id, pieces in by.items():
        ids = [*exact.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], "<u4")
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids) and p["offset"] == 0
            assert p["length"] & (p["length"] - 1) == 0 and p["length"] <= 1024 and p["bucket"] == p["length"].bit_length() - 1
            at += p["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.report(docs).collect(), {r[0]: r[1] for r in docs.select("doc_id", "text").collect()})


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 3000, 4: "<|endoftext|>"}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, length string").repartition(3)
    rows = packing.pack(docs).collect()
    check(rows, texts)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    again = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert packing.pack(again).count() == 2 * packing.pack(again.limit(1)).count()
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, length=1000)


def test_long_texts_are_cut_without_changing_ids():
    import millrace.llm.packing as packing

    rng = random.Random(4)
    text = "".join(rng.choice(["the cat", " sat", "  ", " 12", "\n", "é", " l'eau", "...", " \u00a0x"]) for _ in range(4000))
    assert "".join(packing.parts(text, 50)) == text and len(list(packing.parts(text, 50))) > 100
    vocabulary = packing.default_vocabulary()
    encode = packing.encoder(vocabulary, vocabulary.removesuffix(".json") + ".tiktoken")
    whole = packing.encoder(vocabulary, None)([text])[0]
    assert [i for p in packing.parts(text, 50) for i in encode([p])[0]] == whole
    long = text * 80
    assert len(long) > packing.CHUNK_BYTES and list(encode([long])[0]) == packing.encoder(vocabulary, None)([long])[0]
