"""Exact quotas under subword tokenizers, and decontaminated selection."""

from __future__ import annotations

import pytest

from millrace.plans import remix as R

CODE = R.code_points()


def pairs():
    """Tokens of two characters, the last of one: not every number of characters is a number of tokens."""
    vocabulary: dict[str, int] = {}
    encode = lambda t: [vocabulary.setdefault(t[i : i + 2], len(vocabulary)) for i in range(0, len(t), 2)]
    return encode, lambda ids: "".join({v: k for k, v in vocabulary.items()}[i] for i in ids)


def merging():
    """'ab' is one token wherever it stands, so a cut between a and b changes the count."""

    def encode(t):
        out, i = [], 0
        while i < len(t):
            n = 2 if t[i : i + 2] == "ab" else 1
            out.append(t[i : i + n])
            i += n
        return out

    return encode, "".join


def test_exact_prefix():
    assert R.exact_prefix("wxyz", 3, CODE) == "wxy" and R.exact_prefix("wx", 3, CODE) is None and R.exact_prefix("wx", 0, CODE) is None
    assert R.exact_prefix("abcdefg", 2, pairs()) == "abcd"
    assert R.exact_prefix("xabab", 2, merging()) == "xab"


def test_halves():
    assert R.halves("abcd", CODE) == ("ab", "cd") and R.halves("a", CODE) is None
    a, b = R.halves("abcdef", pairs())
    assert a + b == "abcdef" and len(a) % 2 == 0


def test_boundary():
    clean = lambda t: t != "a"
    assert R.boundary("abcd", 1, iter([]), CODE, clean) == (False, [(-1, 0, "ab"), (-1, 1, "cd")])
    # a half is contaminated: a later candidate takes the row's place
    assert R.boundary("ab", 1, iter(["wxyz"]), CODE, clean) == (False, [(0, 0, "wxy")])
    assert R.boundary("q", 3, iter(["x", "ab"]), CODE, clean) == (True, [(1, 0, "ab")])
    with pytest.raises(ValueError, match="short"):
        R.boundary("ab", 1, iter(["zz"]), CODE, clean)
    with pytest.raises(ValueError, match="short"):
        R.boundary(None, 3, iter([]), CODE, clean)


def test_remix_fills_quotas_without_contamination(spark):
    texts = [f"text number {i} " + "word " * (i % 7) for i in range(60)]
    rows = [(i, "ab"[i % 2], t) for i, t in enumerate(texts)] + [(60, "a", "a benchmark question of some length"), (61, "b", texts[0]), (62, "a", "  "), (63, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    bench = spark.createDataFrame([(1, "A benchmark question, of some length!")], "item_id long, text string")
    got = R.remix(docs, {"a": 0.7, "b": 0.3}, 700, bench).collect()
    assert sum(r["targets"] for r in got) == 700 and sum(r["targets"] for r in got if r["source"] == "a") == 490
    assert all(r["targets"] == len(r["text"]) + 1 for r in got) and not {60, 62, 63} & {r["doc_id"] for r in got}
    source = dict((r[0], r[2]) for r in rows)
    for r in got:
        assert r["text"] == source[r["doc_id"]] if r["piece"] is None else r["text"] in source[r["doc_id"]]
    assert len({r["text"] for r in got}) == len(got)
    with pytest.raises(ValueError, match="short"):
        R.remix(docs, {"a": 1.0}, 10**6, bench)
