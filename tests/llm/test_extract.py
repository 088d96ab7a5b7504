from __future__ import annotations

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from millrace.llm import extract

LONG = "This is a long enough sentence of the story, with words that go on and on so that nobody takes it for a label. "


def test_articles_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    truth = {}
    for r in pages.collect():
        body = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        truth[r["page_id"]] = " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1)>|<br>", " ", body))).split())
    for r in extract.report(pages).collect():
        assert r["text"] == truth[r["page_id"]] and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<script>var x = '<p>no</p>'", ""), ("<p>a&nbsp;b&amp;lt; <b>c</b>d\n\te</p>" + f"<p>{LONG}{LONG}</p>", f"a b&lt; cd e {LONG}{LONG}".strip()),
        (f"<nav><a href=x>Home</a></nav><div class=content><h1>T</h1><p>{LONG}</p><p>Short.</p></div><div class='sidebar'><p>{LONG}</p></div><footer>{LONG}</footer>", f"T {LONG}Short."),
        (f"<article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section><form><p>{LONG}</p></form><aside>{LONG}</aside><p>End.</p></article>", f"{LONG}End."),
        (f"<article><p>{LONG}<p>Unclosed <i>x", f"{LONG}Unclosed x"), (f"<div id='cookie-notice'>{LONG}</div><main><p>{LONG}</p></main>", LONG.strip()),
        (f"<article><!-- <p>no</p> --><style>p</style><p>{LONG}</p><noscript>{LONG}</noscript></article>", LONG.strip()),
        (f"<article><p title=\"a>b\">{LONG}</p><div class=ad>{LONG}</div></article><div hidden>{LONG}</div>", LONG.strip()),
    ],
)
def test_pages(page, text):
    assert extract.extract(page) == text


def test_minimum_cut_equals_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 7)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(-z if not s and z < 0 else z if not s else -z if z < 0 else 0 for z, s in zip(odds, side, strict=True) if (z > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert abs(cost(extract.min_cut(odds, edges)) - best) < 1e-6


def test_rows(spark):
    rows = [(1, "u", "<p>x"), (1, None, None), (None, "u", ""), (2, "v", "<article>" + "<p>word word word</p>" * 5000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = extract.report(df).collect()
    assert len(got) == 4 and max(r["n_chars"] for r in got) == 5000 * 15 - 1
    assert extract.report(df.limit(0)).count() == 0


def learned(n=60, seed=3):
    """Weights fitted to generated pages whose structure labels their blocks."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(n):
        body = "".join(f"<p>{LONG * rng.randint(1, 3)}</p>" for _ in range(rng.randint(2, 6)))
        menu = "".join(f"<li class=entryitem><a href=/{k}>Item {k}</a></li>" for k in range(rng.randint(3, 9)))
        blocks = extract.Blocks(f"<nav><ul>{menu}</ul></nav><article><h1>Some title</h1>{body}</article><footer>Made by us</footer>")
        x.append(blocks.features())
        y += blocks.labels()
    return extract.fit(np.concatenate(x), np.array(y))


def test_costs_are_learned_from_structure_and_hold_without_it():
    weights = learned()
    assert (weights != extract.DEFAULT).sum() > 5 and (extract.fit(np.zeros((2, len(weights))), np.array([1.0, 1.0])) == extract.DEFAULT).all()
    page = (
        "<div class=top><ul><li class=entryitem><a href=/a>Start</a></li><li class=entryitem><a href=/b>About</a></li></ul></div>"
        f"<div><h1>A story</h1><p>{LONG}</p><p>{LONG}{LONG}</p></div><div><ul><li class=entryitem><a href=/c>Older</a></li></ul></div>"
    )
    assert extract.extract(page, weights) == f"A story {LONG}{LONG}{LONG}".strip()


def test_names_that_content_may_carry_do_not_drop_it():
    page = f"<div class='more related'><p>{LONG}{LONG}</p><p>{LONG}{LONG}</p></div><div class=related><a href=x>See this</a></div>"
    assert extract.extract(page) == f"{LONG}{LONG}{LONG}{LONG}".strip()


@pytest.mark.parametrize("page", ["<div>x", "<b>x", "<div>x</b>", "<p>word, word</p><nav>x</nav>", "<a \">"])
def test_reading_takes_time_in_proportion(page):
    def seconds(n):
        began = time.process_time()
        extract.extract(page * n)
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)
