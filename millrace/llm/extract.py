"""HTML extraction by minimum-cut labelling.

A page is read into blocks of text, each with its innermost open element; elements point to their parents, so reading
takes time in proportion to the page. The log-odds of a block being content are the evidence of its elements (tags and
class names that say what they hold) plus a classifier over the block itself: its tag, length, share of linked text,
punctuation, words, and the class names of its elements that say nothing by themselves. The classifier is a logistic
regression fitted to the pages at hand: blocks that their elements place within an article or within a menu, footer,
form or the like are labelled by that structure, which the regression does not see. Its weights are held near DEFAULT
by a ridge, so that few labels change little and none nothing. At most max_pages pages, drawn by a hash of their url
and id, are read for it.

The positive part of a block's log-odds is the capacity from the source, the negative part that to the sink.
Neighbouring blocks, and blocks under one parent, are joined by smoothness edges that grow with the depth of their
common ancestor. The minimum cut (Dinic's max-flow) separates content from the rest. Runs of blocks under one parent
whose log-odds have one sign are one node: no minimum cut splits them.

A block's character references are decoded, its white space becomes single spaces, and content blocks are joined in
page order by one space. Pages are handled one at a time within a task; memory is bounded by one page.

Defined results: null or empty html gives an empty text; markup that never closes ends with the page; pages without
any content block give an empty text; repeated rows are extracted alike; pages without labelled blocks of both sorts
leave the default weights; further columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, hash_unit, mapped
from millrace.llm.features import adam, sigmoid

MAX_PAGES = 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Start tags that end an open element of the given names.
CLOSES = {t: ("p",) for t in BLOCK - {"br", "button", "option", "optgroup", "select", "body", "html", "head", "title", "legend", "summary"}}
CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that the rule above does not look beyond.
FENCE = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|\baria-hidden\s*=\s*["']?true""", re.I)

_BAD_TAG = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "button": -9.0, "select": -9.0, "dialog": -9.0, "head": -12.0, "header": -7.0, "fieldset": -7.0}
_GOOD_TAG = {"article": 6.0, "main": 4.0}
_WORDS = re.compile(r"[a-z]+")
_BAD_NAME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commenting disqus "
    "reply replies respond discussion share sharing social newsletter subscribe subscription signup login popup modal overlay pagination pager widget skip copyright disclaimer".split()
)
#: Names that content may carry too: the text decides against them.
_DOUBTFUL_NAME = frozenset("related recommended recommendations more search legal tags links list meta info".split())
_GOOD_NAME = frozenset("article content main post entry story text articlebody maincontent".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ADJACENT, SHARED = 0.6, 0.25
#: Buckets of class names that are in no list.
NAMES_DIM = 64
#: Weights of the features of a block without any training: constant, paragraph, heading, list item, cell, length, links, punctuation, words; then names.
DEFAULT = np.array([-1.0, 1.0, 0.5, 0.0, 0.0, 1.0, -3.0, 0.0, 0.0] + [0.0] * NAMES_DIM)
#: The classifier's say beside the evidence of the elements.
MOST = 4.0


class _Open:
    """An open element. shown is the nearest element around a block that counts, itself or one above; outer the next above that."""

    __slots__ = ("tag", "score", "good", "names", "shown", "outer", "depth")

    def __init__(self, tag: str, attributes: str, above: "_Open | None"):
        self.tag = tag
        names: set[str] = set()
        if attributes:
            for m in NAMES.finditer(attributes):
                names.update(_WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
        self.score = above.score if above else 0.0
        self.good = tag in _GOOD_TAG or (above is not None and above.good)
        inside = above is not None and above.score > 0
        if tag in _BAD_TAG:
            # a header within the article holds its title
            self.score = min(self.score, 0.0) + _BAD_TAG[tag] if not (tag == "header" and inside) else self.score
        elif tag in _GOOD_TAG:
            self.score += _GOOD_TAG[tag]
        if names & _BAD_NAME and tag not in ("body", "html", "article", "main") or names & {"comment", "comments"}:
            self.score = min(self.score, 0.0) - 9.0
        elif names & _GOOD_NAME and tag not in HEADING:
            self.score += 2.0
        elif names & _DOUBTFUL_NAME and tag not in ("body", "html", "article", "main"):
            self.score -= 0.5
        if attributes and HIDDEN.search(attributes):
            self.score = min(self.score, 0.0) - 9.0
        self.names = above.names if above else 0
        for name in names - _BAD_NAME - _GOOD_NAME:
            self.names |= 1 << int.from_bytes(name.encode(), "little") % 1000003 % NAMES_DIM
        counts = tag in BLOCK or self.score != 0 or tag == "a"
        self.outer = (above.shown if above else None) if counts else None
        self.shown = self if counts else above.shown if above else None
        self.depth = (self.outer.depth + 1 if self.outer else 1) if counts else 0


class Blocks:
    """The text blocks of a page, in order, with the innermost element that counts around each."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.nodes: list[_Open | None] = []
        self.runs: list[str] = []
        self.link_chars = 0
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # of each open tag in the stack
        self.fences: list[int] = []
        self.links = 0
        self.has_article = False
        self._read(html)

    def _flush(self) -> None:
        if self.runs:
            text = " ".join("".join(self.runs).split())
            if text:
                self.texts.append(text)
                self.linked.append(self.link_chars)
                self.nodes.append(self.stack[-1].shown if self.stack else None)
                self.has_article |= bool(self.stack) and self.stack[-1].good
            self.runs, self.link_chars = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            run = unescape(raw) if "&" in raw else raw
            self.runs.append(run)
            if self.links:
                self.link_chars += len(run.strip())

    def _pop(self, index: int) -> None:
        for o in self.stack[index:]:
            self.places[o.tag].pop()
            self.links -= o.tag == "a"
        while self.fences and self.fences[-1] >= index:
            self.fences.pop()
        del self.stack[index:]

    def _place(self, tag: str, fenced: bool) -> int:
        """Where the innermost open tag of a name stands; -1 without one, or if a fence is in between and counts."""
        at = self.places.get(tag)
        if not at or (fenced and self.fences and at[-1] < self.fences[-1]):
            return -1
        return at[-1]

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._flush()
        for name in CLOSES.get(tag, ()):
            if (at := self._place(name, True)) >= 0:
                self._pop(at)
        if tag not in VOID and not attributes.endswith("/"):
            self.places.setdefault(tag, []).append(len(self.stack))
            if tag in FENCE:
                self.fences.append(len(self.stack))
            self.stack.append(_Open(tag, attributes, self.stack[-1] if self.stack else None))
            self.links += tag == "a"

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if (at := self._place(tag, tag not in BLOCK)) >= 0:
            self._pop(at)

    def _read(self, html: str) -> None:
        at, find = 0, TOKEN.search
        while m := find(html, at):
            self._text(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(tag)
            else:
                attributes = m[3] or m[6] or ""
                if tag in RAW:
                    end = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|\\Z)", re.I).search(html, at)
                    if tag in BLOCK:
                        self._flush()
                    at = end.end() if end else len(html)
                else:
                    self._open(tag, attributes)
        self._text(html[at:])
        self._flush()

    def features(self) -> np.ndarray:
        """What the classifier sees of each block: nothing of the elements that label it."""
        out = np.zeros((len(self.texts), len(DEFAULT)))
        for i, (text, linked, node) in enumerate(zip(self.texts, self.linked, self.nodes, strict=True)):
            tag, n = node.tag if node else "", len(text)
            marks = sum(map(text.count, ".,;:!?。，"))
            out[i, :9] = 1, tag == "p", tag in HEADING, tag == "li", tag in ("td", "th"), min(n, 400) / 200, min(linked / n, 1.0), min(20 * marks / n, 1.0), min(text.count(" ") + 1, 40) / 40
            names = node.names if node else 0
            while names:
                low = names & -names
                out[i, 8 + low.bit_length()] = 1
                names ^= low
        return out

    def labels(self) -> list[float]:
        """1 for blocks that their elements place in an article, 0 for those in menus and the like, -1 for all others."""
        return [-1.0 if o is None else 1.0 if o.good and o.score > 0 else 0.0 if o.score <= -7 else -1.0 for o in self.nodes]

    def odds(self, weights: np.ndarray = DEFAULT) -> list[float]:
        """The log-odds of each block being content."""
        said = np.clip(self.features() @ weights, -MOST, MOST)
        context = np.array([o.score if o else 0.0 for o in self.nodes])
        return (context + said - (3.0 * (context <= 0) if self.has_article else 0.0)).tolist()


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the least logistic loss, both classes weighing the same, near DEFAULT."""
    if not (labels > 0).any() or not (labels == 0).any():
        return DEFAULT
    share = np.where(labels > 0, 0.5 / max((labels > 0).sum(), 1), 0.5 / max((labels == 0).sum(), 1))

    def gradient(step: np.ndarray) -> np.ndarray:
        return features.T @ (share * (sigmoid(features @ (DEFAULT + step)) - labels)) + ridge * step

    return DEFAULT + adam(gradient, len(DEFAULT), 200)


def train(pages: DataFrame, max_pages: int = MAX_PAGES, html_col: str = "html") -> np.ndarray:
    """The classifier's weights from the labelled blocks of a bounded sample of pages; each page counts its distinct blocks once."""
    rows = pages.select(F.col(html_col).alias("html"), hash_unit(F.concat_ws(":", *[F.col(c).cast("string") for c in ("page_id", "url") if c in pages.columns], F.md5(F.substring(html_col, 1, 2000)))).alias("u")).where("html is not null")
    n = rows.count()
    rows = rows.where(F.col("u") < max_pages / max(n, 1)).select("html")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                kept: dict[tuple, int] = {}
                for page in part.column(0).to_pylist():
                    blocks = Blocks(page)
                    for x, y in {(tuple(x), y) for x, y in zip(blocks.features().round(3).tolist(), blocks.labels(), strict=True) if y >= 0}:
                        kept[x, y] = kept.get((x, y), 0) + 1
                yield pa.RecordBatch.from_pydict({"x": pa.array([list(k[0]) for k in kept], pa.list_(pa.float64())), "y": pa.array([k[1] for k in kept], pa.float64()), "n": pa.array(list(kept.values()), pa.int64())})

    found = rows.mapInArrow(run, "x array<double>, y double, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n")).orderBy("x", "y").toPandas()
    if found.empty:
        return DEFAULT
    return fit(np.repeat(np.stack(found["x"].to_numpy()), np.minimum(found["n"], 50), axis=0), np.repeat(found["y"].to_numpy(), np.minimum(found["n"], 50)))


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut: the smallest such side."""
    n = len(odds)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, z in enumerate(odds):
        if z > 0:
            join(source, i, z, 0.0)
        elif z < 0:
            join(i, sink, -z, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in heads[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        at = [0] * (n + 2)
        while True:  # one augmenting path after another, without recursion
            path, u = [], source
            while u != sink:
                while at[u] < len(heads[u]):
                    e = heads[u][at[u]]
                    if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(heads[u]):
                    path.append(heads[u][at[u]])
                    u = to[path[-1]]
                elif u == source:
                    break
                else:
                    e = path.pop()
                    u = to[e ^ 1]
                    at[u] += 1
            if u != sink:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
    return [level[i] >= 0 for i in range(n)]


def _shared(a: _Open | None, b: _Open | None) -> tuple[int, int]:
    """The depth of the nearest element around both, and the greater depth of the two."""
    deepest = max(a.depth if a else 0, b.depth if b else 0)
    while a is not b:
        if b is None or (a is not None and a.depth >= b.depth):
            a = a.outer
        else:
            b = b.outer
    return a.depth if a else 0, deepest


def label(blocks: Blocks, weights: np.ndarray = DEFAULT) -> list[bool]:
    """Which blocks are content."""
    odds = blocks.odds(weights)
    parent = [o.outer if o and o.tag in ("p", "li", *HEADING) else o for o in blocks.nodes]
    group, sums, first = [], [], []
    for i, z in enumerate(odds):
        if i and parent[i] is parent[i - 1] and (z > 0) == (odds[i - 1] > 0):
            sums[-1] += z
        else:
            sums.append(z)
            first.append(i)
        group.append(len(sums) - 1)
    edges, last = [], {}
    for g, i in enumerate(first):
        key = id(parent[i])
        if g:
            common, deepest = _shared(parent[i], parent[first[g - 1]])
            edges.append((g - 1, g, ADJACENT * (common + 1) / (deepest + 1)))
        if key in last:
            edges.append((last[key], g, SHARED))
        last[key] = g
    side = min_cut(sums, edges)
    return [side[g] for g in group]


def extract(html: str | None, weights: np.ndarray = DEFAULT) -> str:
    """The main text of a page."""
    if not html:
        return ""
    blocks = Blocks(html)
    return " ".join(t for t, keep in zip(blocks.texts, label(blocks, weights), strict=True) if keep) if blocks.texts else ""


def main_text(pages: DataFrame, weights: np.ndarray = DEFAULT, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [extract(h, shared.value) for h in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    return mapped(pages, "text string, n_chars bigint", run, html_col)


def report(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", "html")
    return main_text(rows, train(rows)).drop("html")
