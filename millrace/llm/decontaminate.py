"""Benchmark decontamination: broadcast hash sets of normalised benchmark n-grams, scanned over every document.

Normalisation: A-Z is lower-cased; words are runs of ASCII digits and letters and characters beyond ASCII.
A window is ten consecutive words of an item; an item of fewer words, but not none, is one window.

The benchmark goes to the executors in blocks of at most max_windows windows and max_bytes bytes of window text
(proven bounds). A benchmark within the bounds is one block and one pass; a larger one takes further passes over the
documents, written in between, so neither the driver nor a worker ever holds more than one block. A window knows its
items by number only as long as they are few: a window in more than MAX_IDS items stands for the list of its items by
its hash, and their ids are joined to the documents it hits afterwards. Documents are not shuffled by a scan.

Defined results: null or empty text has no words and is clean; items without words are ignored; repeated
items and repeated documents count each by themselves; items with a null id hit words but are not listed;
an empty benchmark leaves all documents clean; a very long text is scanned whole, its words found in segments; columns whose names clash with the added ones are
replaced by mark and report and kept by decontaminate.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Words, mapped, set_aside, without
from millrace.session import written

#: The fixed definition of a word.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WINDOW = 10
MAX_WINDOWS = 1_000_000
MAX_BYTES = 128 << 20
#: Items that a window in a block names itself.
MAX_IDS = 64
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}

ADDED = "n_words bigint, n_hit bigint, hit_items array<string>, hit_words array<bigint>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_UPPER))


def item_windows(text: str | None, size: int = WINDOW) -> set[tuple[str, ...]]:
    words = words_of(text)
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1)} if words else set()


class Block:
    """Windows of the benchmark by their 64-bit hash, sorted, by length; the words and item ids for the exact check."""

    def __init__(self, windows: dict[tuple[str, ...], set[str]]):
        by: dict[int, list] = defaultdict(list)
        for words, ids in windows.items():
            by[len(words)].append((" ".join(words), sorted(ids)))
        self.many = any(MANY in ids for ids in windows.values())
        self.sets = {}
        for size, entries in by.items():
            _, hashes = Words(pa.array([e[0] for e in entries])).windows(size)
            order = np.argsort(hashes, kind="stable")
            table = defaultdict(list)
            for h, (text, ids) in zip(hashes.tolist(), entries, strict=True):
                table[h].append((text.encode(), ids))
            self.sets[size] = (hashes[order], dict(table))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, max_windows: int, max_bytes: int = MAX_BYTES) -> Iterator[Block]:
    """Blocks of the benchmark, read partition by partition. Of a window's items the first MAX_IDS are named, then MANY."""
    held: dict[tuple[str, ...], set[str]] = {}
    room = max_bytes
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for row in rows.toLocalIterator(prefetchPartitions=False):
        for window in item_windows(row["t"], size):
            if window not in held:
                cost = sum(map(len, window)) + 200
                if held and (len(held) >= max_windows or room < cost):
                    yield Block(held)
                    held, room = {}, max_bytes
                held[window] = set()
                room -= cost
            ids = held[window]
            if row["i"] is not None and row["i"] not in ids and MANY not in ids:
                ids.add(row["i"] if len(ids) < MAX_IDS else MANY)
                room -= len(row["i"]) + 60
    if held:
        yield Block(held)


#: Stands for all items of a window that has more than MAX_IDS; no id has this character.
MANY = "\uffff"


def many_items(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """window and item of the windows in more than MAX_IDS items; window is the words, space-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted({" ".join(w) for w in item_windows(text, size)})
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(found), pa.string()), "window": pa.array(found, pa.string())})

    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    pairs = rows.mapInArrow(run, "item string, window string").distinct()
    often = pairs.groupBy("window").agg(F.count("*").alias("n")).where(F.col("n") > MAX_IDS).select("window")
    return pairs.join(often, "window")


def _scan(words: Words, block: Block) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Marks of the words inside an occurrence of a window, and the items found in each text."""
    edge = np.zeros(len(words.start) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for size, (known, table) in block.sets.items():
        at, h = words.windows(size)
        if not len(at):
            continue
        where = np.minimum(np.searchsorted(known, h), len(known) - 1)
        for k in np.flatnonzero(known[where] == h):
            i = int(at[k])
            found = b" ".join(words.data[words.start[j] : words.end[j]].tobytes() for j in range(i, i + size))
            for text, ids in table[int(h[k])]:
                if text == found:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items[int(words.doc[i])].update(MANY + text.decode() if x == MANY else x for x in ids)
    return np.cumsum(edge[:-1]) > 0, items


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text: str = "text",
         size: int = WINDOW, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_items (sorted ids) and hit_words (numbers of the hit words of each text)."""
    sc = docs.sparkSession.sparkContext
    out = without(docs, "n_words", "n_hit", "hit_items", "hit_words")
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hit_items": F.array().cast("array<string>"), "hit_words": F.array().cast("array<bigint>")})
    found, many = None, False
    for block in blocks(benchmark, id_col, item_text, size, max_windows, max_bytes):
        if found is not None:
            out = written(out)  # else one task would hold the blocks of all passes
            last.destroy()
        last = sc.broadcast(block)
        found = out = _pass(out, last, text_col)
        many |= block.many
    if found is None:
        return _pass(out, sc.broadcast(Block({})), text_col)
    return _named(found, many_items(benchmark, id_col, item_text, size)) if many else found


def _named(marked: DataFrame, many: DataFrame) -> DataFrame:
    """marked with the windows in hit_items that stand for all of their items replaced by these."""
    rows = written(marked.withColumn("row__", F.monotonically_increasing_id()))
    stands = F.exists("hit_items", lambda x: x.startswith(MANY))
    spread = rows.where(stands).select("row__", F.explode("hit_items").alias("x"))
    meant = spread.where(F.col("x").startswith(MANY)).select("row__", F.substring("x", 2, 1 << 30).alias("window")).join(many, "window").select("row__", F.col("item").alias("x"))
    ids = spread.where(~F.col("x").startswith(MANY)).unionByName(meant).groupBy("row__").agg(F.array_sort(F.collect_set("x")).alias("ids__"))
    named = rows.where(stands).join(ids, "row__").withColumn("hit_items", F.col("ids__")).drop("row__", "ids__")
    return rows.where(~stands).drop("row__").unionByName(named)


def _pass(docs: DataFrame, block, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        words = Words(column[text_col])
        hit, items = _scan(words, block.value)
        old = column["hit_words"]
        if len(old.flatten()):
            rows = np.repeat(np.arange(len(old)), np.diff(old.offsets.to_numpy()))
            hit[words.first[rows] + old.flatten().to_numpy()] = True
        ids = [sorted(set(a) | items.get(i, set())) for i, a in enumerate(column["hit_items"].to_pylist())]
        at = np.flatnonzero(hit)
        per = np.bincount(words.doc[at], minlength=words.n_docs)
        offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
        return {
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "n_hit": pa.array(per, pa.int64()),
            "hit_items": pa.array(ids, pa.list_(pa.string())),
            "hit_words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(at - words.first[words.doc[at]], pa.int64())),
        }

    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit_items", "hit_words")]
    return _again(docs, keep, run, text_col)


def _again(docs: DataFrame, keep: list[str], run, text_col: str) -> DataFrame:
    """Like mapped, but run also reads the columns that it replaces."""
    from millrace.llm.common import chunks, tidy, with_columns

    schema = docs.select(*[f"`{c}`" for c in keep], "n_words", "n_hit", "hit_items", "hit_words").schema

    def each(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                yield with_columns(part, run(part)).select(schema.names)

    return docs.select(*[f"`{c}`" for c in schema.names]).mapInArrow(tidy(each), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", text_col: str = "text", **how) -> DataFrame:
    """docs without contamination; action "documents" drops contaminated rows, "spans" cuts the hit words and what stands between them."""
    docs, back = set_aside(docs, "n_words", "n_hit", "hit_items", "hit_words")
    marked = mark(docs, benchmark, text_col, **how)
    if action == "documents":
        return marked.where("n_hit = 0").select(*back.values())
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        hits = batch.column(batch.schema.get_field_index("hit_words")).to_pylist()
        return {"clean__": pa.array([_cut(t, h) for t, h in zip(texts, hits, strict=True)], pa.string())}

    clean = mapped(marked, "clean__ string", cut, text_col)
    return clean.select(*(back | {text_col: F.col("clean__").alias(text_col)}).values())


def _cut(text: str | None, hits: list[int]) -> str | None:
    if text is None or not hits:
        return text
    spans = [m.span() for m in WORD.finditer(text.translate(_UPPER))]
    out, at, k = [], 0, 0
    while k < len(hits):
        last = k
        while last + 1 < len(hits) and hits[last + 1] == hits[last] + 1:
            last += 1
        out.append(text[at : spans[hits[k]][0]])
        at = spans[hits[last]][1]
        k = last + 1
    return "".join(out) + text[at:]


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The digest of each document: counts, the items found and whether it is contaminated."""
    marked = mark(docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **how)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
