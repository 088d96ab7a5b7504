"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (lower-cased; a text of fewer words is one shingle). A shingle's weight in a text
is (1 + ln tf) * idf, with
    idf = 1 + ln(N / max(df, LEAST_SHARE * N, 1)) / ln(1 / LEAST_SHARE),
from 1 for a shingle of every document to 2 for one of at most LEAST_SHARE of them. It depends on relative
frequencies only, so the same pair gets the same weights at any size of corpus. The range is narrow on purpose: in a
group of thousands of copies the common shingles are frequent and each copy's edits are rare, and with a wide range
copies of 95 % equal words would fall below the threshold.

Document frequencies are exact sums over all documents, keyed by 32-bit shingle hashes: every task adds up its own
shingles, ranges of hashes are merged by one task each (at most 2**32 / ranges sums in memory), and only shingles in
more than LEAST_SHARE of the documents come out. By the definition of the idf no others matter, and there are at most
(mean shingles a document) / LEAST_SHARE of them. Beyond MAX_FREQUENT the share is doubled until they fit. Other
shingles that share a hash add at most (mean shingles a document) / 2**32 of N to a frequency. A document counts by one
over the number of documents with its three smallest shingle hashes if these are more than LEAST_SHARE of all: a large
group of copies then counts about once.

Texts that are equal word for word are one class at once. The others are sampled BANDS * ROWS times (each sample
falls on the same shingle in two texts with the probability of their weighted Jaccard similarity), banded, and
candidates are verified by their exact weighted Jaccard similarity. Two texts of similarity 0.8 miss each other in all
bands once in 38,000 pairs, and more similar ones far more rarely.

Within a bucket, members are first compared with one leader, the text that shares buckets with the most others: in a
group of copies that is the original or what is nearest to it. This is done for all bands before anything else, so a
large group of near copies is one component by then, at a few comparisons a text. A bucket of more than LARGE texts that
still holds several components is banded again by further samples, up to LEVELS times, which parts texts that share a
passage only; the others, and what is left at last, are compared in groups of bounded size, each inside its task: texts
outside the bucket's largest component, BLOCK at a time, against all others, CHUNK at a time. Links that join components
come out, never all pairs. Rows of a bucket are dealt by (key, salt), a salt for every SALT rows.
Components are computed by star steps. Only text numbers and the shingles of texts in shared buckets are shuffled.

Defined results: null and empty texts and texts without words are classes of their own, with class_id their doc_id;
otherwise class_id is the smallest doc_id of the class (null if all its ids are null); repeated rows are exact copies;
a very long text is read in segments and sampled in slices; an empty table gives no rows; clashing columns are replaced
by classes and report and kept by deduplicated. n_links counts the verified links of a text that hold its class together (a spanning set:
a class of k different texts has k - 1 of them at least), not all pairs above the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from millrace.llm.common import Words, chunks, mix, tidy
from millrace.operators.components import components
from millrace.session import written

SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Bands whose leaders are met together, from and to.
BATCHES = ((0, 3), (4, 19))
#: Texts compared at once, and the others that they are compared with in one group.
BLOCK, CHUNK = 512, 4096
#: Texts of a bucket that is banded again if it holds several components, and how often.
LARGE, LEVELS = 4096, 2
#: Rows of a bucket that one salt takes.
SALT = 256
#: The share of documents below which all shingles weigh the same, and how many shingles may lie above it.
LEAST_SHARE = 1e-3
MAX_FREQUENT = 1 << 22
#: Ranges of shingle hashes that are summed by a task each; shingles that a task holds before it puts out sums.
RANGES = 256
HELD = 1 << 20
#: A bucket with more than this share of all rows is met by a broadcast: at most 1 / HOT_SHARE buckets.
HOT_SHARE = 1e-4
MARK_BITS = 24
RUN_BYTES = 512 << 10
SLICE = 1 << 17
_TABLE = 1 << 16


def shingle_table(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 32-bit hash and count of every distinct shingle, by text and hash."""
    doc, h = words.shingles(SIZE)
    keys = np.sort(doc.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32), counts


def copies_key(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each text's three smallest shingle hashes; 0 for a text without shingles."""
    out = np.zeros(n, np.int64)
    if len(doc):
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        key = np.zeros(len(starts), np.uint64)
        for k in range(3):
            least = np.minimum.reduceat(mix(h.astype(np.uint64) + np.uint64((k + 1) << 40)), starts)
            key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + least)
        out[doc[starts]] = (key | np.uint64(1)).view(np.int64)
    return out


def fingerprints(words: Words) -> list[str | None]:
    """128 bits for each text's words in order; None without words."""
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        out.append(hashlib.blake2b(words.hash[lo:hi].tobytes(), digest_size=16).hexdigest() if hi > lo else None)
    return out


def _numbers(prints: list[str | None]) -> pa.Array:
    """The first 64 bits of fingerprints, as signed numbers."""
    return pa.array([None if p is None else int.from_bytes(bytes.fromhex(p[:16]), "big", signed=True) for p in prints], pa.int64())


def row_hash(text: Column) -> Column:
    """A native hash of the raw text, by which a row is found again without reading its words."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def prints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, raw, print, number, copies and n_shingles; nulls and zeros for texts without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=RUN_BYTES):
                words = Words(part.column(2))
                doc, h, _ = shingle_table(words)
                made = fingerprints(words)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "raw": part.column(1), "print": pa.array(made, pa.string()), "number": _numbers(made),
                    "copies": pa.array(copies_key(doc, h, words.n_docs)), "n_shingles": pa.array(np.bincount(doc, minlength=words.n_docs), pa.int64()),
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_hash(F.col("text")).alias("raw"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, raw bigint, print string, number bigint, copies bigint, n_shingles bigint")


@dataclass
class Frequencies:
    """Shingle hashes in more than the least share of documents, sorted, and the idf of each and of all others."""

    hashes: np.ndarray
    values: np.ndarray
    rest: float

    def idf(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rest, np.float32)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.values[at[hit]]
        return out


def idf_of(share: np.ndarray | float, least: float = LEAST_SHARE) -> np.ndarray | float:
    """The idf of a shingle in a share of the documents."""
    return 1.0 + np.log(1.0 / np.clip(share, least, 1.0)) / math.log(1.0 / least)


def frequencies(docs: DataFrame, signed: DataFrame) -> Frequencies:
    """Exact document frequencies of all shingles that more than LEAST_SHARE of the documents hold."""
    spark = docs.sparkSession
    worded = signed.where("n_shingles > 0")
    total, shingles = worded.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    groups = worded.groupBy("copies").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") > LEAST_SHARE * total))
    rows = groups.orderBy("copies").collect()  # at most 1 / LEAST_SHARE
    keys, sizes = np.array([r["copies"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
    n = max(total - sizes.sum() + len(sizes), 1.0)
    shared = spark.sparkContext.broadcast((keys, 1.0 / sizes))

    def sums(hashes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, w = np.concatenate(hashes), np.concatenate(weights)
        order = np.argsort(h, kind="stable")
        h, w = h[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(w, first) if len(h) else w

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, w = sums([x[0] for x in held], [x[1] for x in held])
            held.clear()
            cuts = np.searchsorted(h, np.arange(RANGES + 1, dtype=np.uint64) * np.uint64((1 << 32) // RANGES))
            rows = {"k": [], "ones": [], "others": [], "weights": []}
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                hk, wk = h[cuts[k] : cuts[k + 1]], w[cuts[k] : cuts[k + 1]]
                one = wk == 1.0
                rows["k"].append(k)
                rows["ones"].append(hk[one].tobytes())
                rows["others"].append(hk[~one].tobytes())
                rows["weights"].append(wk[~one].tobytes())
            yield pa.RecordBatch.from_pydict({"k": pa.array(rows["k"], pa.int32()), **{c: pa.array(rows[c], pa.binary()) for c in ("ones", "others", "weights")}})

        for batch in batches:
            for run in chunks(batch, size=RUN_BYTES):
                words = Words(run.column(0))
                doc, h, _ = shingle_table(words)
                weight = np.ones(words.n_docs, np.float32)
                if len(keys):
                    key = copies_key(doc, h, words.n_docs)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    weight = np.where(keys[at] == key, parts[at], 1.0).astype(np.float32)
                held.append((h, weight[doc]))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from out()
        if held:
            yield from out()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list, list]] = {}

        def shrink(k: int) -> tuple[np.ndarray, np.ndarray]:
            h, w = sums(*found[k])
            found[k] = ([h], [w])
            return h, w

        grown: dict[int, int] = {}
        for batch in batches:
            for k, ones, others, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hs, ws = found.setdefault(k, ([], []))
                a, b = np.frombuffer(ones, np.uint32), np.frombuffer(others, np.uint32)
                hs += [a, b]
                ws += [np.ones(len(a), np.float32), np.frombuffer(weights, np.float32)]
                grown[k] = grown.get(k, 0) + len(a) + len(b)
                if grown[k] > 2 * HELD:
                    shrink(k)
                    grown[k] = 0
        for k in sorted(found):
            h, w = shrink(k)
            keep = w > LEAST_SHARE * n
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[keep].astype(np.int64)), "df": pa.array(w[keep].astype(np.float64))})

    kind = "k int, ones binary, others binary, weights binary"
    tasks = min(RANGES, max(1, -(-shingles // (4 * HELD))))  # of small corpora one task takes several ranges
    summed = docs.select("text").mapInArrow(tidy(part), kind).repartition(tasks, "k").mapInArrow(tidy(merge), "h bigint, df double")
    summed = written(summed)
    least = LEAST_SHARE
    while summed.where(F.col("df") > least * n).count() > MAX_FREQUENT:
        least *= 2
    found = summed.where(F.col("df") > least * n).toArrow()  # at most MAX_FREQUENT
    h, df = found.column("h").to_numpy().astype(np.uint32), found.column("df").to_numpy()
    order = np.argsort(h)
    return Frequencies(h[order], idf_of(df[order] / n, least).astype(np.float32), float(idf_of(max(least, 1.0 / n), least)))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the sampling distributions: r and ln c of Gamma(2, 1) variates, and beta of uniform ones."""
    u = (np.arange(_TABLE) + 0.5) / _TABLE
    g = np.full(_TABLE, 1.7)
    for _ in range(60):  # Newton's method for 1 - (1 + g) exp(-g) = u
        g = np.maximum(g - (1 - (1 + g) * np.exp(-g) - u) / np.maximum(g * np.exp(-g), 1e-12), 1e-4)
    g = np.sort(g)
    return g.astype(np.float32), np.log(g).astype(np.float32), u.astype(np.float32)


_GAMMA, _LOG_GAMMA, _UNIFORM = _tables()


def sample_bands(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts that have shingles, and their band keys (texts x BANDS); each level has samples of its own.

    For shingle s of weight w, with r, c of Gamma(2, 1) and beta uniform by the hash of (s, sample):
    t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1); the sample is the s and t of the least ln a, which
    that value itself tells apart. Shingles are taken in slices, which bounds the temporary arrays.
    """
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros((0, BANDS), np.int64)
    count = BANDS * ROWS
    cuts = np.unique(np.concatenate([starts, np.arange(0, len(doc), SLICE)]))
    least = np.empty((count, len(cuts)), np.float32)
    low = np.uint64(0xFFFF)
    odds = mix(np.arange(level * count + 1, (level + 1) * count + 1, dtype=np.uint64)) | np.uint64(1)
    at = 0
    for lo in range(0, len(doc), SLICE):
        hi = min(lo + SLICE, len(doc))
        to = int(np.searchsorted(cuts, hi))
        inside = cuts[at:to] - lo
        log_w = np.log(weight[lo:hi]).astype(np.float32)
        wide = mix(h[lo:hi].astype(np.uint64) + np.uint64(0x5BF0))
        for k in range(count):
            x = wide * odds[k]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            r = _GAMMA[x >> np.uint64(48)]
            beta = _UNIFORM[(x >> np.uint64(32)) & low]
            t = np.floor(log_w / r + beta)
            value = _LOG_GAMMA[(x >> np.uint64(16)) & low] - r * (t - beta + np.float32(1))
            least[k, at:to] = np.minimum.reduceat(value, inside)
        at = to
    if len(cuts) > len(starts):
        least = np.minimum.reduceat(least, np.searchsorted(cuts, starts), axis=1)
    keys = np.empty((len(starts), BANDS), np.int64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.ascontiguousarray(least[band * ROWS + row]).view(np.uint32))
        keys[:, band] = key.view(np.int64)
    return doc[starts], keys


def signatures(docs: DataFrame, shared) -> DataFrame:
    """number and bands of the texts that have words; a task signs equal texts once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, size=RUN_BYTES):
                words = Words(part.column(0))
                numbers = _numbers(fingerprints(words)).to_pylist()
                fresh = np.zeros(words.n_docs, bool)
                for i, number in enumerate(numbers):
                    if number is not None and number not in seen:
                        seen.add(number)
                        fresh[i] = True
                if len(seen) > 1 << 17:
                    seen.clear()
                doc, h, tf = shingle_table(words)
                keep = fresh[doc]
                doc, h, tf = doc[keep], h[keep], tf[keep]
                at, keys = sample_bands(doc, h, (1 + np.log(tf)) * shared.value.idf(h))
                yield pa.RecordBatch.from_pydict({"number": pa.array([numbers[i] for i in at.tolist()], pa.int64()), "bands": pa.array(list(keys), pa.list_(pa.int64()))})

    return docs.select("text").mapInArrow(tidy(run), "number bigint, bands array<bigint>")


def _marks(numbers: DataFrame) -> np.ndarray:
    """A bit array of the numbers modulo 2**MARK_BITS: at most 2 MB, built by tasks."""
    at = F.pmod("number", F.lit(1 << MARK_BITS)) + 1
    rows = numbers.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p"))
    found = rows.groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros((1 << MARK_BITS) // 8 + 4096, np.uint8)
    for row in found:
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["k"] - 1) * 4096 :][: len(bits)] = bits
    return out


def vectors(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """number, hashes and counts of the shingles of the wanted texts (and of the few that share a mark with them)."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 1 << 17:
                seen.clear()
            for part in chunks(batch, size=RUN_BYTES):
                words = Words(part.column(0))
                numbers = _numbers(fingerprints(words)).to_pylist()
                keep = []
                for i, n in enumerate(numbers):
                    if n is not None and n not in seen:
                        bit = n % (1 << MARK_BITS)
                        if marks.value[bit >> 3] >> (bit & 7) & 1:
                            seen.add(n)
                            keep.append(i)
                if not keep:
                    continue
                doc, h, tf = shingle_table(words)
                first = np.searchsorted(doc, np.arange(words.n_docs + 1))
                yield pa.RecordBatch.from_pydict({
                    "number": pa.array([numbers[i] for i in keep], pa.int64()),
                    "hashes": pa.array([h[first[i] : first[i + 1]].tobytes() for i in keep], pa.binary()),
                    "counts": pa.array([tf[first[i] : first[i + 1]].astype("<u2" if tf[first[i] : first[i + 1]].max() < 65536 else "<u4").tobytes() if tf[first[i] : first[i + 1]].max() > 1 else b"" for i in keep], pa.binary()),
                })

    return docs.select("text").mapInArrow(tidy(run), "number bigint, hashes binary, counts binary").dropDuplicates(["number"])


def _weights(hashes: bytes, counts: bytes, weights: Frequencies) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, np.uint32)
    w = weights.idf(h).astype(np.float64)
    if counts:
        w = w * (1 + np.log(np.frombuffer(counts, "<u2" if len(counts) == 2 * len(h) else "<u4")))
    return h, w


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted vectors."""
    (ha, wa), (hb, wb) = a, b
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    shared = np.minimum(wa[both], wb[at[both]]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def _leaders_met(rows: DataFrame, found: DataFrame, shared, least: float) -> DataFrame:
    """The links of each bucket's rows (key, salt, salts, number, order, component) to its leader that reach least."""
    leaders = rows.groupBy("key").agg(F.max_by(F.struct("number", "component"), "order").alias("l"), F.max("salts").alias("salts"))
    spread = leaders.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("l.number").alias("leader"), F.col("l.component").alias("leads"))
    pairs = rows.join(spread, ["key", "salt"]).where("component != leads").select("number", "leader", "salt").dropDuplicates(["number", "leader"])
    pairs = written(pairs)
    # a leader's shingles meet its rows by (leader, salt), so that no task holds all rows of one leader
    heads = pairs.select("leader", "salt").distinct().join(found.select(F.col("number").alias("leader"), F.col("hashes").alias("hb"), F.col("counts").alias("cb")), "leader")
    met = pairs.join(found, "number").join(heads, ["leader", "salt"]).select("number", "leader", "hashes", "counts", "hb", "cb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, tuple] | None = None
        for batch in batches:
            number, leader, ha, ca, hb, cb = (batch.column(k) for k in range(6))
            keep = []
            for i in range(batch.num_rows):
                lead = leader[i].as_py()
                if last is None or last[0] != lead:
                    last = (lead, _weights(hb[i].as_py(), cb[i].as_py(), shared.value))
                if similarity(last[1], _weights(ha[i].as_py(), ca[i].as_py(), shared.value)) >= least:
                    keep.append(i)
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": number.take(taken), "b": leader.take(taken)})

    return met.mapInArrow(tidy(run), "a bigint, b bigint")


def _compared(rows: DataFrame, found: DataFrame, shared, least: float) -> DataFrame:
    """Links (a, b) that join the components of each bucket's rows as all its similar pairs would.

    The texts outside the bucket's largest component are dealt into blocks, all its texts into chunks; each block meets
    each chunk in one group, whose memory is bounded and whose output is linear in its texts.
    """
    per = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("most"))
    per = per.select("key", "major", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("n") / SALT).cast("int").alias("salts"))
    dealt = rows.select("key", F.col("salt"), "number", "component").join(per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["key", "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("number", F.lit(1)), F.col("chunks")).cast("int"))
    all_blocks, all_chunks = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
    minor = dealt.where("component != major").select("key", "block", F.explode(all_chunks).alias("chunk"), F.lit(0).alias("side"), "number", "component")
    others = dealt.select("key", F.explode(all_blocks).alias("block"), "chunk", F.lit(1).alias("side"), "number", "component")
    met = minor.unionByName(others).join(found, "number").select("key", "block", "chunk", "side", "number", "component", "hashes", "counts")
    met = met.repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk", "side", "number")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                for row in batch.slice(lo, BLOCK).to_pylist():
                    key = (row["key"], row["block"], row["chunk"])
                    if key != at:
                        if group is not None:
                            yield group.links()
                        at, group = key, _Group(shared.value, least)
                    group.add(row)
        if group is not None:
            yield group.links()

    return met.mapInArrow(tidy(run), "a bigint, b bigint")


class _Group:
    """A block of texts that meets others BLOCK at a time; links that join components are kept."""

    def __init__(self, weights: Frequencies, least: float):
        self.weights, self.least = weights, least
        self.left: list[tuple[int, int, tuple]] = []
        self.right: list[tuple[int, int, tuple]] = []
        self.parent: dict[int, int] = {}
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, row: dict) -> None:
        side = self.right if row["side"] else self.left
        side.append((row["number"], row["component"], _weights(row["hashes"], row["counts"], self.weights)))
        if len(self.right) >= BLOCK:
            self._meet()

    def _find(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def _meet(self) -> None:
        if self.left and self.right:
            for i, j in zip(*np.nonzero(_bound([x[2] for x in self.left], [x[2] for x in self.right]) >= self.least - 1e-4), strict=True):
                x, y = self.left[i], self.right[j]
                p, q = self._find(x[1]), self._find(y[1])
                if p != q and similarity(x[2], y[2]) >= self.least:
                    self.parent[p] = q
                    self.a.append(x[0])
                    self.b.append(y[0])
        self.right = []

    def links(self) -> pa.RecordBatch:
        self._meet()
        return pa.RecordBatch.from_pydict({"a": pa.array(self.a, pa.int64()), "b": pa.array(self.b, pa.int64())})


def _bound(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """An upper bound of the similarity of each pair: the sum of geometric means is at least that of minima."""
    both = left + right
    total = np.array([w.sum() for _, w in both])
    row = np.repeat(np.arange(len(both)), [len(h) for h, _ in both])
    _, col, n = np.unique(np.concatenate([h for h, _ in both]), return_inverse=True, return_counts=True)
    root = np.sqrt(np.concatenate([w for _, w in both]))
    keep = n[col] > 1
    row, root = row[keep], root[keep]
    col = (np.cumsum(n > 1) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, root, col = row[order], root[order], col[order]
    shared = np.zeros((len(left), len(right)))
    width = 4096
    for lo in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((len(both), width), np.float32)
        part[row[a:b], col[a:b] - lo] = root[a:b]
        shared += part[: len(left)] @ part[len(left) :].T
    return shared / (total[: len(left), None] + total[None, len(left) :] - shared)


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (key, number, ...) of keys that several rows hold, with salt and salts; hot keys are met by a broadcast."""
    many = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    total = many.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_SHARE * total, 4 * SALT)
    few = many.where(hot).select("key", F.col("n").alias("hot"))
    if few.isEmpty():
        met = rows.join(many, "key")
    else:
        tagged = rows.join(F.broadcast(few), "key", "left")  # at most 1 / HOT_SHARE rows
        met = tagged.where("hot is null").drop("hot").join(many.where(~hot), "key").unionByName(tagged.where("hot is not null").withColumnRenamed("hot", "n"))
    salts = F.ceil(F.col("n") / SALT).cast("int")
    return met.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("number", F.lit(2)), F.col("salts")).cast("int"))


def _labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with the component of their text number; a text without links is its own."""
    named = parts.select(F.col("node").alias("number"), F.col("component").alias("found__"))
    return rows.join(named, "number", "left").withColumn("component", F.coalesce("found__", "number")).drop("found__")


def _open(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with it."""
    rows = written(_labelled(rows.drop("component"), parts))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("salts").alias("salts")).where("low != high")
    mixed = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return written(rows.join(mixed, ["key", "salt"], "left_semi"))


class _Links:
    """Verified links between text numbers, and the components that they make."""

    def __init__(self, spark):
        self.links = spark.createDataFrame([], "a bigint, b bigint")
        self.parts = spark.createDataFrame([], "node bigint, component bigint")

    def add(self, new: DataFrame) -> None:
        new = written(new)
        if not new.isEmpty():
            old = self.parts.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            self.links = self.links.unionByName(new)
            self.parts = written(components(new.unionByName(old)))


def _banded_again(rows: DataFrame, found: DataFrame, shared, level: int) -> DataFrame:
    """The rows of large buckets under keys of the bucket and a band of further samples."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = _weights(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), shared.value)
                _, keys = sample_bands(np.zeros(len(h), np.int64), h, w, level)
                yield pa.RecordBatch.from_pydict({"number": batch.column(0).slice(i, 1), "bands": pa.array(list(keys), pa.list_(pa.int64()))})

    wanted = rows.select("number").distinct()
    bands = written(found.join(wanted, "number", "left_semi").select("number", "hashes", "counts").mapInArrow(tidy(run), "number bigint, bands array<bigint>"))
    again = rows.select("key", "number", "order").join(bands, "number").select("key", "number", "order", F.explode("bands").alias("band"))
    return again.select(F.xxhash64("key", "band").alias("key"), "number", "order")


def _settle(rows: DataFrame, state: _Links, found: DataFrame, shared, least: float, level: int) -> None:
    """Adds the links of all buckets of rows (key, salt, salts, n, number, order) whose leaders have been met."""
    left = _open(rows.where("n > 2"), state.parts)  # a bucket of two is its leader and one other
    if left.isEmpty():
        return
    large = F.col("n") > (LARGE if level < LEVELS else 1 << 62)
    small = left.where(~large)
    if not small.isEmpty():
        state.add(_compared(small, found, shared, least))
        left = _open(left.where(large), state.parts)
    if level < LEVELS and not left.isEmpty():
        again = written(_crowded(_banded_again(left, found, shared, level + 1)))
        _lead(again, state, found, shared, least)
        _settle(again, state, found, shared, least, level + 1)


def _lead(rows: DataFrame, state: _Links, found: DataFrame, shared, least: float) -> None:
    """Adds the links of the buckets' rows to their leaders."""
    left = _open(rows, state.parts)
    if not left.isEmpty():
        state.add(_leaders_met(left, found, shared, least))


def link(docs: DataFrame, bands: DataFrame, shared, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between text numbers that join each component, and the component of each text that has one.

    Bands are taken a few at a time: what earlier bands have joined is not compared again, so a large group of near
    copies costs its members a few comparisons each and not one for every band.
    """
    rows = written(_crowded(bands.select("number", F.posexplode("bands").alias("band", "key"))))
    # a text that shares its buckets with the most others is nearest to all of them: the original among its copies
    central = rows.groupBy("number").agg(F.shiftleft(F.least(F.sum("n"), F.lit(1 << 30)), 32).bitwiseOR(F.xxhash64("number").bitwiseAND(F.lit((1 << 32) - 1))).alias("order"))
    rows = written(rows.join(central, "number"))
    found = written(vectors(docs, rows.select("number").distinct()))
    state = _Links(docs.sparkSession)
    for first, last in BATCHES:
        _lead(rows.where(F.col("band").between(first, last)), state, found, shared, least)
    _settle(rows.drop("band"), state, found, shared, least, 0)
    return state.links, state.parts


def classes(documents: DataFrame, text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, raw, print, component, class_id, class_size, n_texts and n_links of each document."""
    docs = documents.select("doc_id", F.col(text_col).alias("text"))
    signed = written(prints(docs))
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, signed))
    bands = written(signatures(docs, shared).groupBy("number").agg(F.first("bands").alias("bands")))
    links, parts = link(docs, bands, shared, least)
    texts = signed.where("print is not null").groupBy("print", "number").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    degree = links.select(F.explode(F.array("a", "b")).alias("number")).groupBy("number").agg(F.count("*").alias("n_links"))
    named = written(_labelled(texts, parts).join(degree, "number", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    sums = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts"))
    # texts of their own, nearly all, need no join with their class
    alone = named.where("n = 1 and n_links = 0").select("print", "component", F.col("rep").alias("class_id"), F.col("n").alias("class_size"), F.lit(1).cast("long").alias("n_texts"), "n_links")
    members = alone.unionByName(named.where("n > 1 or n_links > 0").select("print", "component", "n_links").join(sums, "component").select(*alone.columns))
    known = signed.where("print is not null").select("doc_id", "raw", "print").join(members, "print")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    blank = signed.where("print is null").select("doc_id", "raw", "print", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id"), one.alias("class_size"), one.alias("n_texts"), none.alias("n_links"))
    return known.select(*blank.columns).unionByName(blank)


def report(documents: DataFrame) -> DataFrame:
    found = classes(documents)
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("representative"), "class_size", "n_texts", "n_links")


def deduplicated(documents: DataFrame, text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """documents less all but one of each class; texts without words all stay.

    Rows are found again by a native hash of their text. Only rows that carry a mark of a class with several members are
    shuffled; all others pass as they are read.
    """
    found = written(classes(documents, text_col, least).where("component is not null and class_size > 1").select("doc_id", "raw", "print", "component", "class_id"))
    # of the rows whose id is the class's, the least: ids may be null or stand with several texts
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min(F.struct("print", "raw", "doc_id")).alias("k"))
    keep = keep.select(_key(F.col("k.raw"), F.col("k.doc_id")).alias("key__"), F.lit(True).alias("stays__"))
    keys = written(found.select(_key(F.col("raw"), F.col("doc_id")).alias("key__")).distinct().join(keep, "key__", "left"))
    marks = documents.sparkSession.sparkContext.broadcast(_marks(found.select(F.col("raw").alias("number")).distinct()))

    @pandas_udf("boolean")
    def marked(raw: pd.Series) -> pd.Series:
        bit = raw.to_numpy() % (1 << MARK_BITS)
        return pd.Series((marks.value[bit >> 3] >> (bit & 7) & 1).astype(bool))

    columns = [f"`{c}`" for c in documents.columns]
    rows = documents.withColumn("raw__", row_hash(F.col(text_col))).withColumn("marked__", marked("raw__"))
    met = rows.where("marked__").withColumn("key__", _key(F.col("raw__"), F.col("doc_id"))).join(keys.withColumn("known__", F.lit(True)), "key__", "left")
    one = met.where("stays__").dropDuplicates(["key__"])
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in (rows.where("not marked__"), met.where("known__ is null"), one)])


def _key(raw: Column, doc_id: Column) -> Column:
    """A text under an id, as one string."""
    return F.concat(raw.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
