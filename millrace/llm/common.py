"""Helpers that several operators share: column hygiene and vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are handled at once. A longer text is a run of its own; its words are found and hashed in segments.
CHUNK_BYTES = 1 << 20


def tidy(run: Callable) -> Callable:
    """run over the batches of a task, then give free memory back: a worker lives on and serves later stages."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return task


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, Column]]:
    """df with columns of these names (in any case) renamed, and for each column of df the expression that gives it back."""
    taken = {n.lower() for n in names}
    now = [f"aside{i}__" if c.lower() in taken else c for i, c in enumerate(df.columns)]
    return df.toDF(*now), {c: F.col(f"`{n}`").alias(c) for c, n in zip(df.columns, now, strict=True)}


def fold(col: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo: the folds that the contracts name. Null ids are in fold 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(0))


def hash_unit(col: Column) -> Column:
    """A fixed uniform number in [0, 1) for a value; samples drawn by it are the same in every run."""
    return (F.xxhash64(col).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About bound rows at most, chosen by a hash of key: deterministic, one count and a filter, no sort."""
    n = df.count()
    return df if n <= bound else df.where(hash_unit(F.col(key)) < bound / n)


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of batch with at most about size bytes of text each (one row at least)."""
    lengths = np.diff(utf8(batch.column(batch.schema.get_field_index(text)))[1])
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > size:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += int(n)
    if lo < batch.num_rows:
        yield batch.slice(lo)


def pieces(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """The column; or, for one text of more than size bytes, its pieces of about size bytes, cut behind white space.

    Text without white space is cut between characters. Pieces follow each other without a gap.
    """
    raw, offsets = utf8(column)
    if len(column) != 1 or len(raw) <= size:
        yield column
        return
    lo, space = 0, ~NON_SPACE
    while lo < len(raw):
        hi = min(lo + size, len(raw))
        if hi < len(raw):
            at = np.flatnonzero(space[raw[lo:hi]])
            if len(at):
                hi = lo + int(at[-1]) + 1
            else:
                while raw[hi] & 0xC0 == 0x80:
                    hi -= 1
        yield pa.array([raw[lo:hi].tobytes().decode()], pa.string())
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (rows + 1); a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SEGMENT = 1 << 20
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_SEGMENT + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


#: Words of ASCII digits and letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
#: Words of everything but ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False


class Words:
    """The words of a run of texts: start and end byte, text number and 64-bit hash of each."""

    def __init__(self, column: pa.Array, word: np.ndarray = ALNUM, lower: bool = True):
        raw, self.offsets = utf8(column)
        self.n_docs = len(self.offsets) - 1
        self.data = lower_ascii()[raw] if lower else raw
        # segment by segment, so that a very long text takes little more than its bytes and its words
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edge = self.offsets[1:-1]
        for lo in range(0, len(raw), _SEGMENT):
            hi = min(lo + _SEGMENT, len(raw))
            inside = np.zeros(hi - lo + 2, bool)  # one more on either side
            inside[1:-1] = word[raw[lo:hi]]
            inside[0] = lo > 0 and word[raw[lo - 1]]
            inside[-1] = hi < len(raw) and word[raw[hi]]
            here = edge[np.searchsorted(edge, lo) : np.searchsorted(edge, hi, "right")] - lo
            begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
            at = here[here < hi - lo]
            begins[at] = inside[at + 1]
            at = here[here > 0] - 1
            stops[at] = inside[at + 1]
            starts.append(np.flatnonzero(begins) + lo)
            ends.append(np.flatnonzero(stops) + lo + 1)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.hash = self._hashes() if len(self.start) else np.zeros(0, np.uint64)

    def _hashes(self) -> np.ndarray:
        """Polynomial hashes by prefix sums, segment by segment; longer words are hashed one at a time."""
        if not _POWERS:
            _POWERS["up"], _POWERS["down"] = _powers(_P), _powers(_PINV)
        up, down = _POWERS["up"], _POWERS["down"]
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, base + _SEGMENT, "right")))
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            if e[-1] <= _SEGMENT:
                sums = np.zeros(e[-1] + 1, np.uint64)
                np.cumsum(_BYTE[self.data[base : base + e[-1]]] * up[: e[-1]], out=sums[1:])
                out[lo:hi] = (sums[e] - sums[s]) * down[s]
            else:
                h = np.uint64(0)
                for at in range(0, int(e[-1]), _SEGMENT):
                    part = _BYTE[self.data[base + at : min(base + at + _SEGMENT, base + e[-1])]]
                    with np.errstate(over="ignore"):
                        h = mix(np.array([h * _P + (part * up[: len(part)]).sum(dtype=np.uint64)]))[0]
                out[lo] = h
            lo = hi
        return mix(out + (self.end - self.start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of size words inside one text."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 : size - 1 + n])
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        return at, mix(h[at] + np.uint64(size))

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of every window; a text of fewer words, but not none, has one of all its words."""
        at, h = self.windows(size)
        doc = self.doc[at]
        counts = np.diff(self.first)
        parts = [(doc, h)]
        for k in range(1, size):
            short = np.flatnonzero(counts == k)
            if len(short):
                v = np.zeros(len(short), np.uint64)
                for j in range(k):
                    v = v * np.uint64(0xD6E8FEB86659FD93) + self.hash[self.first[short] + j]
                parts.append((short, mix(v + np.uint64(k))))
        if len(parts) == 1:
            return doc, h
        doc, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(doc, kind="stable")
        return doc[order], h[order]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name not in new}
    return pa.RecordBatch.from_pydict(kept | new)


def mapped(df: DataFrame, columns: str, f, text: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """df with more columns (a DDL string) that f makes from runs of rows: f(batch) -> {name: array}."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(columns)
    base = without(df, *added.names)
    schema = StructType(base.schema.fields + added.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, size):
                out = with_columns(part, f(part))
                yield out.select(schema.names)

    return base.mapInArrow(tidy(run), schema)
