"""Hashed features of texts and a sparse logistic model over them, for the quality operators.

A text's features are the shares of its hashed words, word pairs and character trigrams (by code point) and a few dense
shares. Texts of more than CHUNK_BYTES bytes are read in pieces; word pairs and trigrams do not cross them.
Rows are collected to the driver only as a bounded sample of labelled or unlabelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import NON_SPACE, Words, mapped, mix, pieces, utf8

WORD_BITS = 14
PAIR_BITS = 14
GRAM_BITS = 14
N_DENSE = 6
PAIRS, GRAMS = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << PAIR_BITS)
DIM = GRAMS + (1 << GRAM_BITS) + N_DENSE + 1
SCALE = 20.0

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _count(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Piece:
    """Feature numbers of all words, word pairs and character trigrams of some texts, and what the dense features count."""

    def __init__(self, column: pa.Array, words: Words | None = None):
        w = words or Words(column, NON_SPACE, lower=False)
        raw, offsets = utf8(column)
        self.n = w.n_docs
        top = np.uint64(64 - WORD_BITS)
        pair = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(w.doc) > 1 else np.zeros(0, np.int64)
        pair_hash = mix(w.hash[pair] * np.uint64(0xD6E8FEB86659FD93) + w.hash[pair + 1])
        # code points: a byte starts one unless it is a continuation
        starts = np.flatnonzero(raw & 0xC0 != 0x80)
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.searchsorted(starts, offsets)
        chars = np.diff(first)
        m = max(len(codes) - 2, 0)
        gram = codes[:m] | codes[1 : m + 1] << np.uint64(21) | codes[2 : m + 2] << np.uint64(42)
        doc = np.repeat(np.arange(self.n), chars)
        inside = doc[:m] == doc[2:] if m else np.zeros(0, bool)
        self.sets = (
            ((w.hash >> top).astype(np.int64), w.doc),
            ((pair_hash >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + PAIRS, w.doc[pair]),
            (((gram[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + GRAMS, doc[:m][inside]),
        )
        same = np.bincount(w.doc[pair], w.hash[pair] == w.hash[pair + 1], self.n)
        self.counts = np.stack([
            *[np.bincount(d, minlength=self.n) for _, d in self.sets],
            _count(_UPPER[raw], offsets), _count(_MARK[raw], offsets), _count(_DIGIT[raw], offsets), same, np.diff(offsets),
        ], axis=1).astype(np.float64)


def dense(counts: np.ndarray) -> np.ndarray:
    """The dense features from the counts of Piece."""
    words, size = np.maximum(counts[:, 0], 1), np.maximum(counts[:, 7], 1)
    return np.stack([counts[:, 3] / size, counts[:, 4] / size, counts[:, 5] / size, counts[:, 6] / words, np.log1p(counts[:, 0]) / 10.0, counts[:, 7] / words / 20.0], axis=1)


def score(column: pa.Array, weights: np.ndarray, words: Words | None = None) -> np.ndarray:
    """The linear score of each text; words are those of the column if they are known."""
    n = len(column)
    sums, counts = np.zeros((n, 3)), np.zeros((n, 8))
    for part in pieces(column):
        piece = Piece(part, words if part is column else None)
        counts += piece.counts
        for k, (col, doc) in enumerate(piece.sets):
            sums[:, k] += np.bincount(doc, weights[col], n)
    return SCALE * (sums / np.maximum(counts[:, :3], 1)).sum(axis=1) + dense(counts) @ weights[-N_DENSE - 1 : -1] + weights[-1]


def rows(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns and values of each text's features, for training."""
    n = len(column)
    counts, held = np.zeros((n, 8)), [[] for _ in range(3)]
    for part in pieces(column):
        piece = Piece(part)
        counts += piece.counts
        for k, (col, doc) in enumerate(piece.sets):
            held[k].append(np.unique(doc.astype(np.int64) * DIM + col, return_counts=True))
    key, value = [], []
    for k, found in enumerate(held):
        keys, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        times = np.bincount(at, np.concatenate([x[1] for x in found]), len(keys))
        key.append(keys)
        value.append(SCALE * times / counts[keys // DIM, k])
    key, value = np.concatenate(key), np.concatenate(value)
    order = np.argsort(key)
    key, value = key[order], value[order]
    cuts, more, tail = np.searchsorted(key, np.arange(n + 1) * DIM), dense(counts), np.arange(DIM - N_DENSE - 1, DIM)
    cols, values = [], []
    for i in range(n):
        here = slice(cuts[i], cuts[i + 1])
        cols.append(np.concatenate([key[here] - i * DIM, tail]).astype(np.int32))
        values.append(np.concatenate([value[here], more[i], [1.0]]).astype(np.float32))
    return cols, values


@dataclass
class Sample:
    """Sparse rows in driver memory: bounded by the sample's size."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    extra: dict[str, np.ndarray]
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def take(self, keep: np.ndarray) -> "Sample":
        """The rows of a mask."""
        inside = keep[self.row]
        return Sample((np.cumsum(keep) - 1)[self.row[inside]], self.col[inside], self.value[inside], {k: v[keep] for k, v in self.extra.items()}, int(keep.sum()))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], DIM)


def collect(texts: DataFrame, extra: list[str]) -> Sample:
    """The features of a bounded sample; it has text and the columns of extra."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        cols, values = rows(batch.column(batch.schema.get_field_index("text")))
        return {"cols__": pa.array(cols, pa.list_(pa.int32())), "values__": pa.array(values, pa.list_(pa.float32()))}

    made = mapped(texts, "cols__ array<int>, values__ array<float>", run).drop("text").toArrow()
    order = pa.compute.sort_indices(made, sort_keys=[(c, "ascending") for c in extra])  # else the order of tasks would show
    made = made.take(order).combine_chunks()
    cols, values = (made.column(c).combine_chunks() if made.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("cols__", "values__"))
    if isinstance(cols, pa.ChunkedArray):
        cols, values = cols.chunk(0), values.chunk(0)
    row = np.repeat(np.arange(made.num_rows), np.diff(cols.offsets.to_numpy()))
    return Sample(row, cols.flatten().to_numpy(), values.flatten().to_numpy(), {c: made.column(c).to_numpy() for c in extra}, made.num_rows)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def adam(gradient, dim: int = DIM, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Minimises by Adam from zero; gradient(w) is the gradient at w."""
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def platt(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (positive) and offset that turn scores into probabilities, with Platt's smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * z + b)
        d, s = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * z).sum() + ridge * (a - 1), d.sum()])
        h = np.array([[(s * z * z).sum() + ridge, (s * z).sum()], [(s * z).sum(), s.sum() + ridge]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)
