"""Quality rules: fixed counts, then a calibrated logistic regression over hashed words and character n-grams.

Words are runs of anything but ASCII white space. A document fails the base rules with fewer than 20 words or
with more than 30 in 100 of its words inside 8-word windows that its text holds twice or more. The others are
kept if the calibrated probability of the label 1 reaches KEEP.

The regression is trained on at most max_rows labelled rows, drawn by a hash of doc_id, and calibrated by Platt's
method on a fifth of them that the fit does not see; scoring runs over whole texts in Arrow batches.

The features are hashed words, word pairs and character trigrams by code point, and a few dense shares. A very long text
is counted whole and scored in pieces.

Defined results: a null text has no words and fails; null labels and null ids are not trained on, repeated labels
count as the highest, and of several texts of one id the first in order is trained on; without labels of both classes the regression keeps every document; a table may be empty;
columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NON_SPACE, Words, bounded_sample, hash_unit, mapped, utf8
from millrace.llm.features import DIM, N_DENSE, adam, collect, platt, sigmoid
from millrace.llm.quality_pu import Model

MAX_ROWS = 4000
KEEP = 0.3
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30

#: The fixed set of symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

ADDED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"


def _sums(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) == 2:  # a very long text is alone
        return np.array([np.count_nonzero(mark)])
    sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def dup_lines(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """For each text, its lines with a word that equal an earlier line."""
    data, out = raw.tobytes(), []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        seen: set[bytes] = set()
        n = 0
        for line in data[lo:hi].split(b"\n"):
            if line.strip(b" \t\n\v\f\r"):
                n += line in seen
                seen.add(line)
        out.append(n)
    return out


def repeat_words(words: Words, size: int = WINDOW) -> np.ndarray:
    """For each text, its words inside windows of size words that occur twice or more in it."""
    at, h = words.windows(size)
    edge = np.zeros(len(words.start) + 1, np.int64)
    if len(at):
        order = np.lexsort((h, words.doc[at]))
        doc, key = words.doc[at][order], h[order]
        equal = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])
        again = np.zeros(len(at), bool)
        again[1:] |= equal
        again[:-1] |= equal
        first = at[order[again]]
        np.add.at(edge, first, 1)
        np.add.at(edge, first + size, -1)
    return np.bincount(words.doc, np.cumsum(edge[:-1]) > 0, words.n_docs).astype(np.int64)


def measure(column: pa.Array, words: Words | None = None) -> dict[str, pa.Array]:
    raw, offsets = utf8(column)
    words = words or Words(column, NON_SPACE, lower=False)
    n_words, repeated = np.diff(words.first), repeat_words(words)
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "word_chars": pa.array(_sums(NON_SPACE[raw] & ((raw & 0xC0) != 0x80), offsets), pa.int64()),
        "n_symbols": pa.array(_sums(SYMBOLS[raw], offsets), pa.int64()),
        "n_dup_lines": pa.array(dup_lines(raw, offsets), pa.int64()),
        "n_repeat_words": pa.array(repeated, pa.int64()),
        "base_failed": pa.array(failed, pa.bool_()),
    }


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, ridge: float = 1e-4) -> Model:
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = bounded_sample(marks, "doc_id", max_rows).withColumn("part", F.floor(hash_unit(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))) * 5))
    rows = documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "quality", "part").agg(F.min("text").alias("text"))
    sample = collect(rows, ["doc_id", "quality", "part"])
    y, fit = (sample.extra["quality"] > 0).astype(float), sample.extra["part"] != 0
    if not sample.n or y[fit].min(initial=1) == y[fit].max(initial=0) or not (~fit).any():
        return Model(np.zeros(DIM), 1.0, 40.0)
    weight = np.where(fit, np.where(y > 0, 0.5 / max(y[fit].sum(), 1), 0.5 / max((1 - y[fit]).sum(), 1)), 0.0)

    def gradient(w: np.ndarray) -> np.ndarray:
        g = sample.back(weight * (sigmoid(sample.dot(w)) - y))
        g[: -N_DENSE - 1] += ridge * w[: -N_DENSE - 1]
        return g

    weights = adam(gradient, DIM, 300)
    z = sample.dot(weights)
    return Model(weights, *platt(z[~fit], y[~fit]))


def judge(documents: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """documents with the counts, base_failed, probability and kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(batch.schema.get_field_index(text_col))
        words = Words(column, NON_SPACE, lower=False)
        out = measure(column, words)
        p = shared.value.score(column, words)
        kept = (p >= keep) & ~out["base_failed"].to_numpy(zero_copy_only=False)
        return out | {"probability": pa.array(p, pa.float64()), "kept": pa.array(kept, pa.bool_())}

    return mapped(documents, ADDED, run, text_col)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents.select("doc_id", "text"), train(documents, labels)).drop("text")
