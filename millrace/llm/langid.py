"""Language identification by interpolated Kneser-Ney character models, one a language.

Letters are lower-cased code points; every run of other characters is one space. Letters beyond U+FFFF stand for one of
8,448 codes that no letter has, by their number. The n-grams of all orders are stored as sorted arrays of 64-bit hashes,
one table for all languages whose rows list the languages that have the n-gram and the interpolated log probability of
its last character there; a second table lists the back-off weights of contexts likewise. The memory is that of the
n-grams seen, not their product with the languages. A text's language is the one with the lowest cross-entropy a
character. Whole texts are scored; one of more than RUN_BYTES bytes is read in pieces cut at white space, each of which
begins like a text. Of languages that tie, the first in order is given.

Rejection is calibrated on training documents that the counts do not see: the cross-entropy of a language's own
texts has a mean and a variance that falls with their length; a text is rejected if it lies further above the mean
than nearly all calibration texts do, with a margin. Texts without a letter are rejected as "und".

Training counts the n-grams of all training documents but those set aside for calibration: a fifth of a sample of about
max_chars characters a language, drawn by a hash of doc_id, and none of a language with fewer than LEAST_COUNTED others.

Defined results: null text or a text without letters gives und, score 0 and is rejected; a null lang is never
learned; with nothing to learn from every text is und; repeated rows count as often as they occur; an empty table
gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, fold, hash_unit, mapped, mix, pieces, tidy

ORDER = 4
MAX_CHARS = 2_000_000
FOLDS, HELD = 4, 2
#: Documents that a language needs beside a fifth of them before any is set aside for calibration.
LEAST_COUNTED = 5
#: Distinct n-grams that a task holds before it puts out their counts.
HELD_GRAMS = 1 << 20
#: The share of calibration documents beyond which a text may be rejected, and the factor on their distance.
QUANTILE, MARGIN, LEAST_DISTANCE = 0.999, 2.0, 8.0
#: Nats a character above its language's mean below which no text is rejected: few training texts leave the mean too low.
LEAST_EXCESS = 1.25
SPACE = 0x20
#: Bytes of text that are handled at once; each takes some hundred bytes of memory here.
RUN_BYTES = 256 << 10
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


class Chars:
    """Normalised characters of some texts, with ORDER - 1 spaces before each; doc numbers of the scored places."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        raw = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.fromiter(map(len, lowered), np.int64, len(lowered))
        doc = np.repeat(np.arange(len(texts)), counts)
        letter = letters()[raw]
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        edges = starts[(counts > 0)]
        keep[edges] = letter[edges]  # the spaces before a text stand for its leading other characters
        kept, doc = np.where(letter, np.where(raw > 0xFFFF, 0xD800 + (raw - 0x10000) % 8448, raw), SPACE)[keep], doc[keep]
        self.letters = np.bincount(doc, kept != SPACE, len(texts)).astype(np.int64)
        n = np.bincount(doc, minlength=len(texts))
        pad = ORDER - 1
        at = np.arange(len(kept)) + pad * (doc + 1)
        self.codes = np.full(len(kept) + pad * len(texts), SPACE, np.uint64)
        self.codes[at] = kept
        self.at, self.doc, self.n = at, doc, n

    def grams(self) -> np.ndarray:
        """The n-gram that ends at each scored place, 16 bits a character, the last one lowest."""
        g = self.codes[self.at]
        for back in range(1, ORDER):
            g = g | self.codes[self.at - back] << np.uint64(16 * back)
        return g


def tail(grams: np.ndarray, order: int) -> np.ndarray:
    return grams if order == 4 else grams & np.uint64((1 << 16 * order) - 1)


class HashArray:
    """Sorted 64-bit hashes of n-grams; find gives the row of each query or -1."""

    def __init__(self, grams: np.ndarray):
        keys = mix(grams)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.bits = max(4, min(20, int(len(keys)).bit_length() + 1))
        self.begin = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.longest = int(np.diff(np.append(self.begin, len(keys))).max(initial=0))

    def find(self, grams: np.ndarray) -> np.ndarray:
        out = np.full(len(grams), -1, np.int64)
        if not len(self.keys):
            return out
        q = mix(grams)
        at = self.begin[(q >> np.uint64(64 - self.bits)).astype(np.int64)]
        last = len(self.keys) - 1
        hit = self.keys[np.minimum(at, last)] == q
        out[hit] = at[hit]
        left = np.flatnonzero(~hit)
        for step in range(1, self.longest):
            if not len(left):
                break
            p = at[left] + step
            hit = self.keys[np.minimum(p, last)] == q[left]
            out[left[hit]] = p[hit]
            left = left[~hit]
            left = left[self.keys[np.minimum(at[left] + step, last)] < q[left]]
        return out


class Table:
    """Values of (n-gram, language) pairs, stored by n-gram: those seen only."""

    def __init__(self, languages: list[tuple[np.ndarray, np.ndarray]]):
        """The n-grams and values of each language."""
        grams = np.concatenate([g for g, _ in languages]) if languages else np.zeros(0, np.uint64)
        keys, row = np.unique(grams, return_inverse=True)
        self.index = HashArray(keys)
        place = np.empty(len(keys), np.int64)
        place[self.index.order] = np.arange(len(keys))
        at = place[row]
        language = np.repeat(np.arange(len(languages)), [len(g) for g, _ in languages])
        order = np.argsort(at, kind="stable")
        self.language = language[order].astype(np.int32)
        self.value = np.concatenate([v for _, v in languages])[order] if languages else np.zeros(0)
        self.first = np.searchsorted(at[order], np.arange(len(keys) + 1))
        del self.index.order

    def dense(self, grams: np.ndarray, languages: int, absent: float) -> np.ndarray:
        """The values of each n-gram in each language, absent where it has none."""
        out = np.full((len(grams), languages), absent)
        row = self.index.find(grams)
        hit = np.flatnonzero(row >= 0)
        lo, n = self.first[row[hit]], self.first[row[hit] + 1] - self.first[row[hit]]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hit) else np.zeros(0, np.int64)
        out[np.repeat(hit, n), self.language[at]] = self.value[at]
        return out


@dataclass
class Model:
    languages: list[str]
    tables: list[Table]  # log probabilities, by order from 1
    contexts: list[Table]  # log back-off weights, by the context's order from 0
    unseen: float  # log probability of a character that no language has
    distance: np.ndarray | None = None  # by language: mean, between-text variance, within-text variance
    limit: float = np.inf
    scale: float = 1.0

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        n = len(self.languages)
        out, todo = np.zeros((len(grams), n)), np.ones((len(grams), n), bool)
        active = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            tails = tail(grams[active], order)
            value = self.tables[order - 1].dense(tails, n, np.nan)
            left = todo[active]
            hit = left & ~np.isnan(value)
            out[active] += np.where(hit, value, 0.0)
            left &= ~hit
            todo[active] = left
            some = left.any(axis=1)
            active, left, tails = active[some], left[some], tails[some]
            if not len(active):
                return out
            out[active] += np.where(left, self.contexts[order - 1].dense(tails >> np.uint64(16), n, 0.0), 0.0)
        out[active] += np.where(todo[active], self.unseen, 0.0)
        return out

    def sums(self, chars: Chars) -> np.ndarray:
        """Minus the log probability of each text in each language."""
        grams, doc = chars.grams(), chars.doc
        total = np.zeros((len(chars.n), len(self.languages)))
        step = max(1, (1 << 19) // max(len(self.languages), 1))
        for lo in range(0, len(grams), step):
            seen, at = np.unique(grams[lo : lo + step], return_inverse=True)
            logp = self.log_probabilities(seen)[at]
            for k in range(len(self.languages)):
                total[:, k] -= np.bincount(doc[lo : lo + step], logp[:, k], len(chars.n))
        return total

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text in each language, and the number of its characters and letters."""
        total, n, letter = 0.0, 0, 0
        for part in pieces(texts, RUN_BYTES):
            chars = Chars(part.to_pylist())
            total, n, letter = total + self.sums(chars), n + chars.n, letter + chars.letters
        return total / np.maximum(n, 1)[:, None], n, letter

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        if not self.languages:
            nil = np.zeros(len(texts))
            return ["und"] * len(texts), nil, nil, np.ones(len(texts), bool)
        h, n, letter = self.entropies(texts)
        best = h.argmin(axis=1)
        own = h[np.arange(len(h)), best]
        gap = np.exp(-np.clip((h - own[:, None]) * np.sqrt(np.maximum(n, 1))[:, None] * self.scale, 0, 60))
        blank = letter == 0
        score = np.where(blank, 0.0, 1.0 / gap.sum(axis=1))
        far = np.zeros(len(h), bool) if self.distance is None else (self._distance(own, n, best) > self.limit) & (own > self.distance[best, 0] + LEAST_EXCESS)
        return ["und" if b else self.languages[k] for k, b in zip(best, blank, strict=True)], score, own, far | blank

    def _distance(self, own: np.ndarray, n: np.ndarray, language: np.ndarray) -> np.ndarray:
        mean, between, within = self.distance[language].T
        return (own - mean) / np.sqrt(between + within / np.maximum(n, 1))


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's n-grams of the highest order, sorted, and their counts."""
    languages = sorted(counts)
    vocabulary = np.unique(np.concatenate([tail(counts[x][0], 1) for x in languages]))
    unseen = -np.log(len(vocabulary) + 1.0)
    values: list[list] = [[] for _ in range(ORDER)]
    weights: list[list] = [[] for _ in range(ORDER)]
    for language in languages:
        levels = {ORDER: counts[language]}
        for order in range(ORDER - 1, 0, -1):  # a lower order counts the characters that an n-gram follows
            levels[order] = np.unique(tail(levels[order + 1][0], order), return_counts=True)
        below = None
        for order in range(1, ORDER + 1):
            grams, c = levels[order]
            # the tail of an n-gram is an n-gram of the order below
            lower = np.exp(unseen) if below is None else below[1][np.searchsorted(below[0], tail(grams, order - 1))]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = min(max(n1 / (n1 + 2.0 * n2), 0.1), 0.95) if n1 else 0.5
            contexts, row = np.unique(grams >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(row, c, len(contexts)), np.bincount(row, minlength=len(contexts))
            back = discount * kinds / total
            p = (c - discount) / total[row] + back[row] * lower
            below = grams, p
            values[order - 1].append((grams, np.log(p)))
            weights[order - 1].append((contexts, np.log(back)))
    return Model(languages, [Table(v) for v in values], [Table(w) for w in weights], unseen)


def train(documents: DataFrame, max_chars: int = MAX_CHARS) -> Model:
    docs = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))
    part = hash_unit(F.concat(F.lit("part:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.count_if(part >= 0.2).alias("others")).collect()
    if not sizes:
        return Model([], [], [], 0.0)
    rates = {r["lang"]: min(1.0, max_chars / max(r["n"], 1)) if r["others"] >= LEAST_COUNTED else 0.0 for r in sizes}
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(x)) for k, x in sorted(rates.items())])
    drawn = hash_unit(F.concat(F.lit("lm:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) < rate
    docs = docs.withColumn("calibrate", drawn & (part < 0.2)).drop("doc_id")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in sorted(held.items()):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n, pa.int64())})
            held.clear()

        for batch in batches:
            for run in chunks(batch, size=RUN_BYTES):
                langs = np.array(run.column(1).to_pylist(), object)
                texts = run.column(0).to_pylist()
                for lang in sorted(set(langs)):
                    grams, n = np.unique(np.concatenate([Chars(p.to_pylist()).grams() for p in pieces(pa.array([texts[i] for i in np.flatnonzero(langs == lang)], pa.string()), RUN_BYTES)]), return_counts=True)
                    if lang in held:
                        merged, at = np.unique(np.concatenate([held[lang][0], grams]), return_inverse=True)
                        grams, n = merged, np.bincount(at, np.concatenate([held[lang][1], n]), len(merged)).astype(np.int64)
                    held[lang] = grams, n
                if sum(len(grams) for grams, _ in held.values()) > HELD_GRAMS:
                    yield from out()
        yield from out()

    counted = docs.where("not calibrate").select("text", "lang").mapInArrow(tidy(count), "lang string, gram bigint, n bigint")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    if not rows.num_rows:
        return Model([], [], [], 0.0)
    langs, grams, n = np.array(rows.column("lang").to_pylist(), object), rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    model = kneser_ney({x: (grams[langs == x], n[langs == x]) for x in sorted(set(langs))})
    return calibrate(model, docs.where("calibrate").select("text", "lang"))


def calibrate(model: Model, sample: DataFrame) -> Model:
    """Sets the rejection's means, variances and limit and the scale of scores from a bounded labelled sample."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in chunks(batch, size=RUN_BYTES):
                h, n, _ = shared.value.entropies(run.column(0))
                yield pa.RecordBatch.from_pydict({"lang": run.column(1), "h": pa.array(list(h), pa.list_(pa.float64())), "n": pa.array(n, pa.int64())})

    rows = sample.mapInArrow(tidy(measure), "lang string, h array<double>, n bigint").where(F.col("n") > 0).toPandas()
    rows = rows[rows["lang"].isin(model.languages)].sort_values(["lang", "n", "h"], key=lambda s: s if s.name != "h" else s.map(tuple))
    if len(rows) < 20:
        return model
    language = rows["lang"].map({x: i for i, x in enumerate(model.languages)}).to_numpy()
    h, n = np.stack(rows["h"].to_numpy()), rows["n"].to_numpy().astype(float)
    own = h[np.arange(len(h)), language]
    model.distance = np.empty((len(model.languages), 3))
    for k in range(len(model.languages)):
        mine = language == k
        mine = mine if mine.sum() >= 20 else np.ones(len(own), bool)
        mean = np.average(own[mine], weights=n[mine])
        square = (own[mine] - mean) ** 2
        design = np.stack([np.ones(mine.sum()), 1 / n[mine]], axis=1) * np.sqrt(n[mine])[:, None]
        fit = np.linalg.lstsq(design, square * np.sqrt(n[mine]), rcond=None)[0]
        model.distance[k] = mean, max(fit[0], 1e-4), max(fit[1], 0.5)
    model.limit = max(LEAST_DISTANCE, MARGIN * float(np.quantile(model._distance(own, n, language), QUANTILE)))
    gap = (h - own[:, None]) * np.sqrt(n)[:, None]
    scales = 2.0 ** np.arange(-6, 7)
    model.scale = float(scales[np.argmin([np.log(np.exp(-np.clip(gap * s, -60, 60)).sum(axis=1)).sum() for s in scales])])
    return model


def identify(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with lang_pred, score, cross_entropy and rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lang, score, own, rejected = shared.value.judge(batch.column(batch.schema.get_field_index(text_col)))
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "cross_entropy": pa.array(own, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}

    return mapped(documents, "lang_pred string, score double, cross_entropy double, rejected boolean", run, text_col, RUN_BYTES)


def report(documents: DataFrame) -> DataFrame:
    found = identify(documents.select("doc_id", "text"), train(documents))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
