"""Quality classifier by positive-unlabelled learning.

The model is linear over hashed features and minimises the non-negative unbiased risk
    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l the sigmoid loss,
with trusted positives P (label 1) and unlabelled web text U. Whenever the second term falls below zero, its
gradient is followed upwards, as in the published algorithm.

The class prior comes from positives and unlabelled rows alone: a logistic regression of P against U orders the rows
that it was not fitted to, and the prior is the least ratio, over score thresholds, of the share of U above to the
share of P above (the best-bin estimate): where only positives lie, that ratio is the share of positives in U. Its
assumption is that such thresholds exist and that trusted positives are like all positives.

Scores are calibrated by Platt's method on a fifth of the labelled rows, chosen by a hash of doc_id, that neither fit sees.
Training reads at most max_positive positives, max_unlabelled unlabelled rows and max_calibration labelled rows,
drawn by a hash of doc_id; scoring reads every whole text. Only text is a feature.

Defined results: null and empty texts are scored by the model's offset; documents with a null id are never trained
on; labels that are null are ignored and repeated labels of a document agree or the highest counts; of several texts of
one id the first in order is trained on; without any positive or any unlabelled row every score is 0.5; without
calibration rows of both classes the score is the model's own; a very long text is scored in pieces; clashing columns
(score, predicted) are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import features
from millrace.llm.common import Words, bounded_sample, fold, hash_unit, mapped
from millrace.llm.features import DIM, N_DENSE, Sample, adam, collect, platt, sigmoid

MAX_POSITIVE = 2500
MAX_UNLABELLED = 2500
MAX_CALIBRATION = 2500
FOLDS, HELD = 5, 0
THRESHOLD = 0.3


class Model:
    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def score(self, column: pa.Array, words: Words | None = None) -> np.ndarray:
        return sigmoid(self.slope * features.score(column, self.weights, words) + self.offset)


def nnpu(positive: Sample, unlabelled: Sample, prior: float, steps: int = 400, ridge: float = 1e-4, beta: float = 0.0) -> np.ndarray:
    """Weights that minimise the non-negative risk with the sigmoid loss l(z) = 1 / (1 + exp(z))."""

    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = sigmoid(positive.dot(w)), sigmoid(unlabelled.dot(w))
        dp, du = p * (1 - p) / positive.n, u * (1 - u) / unlabelled.n
        negative = u.mean() - prior * p.mean()  # E_U[l(-g)] - prior E_P[l(-g)]
        down = unlabelled.back(du) - prior * positive.back(dp)
        g = -prior * positive.back(dp) + down if negative >= -beta else -down
        g[: -N_DENSE - 1] += ridge * w[: -N_DENSE - 1]
        return g

    return adam(gradient, DIM, steps)


def against_unlabelled(positive: Sample, unlabelled: Sample, ridge: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights of a logistic regression of positives against unlabelled rows, both classes weighing the same."""

    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = sigmoid(positive.dot(w)), sigmoid(unlabelled.dot(w))
        g = unlabelled.back(u / (2 * unlabelled.n)) - positive.back((1 - p) / (2 * positive.n))
        g[: -N_DENSE - 1] += ridge * w[: -N_DENSE - 1]
        return g

    return adam(gradient, DIM, steps)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the scores of rows of both that the scorer did not see.

    The threshold is the one of the least upper confidence bound of the ratio of both tails.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    p, u = p[p > 0], u[p > 0]
    slack = np.sqrt(np.log(4 / confidence) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / confidence) / (2 * len(positive)))
    best = int(np.argmin((u + slack) / p))
    return float(min(max(u[best] / p[best], 0.01), 0.99))


#: The share of labelled rows that only calibration sees, and of unlabelled rows that only the prior's estimate sees.
ASIDE = 0.2


def train(documents: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_calibration: int = MAX_CALIBRATION) -> Model:
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = marks.where(fold(F.col("doc_id"), FOLDS) != HELD).withColumn("aside", hash_unit(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))) < ASIDE)
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))

    def texts(ids: DataFrame) -> DataFrame:
        """The texts of a bounded set of labelled ids; the set is small, so it may be broadcast."""
        return docs.join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text"))

    positive = collect(texts(bounded_sample(known.where("quality = 1 and not aside").select("doc_id"), "doc_id", max_positive)), ["doc_id"])
    part = hash_unit(F.concat(F.lit("u:"), F.col("doc_id").cast("string"))) < ASIDE
    unlabelled = collect(bounded_sample(docs, "doc_id", max_unlabelled).withColumn("aside", part.cast("int")), ["doc_id", "aside"])
    if not positive.n or not unlabelled.n:
        return Model(np.zeros(DIM), 1.0, 0.0)
    check = collect(texts(bounded_sample(known.where("aside").select("doc_id", "quality"), "doc_id", max_calibration)), ["doc_id", "quality"])
    fit = unlabelled.take(unlabelled.extra["aside"] == 0)
    held = check.extra["quality"] > 0
    first = against_unlabelled(positive, fit if fit.n else unlabelled)
    prior = best_bin(check.dot(first)[held], unlabelled.dot(first)[unlabelled.extra["aside"] == 1])
    weights = nnpu(positive, unlabelled, prior)
    return Model(weights, *platt(check.dot(weights), held.astype(float)))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with score (0 to 1) and predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        p = shared.value.score(batch.column(batch.schema.get_field_index(text_col)))
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())}

    return mapped(documents, "score double, predicted int", run, text_col)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(documents, labels)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")
