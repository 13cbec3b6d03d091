"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones train a linear classifier in numpy. The risk of the
negative class is estimated from unlabelled text minus the share that the class prior gives to
positives, and is kept from turning negative, which would be overfitting.

The fit uses bounded samples (``POSITIVES``, ``UNLABELLED`` documents in order of a hash of the id);
every document is scored, over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import id_and_text, sampled

POSITIVES, UNLABELLED = 3000, 9000
#: Words of the model: in at least so many sampled documents, the most frequent first.
MIN_DOCUMENTS, VOCABULARY = 5, 60_000
STEPS, CHANCE, RELAXED = 200, 2.5, 0.02
PRIOR_RANGE = (0.01, 0.5)
FOLDS = 5
PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Hashes of the different words of a text, in lower case without punctuation."""
    words = set(text.lower().encode().translate(PUNCTUATION).split())
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


@dataclass
class Rows:
    """Sparse rows of ones: columns, and where each row begins."""

    columns: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, lists, vocabulary: np.ndarray) -> Rows:
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate([*lists, np.zeros(0, np.uint64)]).astype(np.uint64)
        at = np.searchsorted(vocabulary, flat)
        known = (at < len(vocabulary)) & (np.append(vocabulary, 0)[at] == flat)
        owner = np.repeat(np.arange(len(lists)), sizes)[known]
        return cls(at[known], np.searchsorted(owner, np.arange(len(lists) + 1)))

    def times(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(weights[self.columns], dtype=np.float64)))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(values, np.diff(self.starts)), width)


def sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


def fit(positive: Rows, unlabelled: Rows, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient on the non-negative risk with the logistic loss.

    A word's penalty is ``CHANCE`` standard errors of its gradient, so that words which differ between
    the samples by chance keep weight zero however many words there are. The words that are left are
    fitted once more under ``RELAXED`` of the penalty, which else would shrink their weights.
    """
    n_p, n_u = len(positive.starts) - 1, len(unlabelled.starts) - 1
    share = unlabelled.back(np.ones(n_u), width) / n_u
    mean_p = positive.back(np.ones(n_p), width) / n_p
    pooled = (share * n_u + mean_p * n_p) / (n_u + n_p)
    penalty = CHANCE * prior * np.sqrt((pooled + 1 / n_p) / n_p)
    x = np.ones(width)
    for _ in range(12):
        x = unlabelled.back(unlabelled.times(x), width) / n_u
        top = np.linalg.norm(x)
        x /= top + 1e-12
    rate = 1 / (0.25 * (1.5 * top + 1))
    start = (np.zeros(width), float(np.log(prior / (1 - prior))))
    w, b = descent(positive, unlabelled, prior, rate, penalty, *start)
    return descent(positive, unlabelled, prior, rate, np.where(w == 0, np.inf, RELAXED * penalty), w, b)


def descent(positive: Rows, unlabelled: Rows, prior: float, rate: float, penalty: np.ndarray, w: np.ndarray, b: float):
    n_p, n_u, width = len(positive.starts) - 1, len(unlabelled.starts) - 1, len(w)
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(STEPS):
        z_p, z_u = positive.times(ahead) + ahead_b, unlabelled.times(ahead) + ahead_b
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        # d loss(z)/dz = s - 1 for the positive, s for the negative class; a negative risk steps back.
        g_p, g_u = (np.full(n_p, -prior / n_p), s_u / n_u) if negative >= 0 else (prior * s_p / n_p, -s_u / n_u)
        moved = ahead - rate * (positive.back(g_p, width) + unlabelled.back(g_u, width))
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new_b = ahead_b - rate * float(g_p.sum() + g_u.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(Rows.of([features(x) for x in texts], self.vocabulary).times(self.weights) + self.bias)


def features_of(docs: DataFrame) -> list[np.ndarray]:
    """Features of a bounded sample of documents."""

    def run(batches):
        for batch in batches:
            found = [features(x).view(np.int64).tolist() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["f"])

    found = docs.select("text").mapInArrow(run, "f array<long>").toArrow().column(0)
    return [np.asarray(x.values).view(np.uint64) for x in found]


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows outside the held-out fold. Without a positive row, scores are the least prior."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    seen = known.agg(F.avg(F.col("toxic").cast("double")), F.sum(F.col("toxic").cast("long"))).first()
    if not seen[1]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(PRIOR_RANGE[0] / (1 - PRIOR_RANGE[0]))))
    prior = float(np.clip(seen[0], *PRIOR_RANGE))
    own = docs.where(~held_out() & (F.col("text") != ""))
    toxic = known.where("toxic = 1").select("doc_id").distinct()
    # Ids are joined first: the texts of the sample alone are read, and none is shuffled for it.
    ids = sampled(own.select("doc_id").join(toxic, "doc_id"), F.col("doc_id"), POSITIVES)
    positive = features_of(sampled(own.join(F.broadcast(ids), "doc_id"), F.col("doc_id"), POSITIVES))
    unlabelled = features_of(sampled(own, F.col("doc_id"), UNLABELLED))
    words, counts = np.unique(np.concatenate([*positive, *unlabelled, np.zeros(0, np.uint64)]), return_counts=True)
    kept = np.argsort(-counts, kind="stable")[:VOCABULARY]
    vocabulary = np.sort(words[kept][counts[kept] >= MIN_DOCUMENTS])
    if not positive or not len(vocabulary):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    w, b = fit(Rows.of(positive, vocabulary), Rows.of(unlabelled, vocabulary), len(vocabulary), prior)
    return Model(vocabulary, w, b)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null or empty text gets the score of the bias alone. A null doc_id is scored and counts as not
    held out; it matches no label. Repeated rows are scored each. Repeated labels of a document count
    each for the prior and once as a positive. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = id_and_text(docs)
    model = trained(docs, labels)

    def run(batches):
        for batch in batches:
            scores = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
