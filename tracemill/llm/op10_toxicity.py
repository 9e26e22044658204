"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text, whatever its label
says, is unlabelled. A linear classifier over the presence of words is fitted
with the non-negative risk estimator
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
where a negative second term makes the step go the other way. Fitting runs on
a bounded sample with numpy; scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import BoundedCache, batches, durable, forgetting, shingle_sequences

#: Bounds of the sample that the classifier is fitted on.
MOST_POSITIVE, MOST_UNLABELLED = 6_000, 12_000
#: A word is a feature if at least so many positives have it, if it is so many standard errors commoner there,
#: and if so large a share of the texts that have it would be positive by the class prior.
LEAST_POSITIVES, LEAST_ERRORS, LEAST_PRECISION = 5, 5.0, 0.7
FOLDS = 5

#: Beginnings of so many letters are features beside whole words, as insults are inflected.
PREFIXES = (4, 5, 6, 7, 8)

_WORDS = re.compile(r"[^\W\d_]+").findall


def toxicity_words(text: str | None) -> set[str]:
    return set(_WORDS(text.lower())) if text else set()


def word_features(word: str) -> list[str]:
    """The word between bounds, and its beginnings with an open end."""
    return [f"^{word}$", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


class Model:
    """Weights of features whose presence counts once per text."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = BoundedCache(self._known)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def _known(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in word_features(word) if f in self.weights)

    def score(self, text: str | None) -> float:
        found = set()
        for features in map(self.known.__getitem__, toxicity_words(text)):
            if features:
                found.update(features)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit_pu(
    rows: np.ndarray,
    columns: np.ndarray,
    positive: np.ndarray,
    size: int,
    prior: float,
    steps: int = 200,
    rate: float = 0.1,
    ridge: float = 2e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias from incidences (rows, columns); positive marks documents. Full-batch Adam."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    share = np.where(positive, 1 / max(n_p, 1), 1 / max(n_u, 1))
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(rows, theta[columns], len(positive))
        p = 1 / (1 + np.exp(-z))
        # losses log(1 + exp(-z)) for label 1 and log(1 + exp(z)) for label 0
        negative_risk = (_softplus(z) * share)[~positive].sum() - prior * (_softplus(z) * share)[positive].sum()
        as_one, as_zero = (p - 1) * share, p * share
        if negative_risk >= 0:
            g = np.where(positive, prior * (as_one - as_zero), as_zero)
        else:  # the negative part has become too good to be true: walk it back
            g = np.where(positive, prior * as_zero, -as_zero)
        grad = np.append(np.bincount(columns, g[rows], size), g.sum())
        grad[:-1] += ridge * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def held_out():
    """Rows that never teach: crc32 of the id as text, modulo FOLDS, is 0."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0


@forgetting
def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames, "text"):
        marks = shingle_sequences(frame["text"])
        yield pd.DataFrame(
            {
                "positive": frame["positive"],
                "mark": [int(m.min() >> np.uint64(1)) if len(m) else -1 for m in marks],
                "features": [sorted({f for w in toxicity_words(t) for f in word_features(w)}) for t in frame["text"]],
            }
        )


def _vocabulary(features: DataFrame, n_p: int, n_u: int, prior: float) -> list[str]:
    """Features that are clearly commoner among the positives, clearest first; as many as the bounded sample has."""
    counts = features.select("positive", F.explode("features").alias("feature")).groupBy("feature")
    counts = counts.agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    pooled = (F.col("a") + F.col("b") + 1) / (n_p + n_u + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / max(n_u, 1)))
    z = (F.col("a") / n_p - F.col("b") / max(n_u, 1)) / error
    precision = prior * F.col("a") / n_p / (F.greatest("b", F.lit(1)) / max(n_u, 1))
    common = counts.filter((F.col("a") >= LEAST_POSITIVES) & (precision >= LEAST_PRECISION))
    clear = common.withColumn("z", z).filter(F.col("z") >= LEAST_ERRORS)
    return [r.feature for r in clear.orderBy(F.desc("z"), "feature").collect()]


def _indices(vocabulary: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {f: k for k, f in enumerate(vocabulary)}
        for frame in frames:
            found = [[index[f] for f in features if f in index] for features in frame["features"]]
            yield pd.DataFrame({"positive": frame["positive"], "mark": frame["mark"], "found": found})

    return run


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit on rows outside the held-out fold.

    The sample is every row whose id's hash falls under a share that makes about `most_positive` and
    `most_unlabelled` rows. Without a positive there is nothing to learn: every score is then 0.
    """
    taught = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    taught = taught.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") == 1).alias("toxic"))
    n_taught, n_toxic = taught.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    if not n_toxic:
        return Model({}, -50.0)
    prior = (n_toxic + 1) / (n_taught + 2)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), F.lit(1_000_000)) / 1_000_000
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~held_out())
    n_docs = slim.count()
    chosen = taught.filter(F.col("toxic") & (place < most_positive / n_toxic)).select("doc_id", F.lit(True).alias("positive"))
    positives = slim.join(F.broadcast(chosen), "doc_id").select("text", "positive")  # about most_positive ids
    others = slim.filter(place < most_unlabelled / max(n_docs, 1))  # all texts, toxic ones in their true share
    sample = positives.unionByName(others.select("text", F.lit(False).alias("positive")))
    # near copies share their least shingle; one of each stays, so that a copied text doesn't teach its own words
    features = sample.mapInPandas(_features, "positive boolean, mark long, features array<string>")
    features = durable(features.groupBy("positive", "mark").agg(F.min("features").alias("features")))
    n_p, n_u = features.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_p:
        return Model({}, -50.0)
    kept = _vocabulary(features, n_p, n_u, prior)
    found = features.mapInPandas(_indices(kept), "positive boolean, mark long, found array<int>").toPandas()
    found = found.sort_values(["positive", "mark"], ignore_index=True)  # sums in one order, so that every run fits the same weights
    rows = np.repeat(np.arange(len(found)), found["found"].str.len().to_numpy(np.int64))
    columns = np.concatenate([np.asarray(x, np.int64) for x in found["found"]])
    theta, bias = fit_pu(rows, columns, found["positive"].to_numpy(bool), len(kept), prior)
    return Model(dict(zip(kept, map(float, theta), strict=True)), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts get the bias alone.

    Repeated rows are scored each; a null doc_id counts as not held out; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for frame in batches(frames, "text"):
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": [known.score(t) for t in frame["text"]]})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores under 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @forgetting
    def of(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series([sent.value.score(t) for t in texts], dtype=float)

    return docs.filter(of(F.col("text")) < 0.5)
