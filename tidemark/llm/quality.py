"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are training rows of label 1; no other label is looked at. With the class prior pi, a score g is fitted
that minimises pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]): the second term is the risk on negatives, which
can't be below zero. l is the logistic loss, so that the sigmoid of g estimates the probability of label 1. g is a small
network over dense features of the whole text.

The prior is estimated from positives and unlabelled texts alone. A network that tells positives from unlabelled texts
scores all rows; at the top of its scores nearly all unlabelled texts are positive, so the share of unlabelled rows that
reach a score, over the share of positives that do, comes down to the prior there. The score is taken at which this
ratio with its margin of error is least.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop, held_out, per_row, read, row_key, sampled, small_batches, written

#: At most so many labelled rows are fitted on as positives, and as many as unlabelled, the first by a hash of doc_id and text.
SAMPLE_ROWS = 20_000
#: Scores are counted in so many bins; a ratio of shares is surer than 1 - DELTA.
BINS, DELTA = 1000, 0.1
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 600, 4096, 0.01, 11
THRESHOLD = 0.7
SYMBOLS = "!#$%&*|.,;:?@_=~^<>/\\"


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    pairs = max(1, len(words) - 1)
    distinct = len(set(words))
    return [
        np.log1p(len(words)),
        distinct / n,
        np.log1p(distinct) / np.log1p(n),
        sum(map(eq, words, words[1:])) / pairs,
        len(set(zip(words, words[1:]))) / pairs,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        chars / n,
        text.count("\n") / n,
        len(text.encode("utf-8", "replace")) / chars,
        sum(map(text.count, "0123456789")) / chars,
        *(text.count(c) / n for c in SYMBOLS),
    ]


N_FEATURES = len(features(""))


def featured(batch: pd.DataFrame) -> pd.DataFrame:
    return batch[["doc_id", "held_out", "row_key"]].assign(x=[features(t) for t in batch["text"]])


def scale(x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / dev, -6, 6)


def network(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def risks(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """Of outputs on positives and on unlabelled rows: the risk on positives, and the unbiased one on negatives."""
    soft = lambda g: np.logaddexp(0, g)
    return prior * soft(-gp).mean(), soft(gu).mean() - prior * soft(gp).mean()


def slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> np.ndarray:
    """How the sum of both risks changes with each output; where that on negatives is below zero it is overfitted, and the step goes back on it alone."""
    of_negatives = np.concatenate([-prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)])
    if risks(gp, gu, prior)[1] < 0:
        return -of_negatives
    return of_negatives + np.concatenate([-prior * sigmoid(-gp) / len(gp), np.zeros(len(gu))])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """Weights of the network; Adam over batches of both kinds of rows. Without prior it tells positives from unlabelled rows."""
    rng = np.random.default_rng(SEED)
    w = [rng.standard_normal((positive.shape[1], HIDDEN)) * 0.3, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * 0.3, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, STEPS + 1):
        p, u = (a[rng.integers(0, len(a), BATCH)] for a in (positive, unlabelled))
        x = np.concatenate([p, u])
        h = np.tanh(x @ w[0] + w[1])
        g = h @ w[2] + w[3]
        gp, gu = g[:BATCH], g[BATCH:]
        d = np.concatenate([-sigmoid(-gp), sigmoid(gu)]) / BATCH if prior is None else slopes(gp, gu, prior)
        dh = d[:, None] * w[2] * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
        for i, grad in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad * grad
            w[i] = w[i] - RATE * (1 - step / (STEPS + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def matrix(rows: DataFrame) -> np.ndarray:
    return np.array(rows.select("x").toPandas()["x"].tolist(), np.float64).reshape(-1, N_FEATURES)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, row_key, x of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    return written(docs.mapInPandas(per_row(featured), "doc_id long, held_out boolean, row_key long, x array<double>"), "features")


def scoring(weights: list[np.ndarray], mean: np.ndarray, dev: np.ndarray, keep: list[str]):
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        x = np.array(batch["x"].tolist(), np.float64).reshape(-1, N_FEATURES)
        return batch[keep].assign(score=sigmoid(network(scale(x, mean, dev), weights)))

    return per_row(score)


def prior_of(counts: np.ndarray) -> float:
    """The class prior. counts: positives and unlabelled rows in each bin of scores, the least scores first."""
    n = counts.sum(axis=0)
    reach = counts[::-1].cumsum(axis=0)[::-1] / n
    margin = np.sqrt(np.log(4 / DELTA) / 2 / n).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        upper = np.where(reach[:, 0] > 0, (reach[:, 1] + margin) / reach[:, 0], np.inf)
    at = int(np.argmin(upper))
    return float(np.clip(reach[at, 1] / reach[at, 0], 0.01, 0.99))


def estimated_prior(positives: DataFrame, everything: DataFrame, positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> float:
    """positives, everything: x, of all training rows of label 1 and of all training rows."""
    weights = fit(scale(positive, mean, dev), scale(unlabelled, mean, dev), None)
    rows = positives.select("x", F.lit(1).alias("p")).unionByName(everything.select("x", F.lit(0).alias("p")))
    bin_ = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    found = rows.mapInPandas(scoring(weights, mean, dev, ["p"]), "p int, score double").groupBy(bin_).agg(F.sum("p").alias("p"), F.count_if(F.col("p") == 0).alias("u"))
    counts = np.zeros((BINS, 2))
    for r in found.collect():  # BINS rows at most
        counts[r["bin"]] = r["p"], r["u"]
    return prior_of(counts)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, unlabelled_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score double, predicted int for every row of docs (doc_id, text). labels: doc_id, quality.

    Labels are learned from rows alone whose crc32(doc_id as text) mod 4 is not 2; of several labels of one doc_id the
    least counts, null ones don't. The network is fitted on at most sample_rows of the rows of label 1, and on at most
    unlabelled_rows of all training rows, whose labels aren't looked at; rows that repeat doc_id and text are fitted on
    once. The prior is counted over all training rows. Null and empty texts are scored like any other, very long ones as a whole.
    Without a training row of label 1 nothing can be learned, and all scores are 1. Null and repeated doc_id keep their rows. No rows give no rows.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = prepared(docs)
    own = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("is_positive"))
    training = found.where(~F.col("held_out"))
    labelled = written(training.join(own, "doc_id").select("row_key", "is_positive", "x"), "labelled")
    positive = matrix(sampled(labelled.where("is_positive"), sample_rows))
    if not len(positive):
        return found.select("doc_id", "held_out", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    unlabelled = matrix(sampled(training.select("row_key", "x"), unlabelled_rows))
    mean, dev = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    prior = estimated_prior(labelled.where("is_positive"), training, positive, unlabelled, mean, dev)
    weights = fit(scale(positive, mean, dev), scale(unlabelled, mean, dev), prior)
    drop(labelled)
    out = found.mapInPandas(scoring(weights, mean, dev, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
