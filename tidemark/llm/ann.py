"""Approximate nearest neighbours by cosine: few stable projections, indexed by a kd-tree, and a chi-square stop.

Vectors are scaled to length 1, where the largest cosine is the least distance. M Gaussian (2-stable) projections map
them to M dimensions; for two points at distance d, the squared projected distance over d**2 follows the chi-square
distribution with M degrees of freedom. A kd-tree over the projected points of a block yields them nearest first. Each
is verified on its own vector, until the distance that the next ones have at least in the projection is so large
that a point nearer than the k-th verified one would have come earlier with probability CONFIDENCE. Leaves are opened by
steps, and of their rows those are verified that the test doesn't leave out already.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import vectors as V
from tidemark.llm.common import read

M = 8
LEAF = 32
CONFIDENCE = 0.95
SEED = 20_240_601
STEP = 8  # leaves that are opened at first; then twice as many each time
RESULT = "query_id long, vec_id long, score double"


def chi_square_point(m: int, p: float) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m, by bisection of the closed form."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, M))


class KdTree:
    """Splits at the median of the widest dimension; rows holds the row numbers leaf by leaf."""

    def __init__(self, points: np.ndarray):
        self.points, done, todo = points, [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                done.append(rows)
                continue
            own = points[rows]
            dim, half = int(np.argmax(np.ptp(own, axis=0))), len(rows) // 2
            order = np.argpartition(own[:, dim], half)
            todo += [rows[order[:half]], rows[order[half:]]]
        self.leaves = done
        self.low = np.stack([points[x].min(axis=0) for x in done])
        self.high = np.stack([points[x].max(axis=0) for x in done])

    def nearest_first(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves, and the least squared distance to q that their rows can have, nearest first."""
        bound = (np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2).sum(axis=1)
        order = np.argsort(bound, kind="stable")
        return order, bound[order]


def cosine(a: np.ndarray, a_norm: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    return (a * q).sum(axis=1) / (a_norm * q_norm)


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    ids, v = rows["vec_id"].to_numpy(), V.matrix(rows["v"])
    norm = np.sqrt((v * v).sum(axis=1))
    unit, project = v / norm[:, None], projection(v.shape[1])
    tree, stop = KdTree(unit @ project), chi_square_point(M, CONFIDENCE)
    out: list[pd.DataFrame] = []
    for query_id, q in zip(queries["vec_id"].to_numpy(), queries["v"], strict=True):
        q = np.asarray(q, np.float64)
        q_norm = math.sqrt(float((q * q).sum()))
        q_unit = q / q_norm
        q_low = q_unit @ project
        order, bound = tree.nearest_first(q_low)
        kept, scores, within, i, step = np.zeros(0, np.int64), np.zeros(0), np.inf, 0, STEP
        # a row at exactly the distance of the k-th may still come with a smaller id, so only what is truly farther is left out
        while i < len(order) and bound[i] <= within:
            found = np.concatenate([tree.leaves[j] for j in order[i : i + step]])
            i, step = i + step, 2 * step
            if within < np.inf:
                found = found[((tree.points[found] - q_low) ** 2).sum(axis=1) <= within]
            found = found[ids[found] != query_id]
            kept, scores = np.concatenate([kept, found]), np.concatenate([scores, unit[found] @ q_unit])
            if len(kept) >= k:
                near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-12)
                if len(near) > max(k, 64):  # many equal ones: the smaller ids
                    near = near[np.lexsort((ids[kept[near]], -np.round(scores[near], 12)))[: max(k, 64)]]
                kept, scores = kept[near], scores[near]
                within = stop * max(0.0, 2 - 2 * np.partition(scores, len(scores) - k)[len(scores) - k]) + 1e-9
        scores = cosine(v[kept], norm[kept], q, q_norm)
        best = np.lexsort((ids[kept], -scores))[:k]
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[kept][best], "score": scores[best]}))
    return pd.concat(out)


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """For each query the k rows, other than those of its own vec_id, of the largest cosine that the search finds.

    queries, rows: vec_id, embedding. Result: query_id long, rank int from 1, vec_id long, score double (the cosine of
    the original vectors); ties go to the smaller vec_id. Vectors that are null, zero or hold a null or non-finite
    component take no part; a query meets only rows of its own width; a query listed twice is answered once. Empty
    tables give an empty result. Other columns are ignored. Every row is in a tree; nothing is sampled to fit the index.
    """
    some = F.exists("v", lambda x: x != 0)
    queries = V.clean(queries).where(some).dropDuplicates(["vec_id"])
    return V.ranked(V.block_pairs(queries, V.clean(rows).where(some), lambda a, b: search_block(a, b, k), RESULT), k)


def op3_ann_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows.where(F.col("vec_id") % 50 == 0), rows, 5)
