"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. A block of rows is kept as bit slices: slice b of attribute j is a bitmap
over the block's rows. A query weighs slice (j, b) by 2**b * |q_j|; all bitmaps of one weight are added by carry-save
adders (three bitmaps in, a sum and a carry out), which leaves the score's own bit slices. The k best rows are chosen
from the most significant slice downward; rows that tie at the boundary are resolved by vec_id. Attributes with a
negative weight use the complement of their slices, which turns the sum into one of non-negative terms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import vectors as V
from tidemark.llm.common import read

SCALE = 256
RESULT = "query_id long, vec_id long, score long"


def bit_slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """values: rows x attributes, non-negative integers. Slices x attributes x words, and the number of slices."""
    depth = max(1, int(values.max(initial=0)).bit_length())
    pad = -len(values) % 64
    values = np.pad(values, ((0, pad), (0, 0)))
    bits = (np.ascontiguousarray(((values >> b) & 1).astype(np.uint8).T) for b in range(depth))
    planes = [np.ascontiguousarray(np.packbits(x, axis=1, bitorder="little")).view(np.uint64) for x in bits]
    return np.stack(planes), depth


def add_weighted(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices, least significant first, of the sum over attributes of |weight| * value (complemented where weight < 0)."""
    size = np.abs(weights)
    used = np.flatnonzero(size)
    signed = slices[:, used] ^ np.where(weights[used] < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[None, :, None]
    by_weight: list[list[np.ndarray]] = []
    top = int(size.max(initial=0)).bit_length()
    for w in range(len(slices) + top - 1):
        by_weight.append([signed[b][(size[used] >> (w - b)) & 1 == 1] for b in range(len(slices)) if 0 <= w - b < top])
    out: list[np.ndarray] = []
    words, w = slices.shape[2], 0
    carried: dict[int, list[np.ndarray]] = {}
    while w < len(by_weight) or w in carried:
        parts = (by_weight[w] if w < len(by_weight) else []) + carried.pop(w, [])
        maps = np.concatenate(parts) if parts else np.zeros((0, words), np.uint64)
        while len(maps) > 1:
            if len(maps) == 2:
                a, b = maps
                carried.setdefault(w + 1, []).append((a & b)[None])
                maps = (a ^ b)[None]
                break
            third = len(maps) // 3
            a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
            ab = a ^ b
            carried.setdefault(w + 1, []).append((a & b) | (ab & c))
            maps = np.concatenate([ab ^ c, maps[3 * third :]])
        out.append(maps[0] if len(maps) else np.zeros(words, np.uint64))
        w += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(score: list[np.ndarray], eligible: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores. Rows stand in order of vec_id, so that of the rows that tie the first ones are taken."""
    sure, open_ = np.zeros_like(eligible), eligible.copy()
    n_sure = 0
    for plane in reversed(score):
        high = open_ & plane
        n = n_sure + count(high)
        if n > k:
            open_ = high
        else:
            sure, n_sure, open_ = sure | high, n, open_ & ~plane
            if n == k:
                return rows_of(sure)
    return np.concatenate([rows_of(sure), rows_of(open_)[: k - n_sure]])


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    ids = rows["vec_id"].to_numpy()
    values = np.floor(SCALE * V.matrix(rows["v"])).astype(np.int64)
    slices, depth = bit_slices(values - values.min(axis=0))
    everyone = np.packbits(np.arange(slices.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
    found = []
    for query_id, v in zip(queries["vec_id"].to_numpy(), queries["v"], strict=True):
        weights = np.floor(SCALE * np.asarray(v, np.float64)).astype(np.int64)
        eligible = everyone.copy()
        for own in range(*np.searchsorted(ids, [query_id, query_id + 1])):
            eligible[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        # a constant per query, left out by the shift to non-negative values, doesn't change the order
        at = best(add_weighted(slices, weights), eligible, k)
        found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at], "score": values[at] @ weights}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """For each query the k rows, other than those of its own vec_id, with the highest inner product of quantised components.

    queries, rows: vec_id, embedding. Result: query_id long, rank int from 1, vec_id long, score long; ties go to the
    smaller vec_id. Vectors that are null or hold a null or non-finite component take no part; a query meets only rows
    of its own width; rows that repeat a vec_id are candidates of their own; a query listed twice is answered once.
    Empty tables give an empty result. Other columns are ignored.
    """
    queries = V.clean(queries).dropDuplicates(["vec_id"])
    return V.ranked(V.block_pairs(queries, V.clean(rows), lambda a, b: search_block(a, b, k), RESULT), k)


def op2_topk_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


OP2_SQL = """
WITH q AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM q JOIN r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
