"""Shared parts of the two vector searches: clean vectors, blocks of rows, blocks of queries."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8_192
BLOCK_QUERIES = 2_048


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id long, v array<double>. Vectors that are null or empty or hold a null, NaN or infinite component go, and so do rows without vec_id."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def block_pairs(queries: DataFrame, rows: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """search(rows, queries) over every pair of a block of rows and a block of the stated queries, both of bounded size.

    Each row is sent once for each block of queries, each query once for each block of rows. Vectors meet only those of
    their own width. The hash that deals rows takes the vector in, so that rows that repeat a vec_id spread too.
    """
    n_r, n_q = (max(1, math.ceil(x.count() / most)) for x, most in ((rows, BLOCK_ROWS), (queries, BLOCK_QUERIES)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("v").alias("width")
    rows = rows.select("vec_id", "v", width, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_r)).cast("int").alias("r"), each(n_q).alias("q"))
    queries = queries.select("vec_id", "v", width, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_q)).cast("int").alias("q"), each(n_r).alias("r"))
    by = ["r", "q", "width"]
    queries = queries.select(*[F.col(c).alias(f"query_{c}") for c in queries.columns])  # under names of their own: both sides may come from one table
    pairs = rows.groupBy(*by).cogroup(queries.groupBy(*[f"query_{c}" for c in by]))
    return pairs.applyInPandas(lambda a, b: search(a, b.rename(columns=lambda c: c.removeprefix("query_"))) if len(a) and len(b) else pd.DataFrame(), schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the blocks found for each query; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
