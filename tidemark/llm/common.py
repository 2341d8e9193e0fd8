"""What the operators of this subpackage share: reading tables, cutting lineage, held-out rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import drop, shared_dir, written

__all__ = ["drop", "held_out", "per_row", "read", "sampled", "shared_dir", "small_batches", "written"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 4 << 20) -> None:
    """Texts are long: at most so many, of about so many bytes, go to a Python worker at once, in this session from now on.

    One row that is larger goes alone.
    """
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(records)) <= rows:
        spark.conf.set(records, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a document, which rows that repeat both have in common."""
    return F.xxhash64(doc_id, text)


def sampled(rows: DataFrame, limit: int) -> DataFrame:
    """Of rows (row_key, ...), with those that repeat a row_key counted once, the limit of least row_key.

    row_key is a hash: keys beyond half as many again are left out before the sort, so that what meets in one place
    doesn't grow with the input; should fewer than limit be left, all keys are sorted.
    """
    keys = rows.select("row_key").distinct()
    n = keys.count()
    if n > 2 * limit:
        near = keys.where(F.col("row_key") < F.lit(int(1.5 * limit / n * 2**64) - 2**63))
        keys = near if near.count() >= limit else keys
    keys = F.broadcast(keys.orderBy("row_key").limit(limit))  # limit keys at most
    return rows.join(keys, "row_key").dropDuplicates(["row_key"])


def per_row(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """fn over each Arrow batch, for mapInPandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return run
