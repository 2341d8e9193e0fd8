"""A corpus in five stages: toxic documents go, poor documents go, repeated passages go, near copies go, the rest is packed.

Each stage takes all that its predecessor kept; its result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, near_dedup, packing, quality, toxicity
from tidemark.llm.common import drop, read, written


def without(docs: DataFrame, verdicts: DataFrame, rejected: str) -> DataFrame:
    """docs but for those whose doc_id some verdict rejects. Rows without doc_id stay."""
    gone = verdicts.where(rejected).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the doc_ids of which some text is predicted toxic. Null, empty and repeated texts are judged like others; where no label tells anything, all stay. No rows give no rows."""
    return without(docs, toxicity.scored(docs, read(spark, sf_dir, "labels")), "predicted = 1")


def poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the doc_ids of which some text is predicted poor, as null and empty ones may be; where no label tells anything, all stay. No rows give no rows."""
    return without(docs, quality.scored(docs, read(spark, sf_dir, "labels")), "predicted = 0")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without later copies of repeated passages. Documents of which nothing is left go; null and empty texts stay, and all columns but text and its n_chars. No rows give no rows."""
    removed = "lines_removed"
    while removed in docs.columns:
        removed += "_"
    found = line_dedup.dedup_lines(docs, counted=removed)
    left = (F.col(removed) == 0) | (F.trim("text") != "")
    return found.where(F.coalesce(left, F.lit(True))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, and of rows that repeat doc_id and text one. Rows without doc_id, and without words, stay. No rows give no rows."""
    return without(docs, near_dedup.near_duplicates(docs, shingle_words=5, percent=80), "not kept").dropDuplicates(["doc_id", "text"])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of 4096 tokens at most; a null or empty text is its end token alone. No rows give no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("quality", poor),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("packing", packed),
]

#: The learned stages and the tokenizer can't be told in SQL. Tests hold line dedup, near copies and packing, one after the other, against brute force, the learned stages against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep. Each stage's table is deleted when the next has been written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
