"""Bars, articles, outlets and companies, derived from the star schema's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import kept, placed


#: Derived tables are bucketed by security, and in order of date in a bucket, so that windows by security read them as they are.
BY_DATE = ("ticker", "date")
#: A series of so many rows is brought to its bucket as it is; should any be longer, all are summed by day before.
SHORT = 100_000
#: Lines that a task is dealt at about, so that it can sort them in memory; there are no fewer tasks than shuffle partitions.
DEALT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, open, high, low, close, volume: a row a day. (ticker, date) is the key. Made once in a session."""
    return kept(spark, sf_dir, "bars", ["lineitem"], lambda: daily_bars(spark, sf_dir), BY_DATE)


def short_series(spark: SparkSession, sf_dir: str) -> bool:
    most = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= SHORT


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars; of short series, lines are dealt by security, which is the only shuffle. A day has hardly more lines than one, so sums by day before it would be larger than the lines."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-line.count() // DEALT)) if short_series(spark, sf_dir) else None
    line = line if n is None else line.repartition(n, "l_suppkey")
    price = F.try_divide("l_extendedprice", "l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    found = line.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").cast("long").alias("volume")
    )
    return placed(found, n)


def articles(spark: SparkSession, sf_dir: str, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
    """ticker, date, outlet_id, pos, neg, of known companies. first, last: bounds of the date, for the scan; without outlet an article doesn't count."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_custkey is not null")
    if first is not None and last is not None:
        at = [datetime.datetime.combine(d, datetime.time()) for d in (first, last + datetime.timedelta(days=1))]
        orders = orders.where((F.col("o_orderdate") >= F.lit(at[0]).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(at[1]).cast("timestamp_ntz")))
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(known, "l_suppkey", "left_semi").select(
        F.col("l_suppkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("outlet_id"), F.col("l_discount").alias("pos"), F.col("l_tax").alias("neg")
    )


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("avg_followers"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name, current_page (number of articles), is_processed, last_updated (null for every fifth)."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").join(n, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.coalesce("n", F.lit(0)).alias("current_page"), (F.col("s_suppkey") % 3 == 0).alias("is_processed"),
        F.when(F.col("s_suppkey") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 28).cast("int"))).alias("last_updated"),
    )


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a title: the beginning of a document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"))


BARS_SQL = """p AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity,
  row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem),
bars AS (SELECT ticker, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM p GROUP BY ticker, date)"""
