"""Queries that go through CSV files and downloaded frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import market as M
from tidemark.plans.flows import folder
from tidemark.sources import files
from tidemark.sources import tables as T


def market_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their index as CSV files of securities, of which every third lacks a column; those that are whole, read again under short names."""
    at = folder(spark, "market-csv")
    rows = M.rounded(M.norm(spark, sf_dir)).select(*files.MARKET_COLUMNS)
    short = F.col("ticker") % 3 == 0
    named = rows.withColumn("key", F.col("ticker"))
    files.export_by_key(named.where(~short), "key", f"{at}/whole")
    files.export_by_key(named.where(short).drop("volume"), "key", f"{at}/short")
    whole = files.complete_keys(spark, at, files.MARKET_COLUMNS, "key")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return files.market_rows(files.scan(spark, at, schema, "key").join(whole, "key", "left_semi"))


def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a download brings them: a column twice, one that doesn't count, times with the dates, rows without date."""
    bars = T.bars(spark, sf_dir)
    date = F.when(F.dayofmonth("date") != 13, F.to_timestamp_ntz(F.concat(F.col("date").cast("string"), F.lit(" 16:30:00"))))
    price = [F.col(c) for c in ("open", "high", "low", "close")]
    brought = bars.select("ticker", date, *price, F.col("close"), F.col("volume"), F.lit(0.0)).toDF("ticker", "Date", "Open", "High", "Low", "Close", "Close", "Volume", "Dividends")
    return files.price_rows(brought, "ticker")


def event_study_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the event study as a CSV file, read again."""
    at, rows = folder(spark, "event-study-csv"), M.event_study(spark, sf_dir)
    files.export(rows, at)
    return spark.read.schema(rows.schema).option("header", True).csv(at)


SQL = {
    "market_files": f"""WITH {M.NORM_SQL} SELECT date, ticker, b.open, b.high, b.low, b.close, b.volume, round(norm_bias_score, 6) + 0e0 AS bias_index FROM norm JOIN bars b USING (ticker, date) WHERE ticker % 3 <> 0""",
    "price_table": f"WITH {T.BARS_SQL} SELECT ticker, date, open, high, low, close, volume FROM bars WHERE day(date) <> 13",
    "event_study_csv": M.SQL["event_study"],
}
QUERIES = {f.__name__: f for f in (market_files, price_table, event_study_csv)}
