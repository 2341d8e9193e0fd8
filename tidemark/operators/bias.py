"""The bias index: reach-weighted sentiment of 15 days for each security and day, and its robust normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.sources.shared import placed, stable

#: The reach of the largest outlet, days looked back, floor of the scale.
MOST_FOLLOWERS, DAYS_BACK, LEAST_SCALE = 41_000_000, 14, 1e-6


def sentiment(pos: str, neg: str) -> Column:
    return F.coalesce(F.col(pos), F.lit(0.0)) - F.coalesce(F.col(neg), F.lit(0.0))


def reach(followers: str) -> Column:
    return F.log10(1 + F.greatest(F.coalesce(F.col(followers), F.lit(0.0)), F.lit(0.0))) / F.log10(F.lit(1.0 + MOST_FOLLOWERS))


def raw_index(bars: DataFrame, articles: DataFrame, outlets: DataFrame, short: bool = False) -> DataFrame:
    """bars with bias_score and n_articles of the days [date - 14, date]; a bar without articles has 0.

    Articles of unknown outlets don't count. Days without a bar don't matter. Articles are summed by day before any window, so that a frame holds 30 rows at
    most however many articles a day has; bars stand in the window beside them, as days without sentiment, so that nothing is joined.
    Where bars stand in buckets by ticker, as many tasks get both, and what is summed comes to them; short: before it is summed, which is less
    to shuffle where a day has few articles, but brings all articles of a security to one task.
    """
    own = articles.join(outlets.select(F.col("id").alias("outlet_id"), "avg_followers"), "outlet_id")
    own = own.select("ticker", "date", (sentiment("pos", "neg") * reach("avg_followers")).alias("s"))
    buckets = getattr(bars, "buckets", None)
    if short and buckets:
        own = own.repartition(buckets, "ticker")
    daily = own.groupBy("ticker", "date").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    if buckets and not short:
        daily = daily.repartition(buckets, "ticker")
    kept = F.struct(*[c for c in bars.columns if c not in ("ticker", "date")])
    days = bars.select("ticker", "date", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), kept.alias("bar")).unionByName(daily, allowMissingColumns=True)
    if buckets:
        days = days.repartition(buckets, "ticker")  # a union isn't known to be dealt so
    frame = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-DAYS_BACK, 0)
    scored = days.select("ticker", "date", "bar", F.sum("s").over(frame).alias("bias_score"), F.sum("n").over(frame).alias("n_articles"))
    return placed(scored.where("bar is not null").select("ticker", "date", "bar.*", "bias_score", "n_articles"), buckets)


def scale_of(raw: DataFrame) -> DataFrame:
    """One row: s, the floored median absolute deviation, and p, the 99th percentile of the absolute score (or what stands in for it)."""
    one, size = F.lit(1).alias("one"), F.abs("value")
    rows = stable(raw if hasattr(raw, "written_to") else raw.select("bias_score"), "scores").where("bias_score is not null")
    scores = rows.select(one, F.col("bias_score").alias("value"), F.lit(1).alias("n"))
    median = ranks.percentiles(scores, ["one"], {"median": 0.5}).select("median")
    dev = scores.crossJoin(F.broadcast(median)).select("one", F.abs(F.col("value") - F.col("median")).alias("value"), "n")  # the median is one row
    mad = ranks.percentiles(dev, ["one"], {"mad": 0.5})
    p99 = ranks.percentiles(scores.withColumn("value", size), ["one"], {"p99": 0.99})
    found = scores.agg(one, F.max(size).alias("most")).join(mad, "one", "left").join(p99, "one", "left")  # one row each
    return found.select(F.greatest("mad", F.lit(LEAST_SCALE)).alias("s"), F.when(F.col("p99") > 0, F.col("p99")).otherwise(F.col("most") + LEAST_SCALE).alias("p"))


def normalised(raw: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """raw with norm_bias_score in [-1, 1]. scale: what scale_of gives for raw, where it is there."""
    score = F.asinh(F.col("bias_score") / F.col("s")) / F.asinh(F.col("p") / F.col("s"))
    return raw.crossJoin(F.broadcast(scale_of(raw) if scale is None else scale)).withColumn("norm_bias_score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))).drop("s", "p")
