"""The same queries over streams: sliding windows, first rows, scores, retries.

A stream takes what is there and stops; with its checkpoint a second run goes on where the first ended, and takes only
what came since. Each micro-batch is written to a folder of its number, which replaces what a broken-off try left there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.functions import text as X
from tidemark.operators import merge, sentiment
from tidemark.streaming import stateful

ATTEMPTS = "id, at timestamp, nth, ok, message"
STATE = "retry int, error string, scraped boolean, last_at timestamp"


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """The table at path, a file or a folder of files, as a stream."""
    # without a pattern Spark takes the path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, of_batch: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that of_batch made of the micro-batches so far, with their numbers as batch."""

    def write(batch: DataFrame, number: int) -> None:
        of_batch(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("basePath", path).parquet(path)


def day_sums(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, day, total, n of events (key, ts, value)."""
    return events.groupBy(key, F.to_date("ts").alias("day")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def sliding(days: DataFrame, key: str, length: int = 15) -> DataFrame:
    """key, day, total, n over the days [day - length + 1, day], of sums (key, day, total, n), of which a key and day may have several."""
    once = days.groupBy(key, "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")
    return once.select(key, "day", "total", "n", ahead).groupBy(key, F.date_add("day", F.col("k")).alias("day")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def sliding_sums(events: DataFrame, key: str, value: str, days: int = 15) -> DataFrame:
    """key, day, total, n over the days [day - days + 1, day] (ts: timestamp). Events are summed by day before a day is copied to its windows."""
    return sliding(day_sums(events.where("ts is not null"), key, value), key, days)


def sliding_sums_of_stream(stream: DataFrame, key: str, value: str, path: str, checkpoint: str, days: int = 15) -> DataFrame:
    """sliding_sums over all that the stream has brought so far, in whatever order.

    Each micro-batch is summed by day by itself. Sums and counts add up over micro-batches, so no window has to be closed,
    and no row is ever too late.
    """
    return sliding(run(stream.where("ts is not null"), lambda batch, _: day_sums(batch, key, value), path, checkpoint), key, days)


def first_rows_of_stream(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> DataFrame:
    """The first row of each key: of a micro-batch the least by order (null first), of several the one of the first. Rows without key go.

    Which keys were seen is in the state store, so a micro-batch reads nothing of what came before it.
    """
    columns = stream.columns
    rows = stream.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).isNotNull().alias("ranked"), F.col(order).alias("rank"), F.struct(*columns).alias("row"))
    fresh = rows.groupBy("key").transformWithState(stateful.First(), StructType([rows.schema["row"]]), "Append", "None")
    with stateful.in_rocks(stream.sparkSession):
        return run(fresh, lambda batch, _: batch.select("row.*"), path, checkpoint).select(*columns)


def scores_of_stream(articles: DataFrame, stream: DataFrame, load: Callable[[], sentiment.Scorer], path: str, checkpoint: str) -> DataFrame:
    """articles (id, pos, neg, ...) after the scores of those that the stream (id, title, content) has brought so far."""
    found = run(stream, lambda batch, _: sentiment.scored(batch, load), path, checkpoint)
    last = found.groupBy("id").agg(F.max_by(F.struct("pos", "neg"), "batch").alias("r")).select("id", "r.*")
    return merge.partial_update(articles, last, "id")


def next_state(state: tuple | None, at, ok: bool, limited: bool, message: str | None) -> tuple:
    """(tries that failed, last error, done, time of the last try) after a try. Success resets; a rate limit changes nothing."""
    state = state or (0, None, False, None)
    if limited:
        return state
    return (0, None, True, at) if ok else (state[0] + 1, (message or "Unknown error")[:500], state[2], at)


def retries_of_stream(attempts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """id, retry, error, scraped, last_at after all tries (id, at, nth, ok, message) that the stream has brought so far.

    The state of a row is kept between micro-batches; tries of one micro-batch are taken in order of at, then nth.
    """
    limited = F.coalesce(~F.col("ok") & (X.error_class(F.col("message"))["code"] == X.RATE_LIMITED), F.lit(False))
    attempts = attempts.select("id", "at", "nth", "ok", "message", limited.alias("limited"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        for row in pd.concat(list(frames)).sort_values(["at", "nth"]).itertuples():
            now = next_state(now, row.at, bool(row.ok), bool(row.limited), row.message)
        state.update(now)
        yield pd.DataFrame([(*key, *now)], columns=["id", "retry", "error", "scraped", "last_at"]).astype({"last_at": "datetime64[us]"})

    states = attempts.groupBy("id").applyInPandasWithState(step, f"id long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
    found = run(states, lambda batch, _: batch, path, checkpoint, "update")
    return found.groupBy("id").agg(F.max_by(F.struct("retry", "error", "scraped", "last_at"), "batch").alias("r")).select("id", "r.*")


def eligible(queue: DataFrame, most: int, now: Column) -> DataFrame:
    """queue with whether a row may be tried now: not done, under most tries, the last an hour ago or never."""
    due = F.col("last_at").isNull() | (F.col("last_at") < now - F.expr("interval 1 hour"))
    return queue.withColumn("eligible", F.col("content").isNull() & ~F.col("scraped") & (F.col("retry") < most) & due)
