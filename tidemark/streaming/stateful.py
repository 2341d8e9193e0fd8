"""Streams with state by event time: a queue of retries with timers, windows that close, metrics of each micro-batch.

State is in RocksDB. The watermark lags by the disorder that was measured in the files, so that no row is ever too late.
"""

from __future__ import annotations

import json
import threading
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from tidemark.sources.keyed import KeyedTable
from tidemark.sources.shared import exists

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a limited page rests, and how many rows are pushed at once.
REST_MS, PUSH = 3_600_000, 80


@contextmanager
def in_rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def disorder(spark: SparkSession, path: str, column: str) -> int:
    """How many seconds the table's rows lag at most behind rows of files that a stream takes before theirs (by time of change; files of one time in any order)."""
    at = F.unix_micros(F.col(column).cast("timestamp"))
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("time")).agg(F.min(at).alias("low"), F.max(at).alias("high"))
    lags = []
    for order in (F.asc("path"), F.desc("path")):
        earlier = Window.orderBy("time", order).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        lags.append(files.select((F.max("high").over(earlier) - F.col("low")).alias("lag")))
    lag = lags[0].unionByName(lags[1]).agg(F.max("lag")).first()[0]
    return max(0, -(-(lag or 0) // 1_000_000))


class RetryQueue(StatefulProcessor):
    """Tries of a key (nth, at_ms, ok, limited): what was limited rests, and is due again when a timer fires.

    A due try is settled if the key succeeded in the meantime, else it is to be tried again. At a timer all rows up to the
    watermark have come, so all that is due by then is told at once, and doesn't depend on the order in which rows came. A
    key has one timer, for the first of its tries. Successes are forgotten when no try that may still fire began before them.
    """

    def __init__(self, rest_ms: int):
        self.rest_ms = rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "nth long, at_ms long")
        self.succeeded = handle.getListState("succeeded", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        limited, ok = [], []
        for r in rows:
            (ok if r.ok else limited if r.limited else []).append(r)
        if limited:
            self.waiting.appendList([(r.nth, r.at_ms) for r in limited])
        if ok:
            self.succeeded.appendList([(r.at_ms,) for r in ok])
        if limited or ok:
            first = min(r.at_ms for r in limited + ok) + self.rest_ms
            if all(first < x for x in self.handle.listTimers()):
                self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # what is due at the watermark itself has its turn at its own timer
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        succeeded = sorted(x[0] for x in self.succeeded.get()) if self.succeeded.exists() else []
        fired, rest = [x for x in waiting if x[1] + self.rest_ms <= due], [x for x in waiting if x[1] + self.rest_ms > due]
        kept = [x for x in succeeded if x + self.rest_ms > due]
        for state, left in ((self.waiting, rest), (self.succeeded, [(x,) for x in kept])):
            state.put(left) if left else state.clear()
        if rest or kept:
            self.handle.registerTimer(min([at for _, at in rest] + kept) + self.rest_ms)
        for nth, at in sorted(fired):
            after = bisect_right(succeeded, at)
            yield Row(id=key[0], nth=nth, at_ms=at, settled=after < len(succeeded) and succeeded[after] <= at + self.rest_ms)


class First(StatefulProcessor):
    """Of a key's rows (ranked, rank, row) the one of least rank (null first), of the first micro-batch that has any."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield Row(row=min(rows, key=lambda r: (True, r["rank"]) if r["ranked"] else (False,))["row"])


def retry_queue(tries: DataFrame, path: str, checkpoint: str, delay_s: int, rest_ms: int = REST_MS) -> DataFrame:
    """id, nth, at_ms, due_ms, state of all limited tries that the stream tries (id, at timestamp, nth, ok, limited) has brought so far.

    state: "retry" or "settled" where the rest is over, else "waiting"; what waits is read from the state itself, and goes
    on to wait when the stream does. What is due is pushed to path in files of PUSH rows at most; a micro-batch replaces
    what a broken-off try of it pushed.
    """
    spark = tries.sparkSession
    rows = tries.where("id is not null and at is not null").withWatermark("at", f"{delay_s} seconds").select("id", "at", "nth", F.unix_millis("at").alias("at_ms"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("limited", F.lit(False)).alias("limited"))
    # other rows only move the watermark; a condition that doesn't name its column would be taken before it
    rows = rows.where(F.col("ok") | F.col("limited") | F.col("at").isNull())
    due = rows.groupBy("id").transformWithState(RetryQueue(rest_ms), "id long, nth long, at_ms long, settled boolean", "Append", "EventTime")

    def push(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", PUSH).parquet(f"{path}/batch={number}")

    with in_rocks(spark):
        due.writeStream.foreachBatch(push).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
        pushed = spark.read.schema("id long, nth long, at_ms long, settled boolean").option("recursiveFileLookup", True).parquet(path)
        done = pushed.select("id", "nth", "at_ms", F.when(F.col("settled"), "settled").otherwise("retry").alias("state"))
        waits = state.select(F.col("key.id").alias("id"), F.col("list_element.nth").alias("nth"), F.col("list_element.at_ms").alias("at_ms"), F.lit("waiting").alias("state"))
        return done.unionByName(waits).withColumn("due_ms", F.col("at_ms") + rest_ms)


def day_sums(stream: DataFrame, key: str, value: str, table: KeyedTable, checkpoint: str, delay_s: int) -> list[dict]:
    """Brings table (key, day, total, n) up to what the stream (key, ts timestamp, value) has brought so far, and returns the progress of the micro-batches.

    Days are windows of event time in the state, which forgets those that the watermark has passed. Each micro-batch gives
    the days that it changed, as they are now; they replace the table's rows of the same key and day.
    """
    window = F.window("ts", "1 day")
    sums = stream.withWatermark("ts", f"{delay_s} seconds").groupBy(key, window.alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    days = sums.select(key, F.to_date("w.start").alias("day"), "total", "n")

    def merge(batch: DataFrame, number: int) -> None:
        table.change(batch, lambda old, new: old.join(new.select(*table.keys), table.keys, "left_anti").unionByName(new))

    with in_rocks(stream.sparkSession):
        query = days.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


class Metrics(StreamingQueryListener):
    """Keeps what a stream of one name says of its micro-batches, until it has ended."""

    def __init__(self, name: str):
        self.name, self.rows, self.ended, self.ids = name, [], threading.Event(), set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ids.add(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name and p.numInputRows:
            seen = p.observedMetrics.get(self.name)
            self.rows.append((p.batchId, p.numInputRows, (p.batchDuration or 0) / 1000, json.dumps(seen.asDict()) if seen else None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.ids:
            self.ended.set()


def with_metrics(stream: DataFrame, of_batch: Callable[[DataFrame, int], None], observed: dict[str, Column], path: str, checkpoint: str, name: str) -> DataFrame:
    """Runs the stream, and returns batch, rows, seconds and metrics (JSON, by the names of observed) of all its micro-batches, of this and earlier runs: they stand in a table at path.

    observed: aggregates over a micro-batch's rows, taken as they pass by. The rows of this run are appended when it ends,
    as many as it had micro-batches.
    """
    spark, listener = stream.sparkSession, Metrics(name)
    spark.streams.addListener(listener)
    try:
        passing = stream.observe(name, *[c.alias(k) for k, c in observed.items()])
        query = passing.writeStream.queryName(name).foreachBatch(of_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        listener.ended.wait(30)
    finally:
        spark.streams.removeListener(listener)
    schema = "batch long, rows long, seconds double, metrics string"
    if listener.rows or not exists(spark, path):
        spark.createDataFrame(listener.rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
