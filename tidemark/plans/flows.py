"""Queries on streams with state and on tables that change in place, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import text as X
from tidemark.operators import merge, recurrence, sentiment
from tidemark.plans import records as R
from tidemark.sources import cursor
from tidemark.sources import tables as T
from tidemark.sources.keyed import KeyedTable
from tidemark.sources.shared import shared_dir
from tidemark.streaming import stateful, streams

#: Pages that a search brings at once.
PAGES = 2


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tries_of(events: DataFrame) -> DataFrame:
    """Events as tries of a user's page: purchases succeed, others fail, some at a rate limit."""
    ok, message = F.col("event_type") == "purchase", R.one_of(R.MESSAGES, "event_id")
    limited = ~ok & F.coalesce(X.error_class(message)["code"] == X.RATE_LIMITED, F.lit(False))
    return events.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("nth"), ok.alias("ok"), limited.alias("limited"))


def stream_retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the tries that met a rate limit are due again, and whether they are tried, were settled by a success in the meantime, or still wait."""
    stream, out, state = R._streamed(spark, sf_dir, "events")
    return stateful.retry_queue(tries_of(stream), out, state, stateful.disorder(spark, f"{sf_dir}/events.parquet", "ts"))


def days_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, StructType.fromDDL("user_id long, day date, total double, n long"), ["user_id", "day"], 16)


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding sums by user over the events, from days of event time whose state is forgotten when they are over."""
    stream, out, state = R._streamed(spark, sf_dir, "events")
    table = days_table(spark, out)
    stateful.day_sums(stream.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "value", table, state, stateful.disorder(spark, f"{sf_dir}/events.parquet", "ts"))
    found = streams.sliding(table.read(), "user_id")
    return found.select("user_id", "day", (F.round("total", 4) + F.lit(0.0)).alias("total"), "n")


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and failures of each micro-batch of the events, with whether its time was taken; failures are counted by kind as the rows pass by."""
    stream, out, state = R._streamed(spark, sf_dir, "events")
    observed = {"ok": F.count_if("ok"), "limited": F.count_if("limited"), "failed": F.count_if(~F.col("ok") & ~F.col("limited"))}
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    found = stateful.with_metrics(tries_of(stream), write, observed, folder(spark, "metrics"), state, f"tries-{uuid.uuid4().hex}")
    m = F.from_json("metrics", "ok long, limited long, failed long")
    return found.select("batch", "rows", m["ok"].alias("ok"), m["limited"].alias("limited"), m["failed"].alias("failed"), (F.col("seconds") > 0).alias("timed"))


def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every host, PAGES at a time, by a stream that is stopped after the first round and goes on from its checkpoint."""
    pages = T.table(spark, sf_dir, "pages").select(X.domain(F.col("url")).alias("host"), F.col("page_id").alias("id"))
    rows, counts = cursor.numbered(pages, PAGES)
    out, state = folder(spark, "cursor"), folder(spark, "cursor-state")
    cursor.crawl(spark, rows, counts, PAGES, out, state, rounds=1)
    return cursor.crawl(spark, rows, counts, PAGES, out, state).select("host", F.col("id").alias("page_id"), "nth", "first")


def keyed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of companies that changes in place, four times: companies come, come again with other names, are updated in part, and are marked complete."""
    schema = StructType.fromDDL("symbol long, name string, current_page long, is_processed boolean, last_error string, last_updated timestamp_ntz")
    table = KeyedTable(spark, folder(spark, "companies"), schema, ["symbol"], 16)
    none = {"last_error": F.lit(None).cast("string"), "last_updated": F.lit(None).cast("timestamp_ntz")}
    rows = T.companies(spark, sf_dir).select("symbol", "name", F.lit(0).cast("long").alias("current_page"), "is_processed", *[x.alias(c) for c, x in none.items()])
    table.change(rows.where("symbol % 3 <> 0"), lambda old, new: merge.insert_ignore(old, new, "symbol", "name"))
    table.change(rows.where("symbol % 2 = 0").withColumn("name", F.concat("name", F.lit(" new"))), lambda old, new: merge.upsert(old, new, "symbol", ["name"], "last_updated", R.now()))
    table.change(rows.where("symbol % 5 = 0").select("symbol", F.col("symbol").alias("current_page"), F.lit("HTTP 500").alias("last_error")), lambda old, new: merge.partial_update(old, new, "symbol"))
    table.change(rows.where("symbol % 7 = 0").select("symbol"), lambda old, new: merge.mark_complete(old, new, "symbol", "last_updated", R.now()))
    return table.read()


def keyed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue as a table that changes in place: rows come, come again, and take the outcomes of their tries."""
    rows = R._queue(spark, sf_dir)
    table = KeyedTable(spark, folder(spark, "queue"), rows.schema, ["id"], 16)
    for part in (rows.where("id % 2 = 0"), rows):
        table.change(part, lambda old, new: merge.insert_ignore(old, new, "id", "retry"))
    table.change(R._outcomes(rows), lambda old, new: merge.scrape_update(old, new, R.now()))
    return table.read()


def keyed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of articles as a stream; each micro-batch goes into the table of articles, of which it rewrites the folders that it touches."""
    stream, out, state = R._streamed(spark, sf_dir, "documents")
    articles = R._articles(spark, sf_dir)
    table = KeyedTable(spark, out, articles.schema, ["id"], 16)
    table.change(articles, lambda old, new: merge.insert_ignore(old, new, "id", "pos"))
    titled = stream.select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"))
    scorer = sentiment.lexicon(R.POSITIVE, R.NEGATIVE)

    def merge_scores(batch: DataFrame, number: int) -> None:
        table.change(sentiment.scored(batch, scorer), lambda old, new: merge.partial_update(old, new, "id"))

    titled.writeStream.foreachBatch(merge_scores).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return table.read().select("id", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


def event_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, running sum and means of the events of each kind, in order of time: few series, each of which holds a large share of all rows."""
    rows = T.table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    value = F.col("value")
    rows = recurrence.scan(rows, "event_type", ["ts", "event_id"], {"nth": recurrence.counted(), "total": recurrence.running(value), "mean10": recurrence.ema(value, 10)})
    rows = recurrence.scan(rows, "event_type", ["ts", "event_id"], {"smoothed20": recurrence.smoothed(value, 20, F.col("nth"), F.col("total"))})
    return rows.select("event_id", "event_type", F.col("nth").cast("long").alias("nth"), *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("total", "mean10", "smoothed20")])


_TRIES = f"""e AS (SELECT user_id AS id, event_id AS nth, epoch_us(ts) // 1000 AS at_ms, event_type = 'purchase' AS ok, {R._one_of(R.MESSAGES, "event_id")} AS m FROM events),
  t AS (SELECT id, nth, at_ms, ok, coalesce({R._LIMITED}, false) AS limited FROM e)"""
SQL = {
    "stream_retry_queue": f"""WITH {_TRIES} SELECT id, nth, at_ms, at_ms + {stateful.REST_MS} AS due_ms,
      CASE WHEN at_ms + {stateful.REST_MS} > (SELECT max(at_ms) FROM t) THEN 'waiting'
        WHEN EXISTS (SELECT 1 FROM t s WHERE s.ok AND s.id = t.id AND s.at_ms > t.at_ms AND s.at_ms <= t.at_ms + {stateful.REST_MS}) THEN 'settled' ELSE 'retry' END AS state FROM t WHERE limited""",
    "stream_event_windows": R._WINDOWS,
    "stream_metrics": f"""WITH {_TRIES} SELECT CAST(0 AS BIGINT) AS batch, count(*) AS rows, count_if(ok)::BIGINT AS ok, count_if(limited)::BIGINT AS limited, count_if(NOT ok AND NOT limited)::BIGINT AS failed, true AS timed FROM t""",
    "page_cursor": f"""WITH p AS (SELECT {R._DOMAIN} AS host, page_id, row_number() OVER (PARTITION BY {R._DOMAIN} ORDER BY page_id) - 1 AS nth FROM pages)
      SELECT host, page_id, nth, nth // {PAGES} * {PAGES} AS first FROM p""",
    "keyed_queue": R.SQL["scrape_update"],
    "keyed_scores": R.SQL["stream_scores"],
    # weights of values further back are below the last digit of a double
    "event_trends": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS total FROM events),
      w AS (SELECT a.event_id, sum(CASE WHEN b.t = 0 THEN 1 ELSE 2 / 11e0 END * b.value * pow(9 / 11e0, a.t - b.t)) AS mean10,
        sum(CASE WHEN b.t > 19 THEN b.value / 20e0 WHEN b.t = 19 THEN b.total / 20e0 ELSE 0 END * pow(19 / 20e0, a.t - b.t)) AS smoothed20
        FROM e a JOIN e b ON a.event_type = b.event_type AND b.t BETWEEN a.t - 800 AND a.t GROUP BY a.event_id)
      SELECT event_id, event_type, t AS nth, round(total, 4) + 0e0 AS total, round(mean10, 4) + 0e0 AS mean10, CASE WHEN t >= 19 THEN round(smoothed20, 4) + 0e0 END AS smoothed20 FROM e JOIN w USING (event_id)""",
    "keyed_companies": f"""WITH {R._COMPANIES}, k AS (SELECT * FROM c WHERE symbol % 3 <> 0 OR symbol % 2 = 0)
      SELECT symbol, CASE WHEN symbol % 2 = 0 THEN name || ' new' ELSE name END AS name, CASE WHEN symbol % 5 = 0 THEN symbol ELSE 0 END AS current_page, is_processed OR symbol % 7 = 0 AS is_processed,
      CASE WHEN symbol % 5 = 0 THEN 'HTTP 500' END AS last_error, CASE WHEN symbol % 7 = 0 OR (symbol % 2 = 0 AND symbol % 3 <> 0) THEN TIMESTAMP '{R.NOW}' END AS last_updated FROM k""",
}
QUERIES = {f.__name__: f for f in (stream_retry_queue, stream_event_windows, stream_metrics, page_cursor, keyed_companies, keyed_queue, keyed_scores, event_trends)}
