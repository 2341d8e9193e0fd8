"""Submissions and streams on hand-made tables."""

from __future__ import annotations

import datetime
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import sentiment
from tidemark.plans import records
from tidemark.streaming import streams

SF = "/root/testdata/sf0.001"


def test_submissions_of_all_companies(spark, tmp_path):
    spark.createDataFrame([(i, "100" if i == 100 else f"Company {i}") for i in range(120)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    # mentions: 20 companies 20 and 1, 100 companies 100 and 6, 119 companies 119 and 7; 1319 is a copy of 119 that mentions 119 and 87
    docs = [(20, "b" * 90, 90), (100, "c", 1), (119, "d", 2), (1319, "d", 2)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in records.submissions_dedup(spark, str(tmp_path)).select("symbol", "keyword", "subreddit", "title", "created_utc", "date").collect()]
    assert found == [
        (1, "Company 1", "dividendinvesting", "b" * 80, 1_700_000_090, "2023-11-14 22:14:50"),
        (7, "Company 7", "ValueInvesting", "d", 1_700_000_002, "2023-11-14 22:13:22"),
        (6, "Company 6", "TechnicalAnalysis", "c", 1_700_000_001, "2023-11-14 22:13:21"),
    ]
    assert len(set(records.SUBREDDITS)) == 15


@pytest.mark.parametrize("one_file", [True, False])
def test_stream_has_all_windows(spark, tmp_path, one_file):
    """Of one file; and of files out of order, more than a trigger takes: the newest days first."""
    day = lambda i: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(days=i)
    events = [(u, day(i), float(10 * i + u)) for i in range(20) for u in (1, 2)]
    for i in [None] if one_file else range(20):
        rows = [e for e in events if i is None or e[1] == day(19 - i)]
        path = tmp_path / ("events.parquet" if one_file else f"events.parquet/part-{i}.parquet")
        path.parent.mkdir(exist_ok=True)
        pd.DataFrame(rows, columns=["user_id", "ts", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(path)
        os.utime(path, (1_700_000_000 + (i or 0),) * 2)
    stream, batch = (sorted(map(tuple, f(spark, str(tmp_path)).collect())) for f in (records.stream_windows, records.batch_windows))
    assert len(stream) == 2 * 34 and stream == batch


def test_stream_is_batch_on_the_table(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    stream, batch = ({(r.user_id, r.day): (r.total, r.n) for r in f(spark, SF).collect()} for f in (records.stream_windows, records.batch_windows))
    assert len(stream) == 659 and stream.keys() == batch.keys() and all(batch[k] == pytest.approx(v) for k, v in stream.items())


def test_streams_resume(spark, tmp_path):
    """A second run takes only the files that came since: first rows, states of tries, scores."""
    at = lambda day: datetime.datetime(2024, 1, day, 12)
    days = [[(1, at(1), 1, False, "odd"), (1, at(2), 2, False, "HTTP 429"), (2, at(1), 3, False, "404")], [(1, at(3), 4, False, "x" * 600), (2, at(3), 5, True, None), (2, at(4), 6, False, "too many requests"), (1, at(3), 4, False, "again")]]
    (tmp_path / "tries.parquet").mkdir()
    states, firsts = [], []
    for i, rows in enumerate(days):
        pd.DataFrame(rows, columns=["id", "at", "nth", "ok", "message"]).astype({"at": "datetime64[us]"}).to_parquet(tmp_path / "tries.parquet" / f"part-{i}.parquet")
        stream = streams.source(spark, f"{tmp_path}/tries.parquet", spark.read.parquet(f"{tmp_path}/tries.parquet").schema)
        found = streams.retries_of_stream(stream.withColumn("at", stream["at"].cast("timestamp")), f"{tmp_path}/out", f"{tmp_path}/state")
        states.append({r.id: (r.retry, r.error, r.scraped, r.last_at.day) for r in found.collect()})
        first = streams.first_rows_of_stream(stream.select("nth", "message"), "nth", "message", f"{tmp_path}/first", f"{tmp_path}/first-state")
        firsts.append(sorted(map(tuple, first.collect())))
    assert states[0] == {1: (1, "odd", False, 1), 2: (1, "404", False, 1)}
    assert states[1] == {1: (3, "x" * 500, False, 3), 2: (0, None, True, 3)} or states[1] == {1: (3, "again", False, 3), 2: (0, None, True, 3)}
    assert firsts[0] == [(1, "odd"), (2, "HTTP 429"), (3, "404")] and firsts[1][:3] == firsts[0] and [x[0] for x in firsts[1]] == [1, 2, 3, 4, 5, 6] and firsts[1][3] == (4, "again")


def test_any_scorer(spark):
    """It is loaded once for a task and gets at most so many texts at once; null texts are empty."""
    seen = spark.sparkContext.accumulator(0)

    def load():
        seen.add(1)
        return lambda texts: [(float(len(t)), float(len(texts))) for t in texts]

    articles = spark.createDataFrame([(i, "t", "c" * i if i else None) for i in range(5)], "id long, title string, content string").coalesce(1)
    found = sentiment.scored(articles, load, batch=2)
    assert sorted(map(tuple, found.collect())) == [(0, 1.0, 2.0), (1, 3.0, 2.0), (2, 4.0, 2.0), (3, 5.0, 2.0), (4, 6.0, 1.0)] and seen.value == 1


def test_epochs_after_year_9999(spark):
    """As DuckDB writes them: no sign before five digits; times before 1970 and parts of seconds go down."""
    seconds = {0: "1970-01-01 00:00:00", 518_394_000_000: "18397-04-02 13:20:00", -1: "1969-12-31 23:59:59", 253_402_300_799: "9999-12-31 23:59:59", 253_402_300_800: "10000-01-01 00:00:00"}
    rows = spark.createDataFrame([(s,) for s in seconds], "s long")
    assert {r.s: r.t for r in rows.select("s", text.epoch_text(rows.s).alias("t")).collect()} == seconds
    assert spark.range(1).select(text.epoch_text(F.lit(-0.5)), text.epoch_text(F.lit(1.5))).first()[:] == ("1969-12-31 23:59:59", "1970-01-01 00:00:01")
