"""Streams with state, the page cursor and tables that change in place, on hand-made tables."""

from __future__ import annotations

import datetime
import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import merge
from tidemark.plans import flows, market, records
from tidemark.sources import cursor, shared
from tidemark.sources.keyed import BUCKET, KeyedTable
from tidemark.streaming import stateful, streams

START, SF = datetime.datetime(2024, 1, 1), "/root/testdata/sf0.001"


def write_events(folder, events, files):
    """events in order as one file, or as many, of which each second one is taken before the one with older rows."""
    path = folder / "events.parquet"
    folder.mkdir()
    frame = pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"})
    if files == 1:
        frame.to_parquet(path)
        return
    path.mkdir()
    for i in range(files):
        part = path / f"part-{i:02}.parquet"
        frame.iloc[len(frame) * i // files : len(frame) * (i + 1) // files].to_parquet(part)
        os.utime(part, (1_700_000_000 + (i ^ 1),) * 2)


def some_events(n=400, seed=1):
    rng = random.Random(seed)
    events = [(i, START + datetime.timedelta(minutes=37 * i + rng.randrange(30), microseconds=rng.randrange(10**6)), rng.randrange(6), rng.choice(["purchase", "click", "view", "error"]), float(i)) for i in range(n)]
    return events


def queue_of(spark, folder):
    path = f"{folder}/events.parquet"
    delay = stateful.disorder(spark, path, "ts")
    stream = streams.source(spark, path, spark.read.parquet(path).schema, files_per_trigger=3)
    return delay, {(r.id, r.nth): r.state for r in stateful.retry_queue(flows.tries_of(stream), f"{folder}/out", f"{folder}/state", delay).collect()}


def brute_queue(events, delay):
    said = lambda e: records.MESSAGES[e[0] % len(records.MESSAGES)].lower()
    limited = [e for e in events if e[3] != "purchase" and ("429" in said(e) or "too many requests" in said(e))]
    ms = lambda t: (t - START) // datetime.timedelta(milliseconds=1)
    last, rest = max(ms(e[1]) for e in events) - 1000 * delay, stateful.REST_MS
    won = {}
    for e in events:
        if e[3] == "purchase":
            won.setdefault(e[2], []).append(ms(e[1]))
    of = lambda e: "waiting" if ms(e[1]) + rest > last else "settled" if any(ms(e[1]) < t <= ms(e[1]) + rest for t in won.get(e[2], [])) else "retry"
    return {(e[2], e[0]): of(e) for e in limited}


@pytest.mark.parametrize("files", [1, 12])
def test_retry_queue(spark, tmp_path, files):
    """Of one file, and of many that come out of order: what is due fires once, what isn't waits in the state."""
    events = some_events()
    write_events(tmp_path / "a", events, files)
    delay, found = queue_of(spark, tmp_path / "a")
    assert (delay > 0) == (files > 1)
    assert found == brute_queue(events, delay) and set(found.values()) >= {"retry", "settled"}
    pushed = [len(pd.read_parquet(x)) for x in (tmp_path / "a" / "out").rglob("*.parquet")]
    assert all(n <= stateful.PUSH for n in pushed)


def test_retry_queue_goes_on(spark, tmp_path):
    """What waits when a run ends fires in the next one."""
    events = some_events()
    write_events(tmp_path / "a", events[:200], 2)
    delay, first = queue_of(spark, tmp_path / "a")
    assert first == brute_queue(events[:200], delay)
    last = [(i + 1000, START + datetime.timedelta(days=40), 9, "view", 1.0) for i in range(2)]
    pd.DataFrame(events[200:] + last, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "a" / "events.parquet" / "part-99.parquet")
    _, second = queue_of(spark, tmp_path / "a")
    assert second == brute_queue(events + last, 0)


@pytest.mark.parametrize("files", [1, 20])
def test_event_windows(spark, tmp_path, files):
    """Equal to the batch query; days that the watermark has passed are gone from the state."""
    write_events(tmp_path / "a", some_events(), files)
    path = f"{tmp_path}/a/events.parquet"
    stream = streams.source(spark, path, spark.read.parquet(path).schema, files_per_trigger=3).withColumn("ts", F.col("ts").cast("timestamp"))
    table = flows.days_table(spark, f"{tmp_path}/days")
    progress = stateful.day_sums(stream, "user_id", "value", table, f"{tmp_path}/state", stateful.disorder(spark, path, "ts"))
    batch = records.batch_windows(spark, f"{tmp_path}/a").collect()
    found = streams.sliding(table.read(), "user_id").select("user_id", "day", (F.round("total", 4) + 0.0).alias("total"), "n").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch)) and len(batch) > 100
    states = [s for p in progress for s in p["stateOperators"]]
    assert all(s["numRowsDroppedByWatermark"] == 0 for s in states)
    if files == 1:
        assert sum(s["numRowsRemoved"] for s in states) > 40 and states[-1]["numRowsTotal"] <= 6


def test_cursor_goes_on(spark, tmp_path):
    rng = random.Random(2)
    pages = [(rng.choice(["a", "a", "b", "c", ""]), i, f"p{i}") for i in range(60)] + [(None, 99, "x"), ("a", None, "x")]
    rows, counts = cursor.numbered(spark.createDataFrame(pages, "host string, id long, first_line string").repartition(4), 3)
    at, seen = (f"file://{tmp_path}/out", f"file://{tmp_path}/state"), []
    for rounds in (1, 2, None, None):
        found = cursor.crawl(spark, rows, counts, 3, *at, rounds=rounds).collect()
        seen.append(len(found))
        assert len({r.id for r in found}) == len(found)
    assert seen[0] == sum(min(3, sum(h == x for h, i, _ in pages if i is not None)) for x in ("a", "b", "c", "")) and seen[0] < seen[1] < seen[2] == seen[3] == 60
    places = {}
    for host, i, _ in sorted((p for p in pages if p[0] is not None and p[1] is not None), key=lambda p: p[1]):
        places[i] = (host, len([1 for h, _ in places.values() if h == host]))
    assert {r.id: (r.host, r.nth) for r in found} == places and all(r["first"] == r.nth // 3 * 3 for r in found)


def files_of(path):
    return {str(x): (x.stat().st_size, x.stat().st_mtime_ns) for x in path.rglob("*.parquet")}


def test_keyed_table_changes_what_it_touches(spark, tmp_path):
    schema = StructType.fromDDL("id long, name string, n int")
    table = KeyedTable(spark, f"{tmp_path}/t", schema, ["id"], 8)
    assert table.read().count() == 0
    rows = spark.createDataFrame([(i, f"n{i}", 0) for i in range(100)] + [(None, "none", 0)], schema)
    table.change(rows, lambda old, new: merge.insert_ignore(old, new, "id", "name"))
    before = files_of(tmp_path / "t")
    new = spark.createDataFrame([(7, "seven", 1)], schema)
    for _ in range(2):  # made again it gives the same
        table.change(new, lambda old, new: merge.upsert(old, new, "id", ["name"]))
        after = files_of(tmp_path / "t")
        folder = lambda paths: {os.path.dirname(x) for x in paths}
        changed = {x for x in before if after.get(x) != before[x]}
        assert len(folder(changed)) == 1 and len(folder(after)) == 8 and all(BUCKET in x for x in folder(after))
        found = {r.id: (r.name, r.n) for r in table.read().collect()}
        assert found == {i: ("seven" if i == 7 else f"n{i}", 0) for i in range(100)} | {None: ("none", 0)}
    table.change(spark.createDataFrame([(5, 9), (1000, 9)], "id long, n int"), lambda old, new: merge.partial_update(old, new, "id"))
    assert {r.id: r.n for r in table.read().where("n > 0").collect()} == {5: 9} and table.read().count() == 101
    table.change(rows.limit(0), lambda old, new: merge.insert_ignore(old, new, "id", "name"))
    assert table.read().count() == 101


def test_metrics_of_all_runs(spark, tmp_path):
    events = some_events(60)
    write_events(tmp_path / "a", events[:30], 2)
    path = f"{tmp_path}/a/events.parquet"
    for more, total in ((None, 30), (events[30:], 60)):
        if more:
            pd.DataFrame(more, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{path}/part-99.parquet")
        stream = streams.source(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
        found = stateful.with_metrics(stream, lambda batch, n: batch.write.format("noop").mode("overwrite").save(), {"errors": F.count_if(F.col("event_type") == "error")}, f"{tmp_path}/metrics", f"{tmp_path}/state", f"run-{total}")
        rows = found.select("batch", "rows", "seconds", F.get_json_object("metrics", "$.errors").cast("long").alias("errors")).collect()
        assert sum(r.rows for r in rows) == total and sum(r.errors for r in rows) == sum(e[3] == "error" for e in events[:total])
        assert len({r.batch for r in rows}) == len(rows) and all(r.seconds > 0 for r in rows)
    assert len(rows) == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("query", [market.returns, market.silent_shocks, market.trend_follower, market.event_trajectories])
def test_windows_by_security_need_no_exchange(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ticker" not in plan.replace("#", " #").replace("ticker ", "ticker"), plan


def test_kept_tables_follow_their_sources(spark, tmp_path):
    """A file of a partition folder that is rewritten with as many bytes is seen; the table made before goes."""
    path = tmp_path / "x.parquet" / "k=1"
    path.mkdir(parents=True)
    made = []
    for i, value in enumerate((3, 3, 4)):
        if i != 1:
            pd.DataFrame({"v": [value]}).to_parquet(path / "part.parquet")
            os.utime(path / "part.parquet", (1_700_000_000 + i,) * 2)
        table = shared.kept(spark, str(tmp_path), "test", ["x"], lambda: spark.read.parquet(f"{tmp_path}/x.parquet"), ("v",))
        made.append((table.first().v, table.written_to))
    assert [v for v, _ in made] == [3, 3, 4] and made[0] == made[1] != made[2]
    assert not shared.exists(spark, made[0][1]) and shared.exists(spark, made[2][1])


def test_cursor_takes_a_long_host_in_few_batches(spark, tmp_path):
    """A host of 2,000 pages is a thousand rounds, and ten micro-batches; pages that come later are taken from where the host's cursor stood."""
    pages = spark.range(2000).select(F.lit("a").alias("host"), "id").unionByName(spark.createDataFrame([("b", i) for i in range(3)], "host string, id long"))
    at = (f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    found = cursor.crawl(spark, *cursor.numbered(pages, 2), 2, *at)
    assert sorted((r.host, r.nth, r["first"]) for r in found.collect()) == sorted((h, i, i // 2 * 2) for h, n in (("a", 2000), ("b", 3)) for i in range(n))
    assert len(list((tmp_path / "out").glob("batch=*"))) <= 11
    more = pages.unionByName(spark.createDataFrame([("b", 3), ("b", 4), ("c", 0)], "host string, id long"))
    found = cursor.crawl(spark, *cursor.numbered(more, 2), 2, *at).collect()
    assert len(found) == 2006 and {(r.id, r["first"]) for r in found if r.host == "b"} == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 3)}


def test_retry_queue_has_one_timer_for_a_key():
    """However many tries a key has; what is due by the watermark is told at one timer, as the rule says."""

    class List:
        def __init__(self):
            self.rows = []

        exists, get = lambda self: bool(self.rows), lambda self: iter(self.rows)
        appendList, put, clear = lambda self, x: self.rows.extend(x), lambda self, x: setattr(self, "rows", list(x)), lambda self: self.rows.clear()

    class Handle:
        timers, registered = set(), 0

        def getListState(self, name, schema):
            return List()

        def listTimers(self):
            return iter(sorted(self.timers))

        def registerTimer(self, at):
            self.timers.add(at)
            self.registered += 1

    rng, handle, queue = random.Random(8), Handle(), stateful.RetryQueue(100)
    queue.init(handle)
    rows = [SimpleNamespace(nth=i, at_ms=rng.randrange(5000), ok=i % 3 == 0, limited=i % 3 == 1) for i in range(600)]
    list(queue.handleInputRows((1,), iter(rows), None))
    assert handle.registered == 1
    found, mark = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: 3000)
    while handle.timers and min(handle.timers) < 3000:
        at = min(handle.timers)
        handle.timers.remove(at)
        found += [(r.nth, r.settled) for r in queue.handleExpiredTimer((1,), mark, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))]
    assert handle.registered == 2 and len(handle.timers) == 1 and min(handle.timers) >= 3000
    assert sorted(found) == sorted((r.nth, any(x.ok and r.at_ms < x.at_ms <= r.at_ms + 100 for x in rows)) for r in rows if r.limited and r.at_ms + 100 < 3000)
