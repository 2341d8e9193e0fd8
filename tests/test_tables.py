"""Upserts with handles, CSV files that lack columns, downloaded frames, rank correlations against pandas."""

from __future__ import annotations

import datetime
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bias, merge, stats
from tidemark.plans import market, records
from tidemark.sources import files
from tidemark.sources import tables as T

OUTLETS = "id long, domain string, name string, handles map<string,array<string>>"


def test_upsert_with_handles(spark):
    old = spark.createDataFrame([(3, "a.com", "A", {"x": ["q", "b"]}), (9, "b.com", "B", {"x": ["z", "a"]}), (5, "n.com", None, None)], OUTLETS)
    new = [("a.com", "A1", {"x": ["b", "c"], "y": []}, 1), ("a.com", "A2", {"x": ["c", None]}, 2), ("d.com", "D", None, 1), ("c.com", None, {"z": ["k"]}, 1), (None, "none", {"x": ["n"]}, 1)]
    out = merge.upsert_with_handles(old, spark.createDataFrame(new, "domain string, name string, handles map<string,array<string>>, at int"), "domain", "name", "handles", "at")
    found = {r.domain: (r.id, r["name"], r.handles) for r in out.collect()}
    assert found == {
        "a.com": (3, "A2", {"x": ["b", "c", "q"], "y": []}), "b.com": (9, "B", {"x": ["z", "a"]}), "n.com": (5, None, {}), "c.com": (10, None, {"z": ["k"]}), "d.com": (11, "D", {}),
    }
    again = merge.upsert_with_handles(out, spark.createDataFrame(new, "domain string, name string, handles map<string,array<string>>, at int"), "domain", "name", "handles", "at")
    assert {r.domain: (r.id, r["name"], r.handles) for r in again.collect()} == found


def test_files_that_lack_columns(spark, tmp_path):
    for name, text in {"A.csv": "x,y\n1,2\n", "B B.csv": "x,z\n1,2\n", "C.csv": '"x"," y ",z\n1,2,3\n', "D.csv": "", "E.csv": "y,xx\n"}.items():
        (tmp_path / name).write_text(text)
    for part, text in enumerate(("x,y\n1,2\n", "x\n1\n")):
        (tmp_path / "key=F").mkdir(exist_ok=True)
        (tmp_path / "key=F" / f"part-{part}.csv").write_text(text)
    assert sorted(r.key for r in files.complete_keys(spark, str(tmp_path), ["x", "y"], "key").collect()) == ["A", "C"]


def test_downloaded_prices(spark):
    at = datetime.datetime(2024, 1, 2, 16, 30)
    rows = spark.createDataFrame([("a", at, 1.0, 2.0, 0.5, 1.5, 9.0, 7), ("a", None, 1.0, 2.0, 0.5, 1.5, 9.0, 7)], "t string, Date timestamp_ntz, Open double, High double, Low double, c1 double, c2 double, Volume long")
    found = files.price_rows(rows.toDF("t", "Date", "Open", "High", "Low", "Close", "Close", "Volume"), "t")
    assert [tuple(r) for r in found.collect()] == [("a", at.date(), 1.0, 2.0, 0.5, 1.5, 7)]
    with pytest.raises(ValueError, match="Close"):
        files.price_rows(rows.select("t", "Date", "Open", "High", "Low", "Volume"))


def test_rank_correlations_are_those_of_pandas(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({c: rng.integers(-20, 20, 500) / 10 for c in ["bias", *stats.HORIZONS]})
    frame["regime"] = np.where(rng.random(500) < 0.1, None, np.where(frame["bias"] > 0, "POSITIVE", "NEGATIVE"))
    found = {(r.regime, r.a, r.b): r.rho for r in stats.spearman(spark.createDataFrame(frame).repartition(5)).collect()}
    for regime in ("OVERALL", "POSITIVE", "NEGATIVE"):
        own = frame if regime == "OVERALL" else frame[frame["regime"] == regime]
        want = own[["bias", *stats.HORIZONS]].corr(method="spearman")
        assert all(found[regime, a, b] == pytest.approx(want.loc[a, b]) for a in want for b in want)
    assert len(found) == 75


def test_index_of_days_without_bars(spark):
    """A bar has what stands in the 15 days up to it, whether on days with bars or not, and keeps its own columns."""
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    bars = spark.createDataFrame([("a", day(i), float(i), None) for i in (3, 17, 18, 40)] + [("b", day(3), 1.0, 2.0)], "ticker string, date date, close double, s double")
    articles = spark.createDataFrame([("a", day(3), 1, 0.5, 0.0), ("a", day(4), 1, 0.25, None), ("a", day(4), 2, 9.0, 0.0), ("c", day(3), 1, 1.0, 0.0)], "ticker string, date date, outlet_id int, pos double, neg double")
    outlets = spark.createDataFrame([(1, float(bias.MOST_FOLLOWERS))], "id int, avg_followers double")
    found = bias.raw_index(bars, articles, outlets).orderBy("ticker", "date")
    assert found.columns == ["ticker", "date", "close", "s", "bias_score", "n_articles"]
    assert [(r.ticker, r.date, r.close, r.s, round(r.bias_score, 9), r.n_articles) for r in found.collect()] == [
        ("a", day(3), 3.0, None, 0.5, 1), ("a", day(17), 17.0, None, 0.75, 2), ("a", day(18), 18.0, None, 0.25, 1), ("a", day(40), 40.0, None, 0.0, 0), ("b", day(3), 1.0, 2.0, 0.0, 0),
    ]


def test_merges_broadcast_no_side(spark):
    """Files of keys in order are so small that Spark would broadcast millions of rows of them."""
    queue = records._queue(spark, "/root/testdata/sf0.001")
    tries = records._outcomes(queue)
    keys = queue.select("id")
    found = [
        merge.insert_ignore(queue, queue, "id", "retry"), merge.scrape_update(queue, tries, records.now()), merge.partial_update(queue, keys.withColumn("retry", F.lit(1)), "id"),
        merge.append_new(queue, queue, ["id"]), merge.upsert(queue, queue, "id", ["retry"]), merge.delete_repeats(queue, "id", "retry"),
    ]
    for x in found:
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan, plan


def test_derived_tables_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Bars, indicators and features go to their buckets in one exchange or none, and are the same where series are long and days are summed first."""
    sf, by_ticker = "/root/testdata/sf0.001", "hashpartitioning(ticker"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().replace("l_suppkey", "ticker")
    bars = T.daily_bars(spark, sf)
    assert plan(bars).count("Exchange") == 1 and by_ticker in plan(bars)
    features = stats.features(market.norm(spark, sf))
    assert by_ticker not in plan(features) and "SortMergeJoin" not in plan(features) and by_ticker not in plan(market.all_indicators(spark, sf))
    found = [sorted(map(tuple, x.collect())) for x in (bars, market.rounded(market.raw(spark, sf)))]
    monkeypatch.setattr(T, "SHORT", 1)
    os.symlink(sf, tmp_path / "same")
    long = [T.daily_bars(spark, sf), market.rounded(market.raw(spark, f"{tmp_path}/same"))]
    by_day = [re.search(r"hashpartitioning\(ticker#\w+, \w+#", plan(x)) is not None for x in (bars, long[0])]
    assert by_day == [False, True] and [sorted(map(tuple, x.collect())) for x in long] == found
