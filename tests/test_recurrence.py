"""Recurrences as a scan over many ranges against the array code of the indicators, and against plain loops."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators import recurrence as R


def test_one_long_series_is_many_ranges(spark):
    """EMA, its double, smoothed means and the true range's of one security, of which each range holds a part."""
    rng = np.random.default_rng(1)
    close = 100 + rng.standard_normal(3000).cumsum()
    high, low = close + rng.random(3000), close - rng.random(3000)
    rows = [("a", datetime.date(2000, 1, 1) + datetime.timedelta(days=i), float(h), float(lo), float(c)) for i, (h, lo, c) in enumerate(zip(high, low, close, strict=True))]
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        bars = spark.createDataFrame(rows + [("b", *r[1:]) for r in rows[:5]], "ticker string, date date, high double, low double, close double").repartition(3)
        first = R.scan(bars, "ticker", ["date"], {"nth": R.counted(), "total": R.running(F.col("high")), "ema10": R.ema(F.col("close"), 10), "once": R.ema((F.col("high") + F.col("low") + F.col("close")) / 3, 34), "before": (F.lit(0.0), F.col("close"), F.col("close"))})
        second = R.scan(first, "ticker", ["date"], {"twice": R.ema(F.col("once"), 34), "smma34": R.smoothed(F.col("high"), 34, F.col("nth"), F.col("total"))})
        found = second.orderBy("ticker", "date").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    own = found[found["ticker"] == "a"]
    assert len(own) == 3000 and own["nth"].tolist() == list(range(3000)) and np.allclose(own["total"], high.cumsum(), rtol=1e-12)
    assert np.allclose(own["ema10"], I.ema(close, 10), rtol=1e-12) and np.allclose(own["smma34"].astype(float), I.smma(high, 34), rtol=1e-12, equal_nan=True)
    assert np.allclose(2 * own["once"] - own["twice"], I.zlema((high + low + close) / 3, 34), rtol=1e-12)
    assert found[found["ticker"] == "b"]["nth"].tolist() == [0, 1, 2, 3, 4] and found[found["ticker"] == "b"]["smma34"].isna().all()


@pytest.mark.parametrize("parts", [1, 7])
def test_scan_is_a_loop(spark, parts):
    """Maps that change from row to row, nulls, hot and small keys, rows of no series, columns named like the scan's own."""
    rng, rows = random.Random(5), []
    for i in range(400):
        x = lambda: None if rng.random() < 0.2 else rng.uniform(-1, 1)
        rows.append((rng.choice([1, 1, 1, 2, 3]), i // 2, i, x(), x(), x(), "own"))
    rows += [(None, 1, 1, 0.5, 0.5, 0.5, "own"), (1, None, 1, 0.5, 0.5, 0.5, "own"), (9, 1, 1, None, 0.5, 0.5, "own")]
    df = spark.createDataFrame(rows, "k long, t int, n int, a_0 double, b_0 double, s_0 double, row string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = R.scan(df.repartition(3), "k", ["t", "n"], {"y": (F.col("a_0"), F.col("b_0"), F.col("s_0"))})
        assert found.columns == [*df.columns, "y"]
        got = {(r.k, r.t, r.n): (r.y, r.row) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, states = {}, {}
    for k, t, n, a, b, s, own in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:3]):
        if None not in (a, b, s):
            states[k] = s if states.get(k) is None else a * states[k] + b
        want[k, t, n] = (states.get(k), own)
    assert got.keys() == want.keys()
    assert all(got[i][1] == "own" and (got[i][0] is None) == (want[i][0] is None) and (want[i][0] is None or got[i][0] == pytest.approx(want[i][0], abs=1e-12)) for i in want)
    assert R.scan(df.limit(0), "k", ["t", "n"], {"y": R.running(F.col("a_0"))}).count() == 0


@pytest.mark.parametrize("short", [False, True])
def test_linear_indicators_join_nothing(spark, short):
    """The same as from the array code, where series are ranges and where they stay; of what a scan has written no row is shuffled again."""
    rng, rows = np.random.default_rng(2), []
    for k, n in ((1, 300), (2, 5), (3, 40), (4, 1)):
        close = 100 + rng.standard_normal(n).cumsum()
        rows += [(k, datetime.date(2000, 1, 1) + datetime.timedelta(days=i), float(c + rng.random()), float(c - rng.random()), float(c), 7) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "ticker long, date date, high double, low double, close double, volume long").repartition(4, "ticker")
    found = I.linear(bars, short=short)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ticker") == short and "rangepartitioning" not in plan and "SortMergeJoin" not in plan, plan
    want = I.indicators(bars).orderBy("ticker", "date").toPandas()
    found = found.orderBy("ticker", "date").toPandas()
    assert len(found) == 346
    for c in ("ema10", "smma34", "zlema34", "atr", "smooth_velocity"):
        assert np.allclose(found[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_indicators_of_many_series_at_once(spark, monkeypatch):
    """Blocks of securities give what each gives alone, whatever their lengths, with prices that lack or stand still; Python is called for blocks, not for securities."""
    rng, lengths, rows = np.random.default_rng(6), [1, 2, 9, 10, 34, 35, 60, 130, 300, 50, 51, 20], []
    for k, n in enumerate(lengths):
        close = 100 + rng.standard_normal(n).cumsum() if k % 4 else np.full(n, 5.0)
        rows += [(k, datetime.date(2000, 1, 1) + datetime.timedelta(days=i), None if k == 8 and i == 200 else float(c + 1), float(c - 1), float(c), int(rng.integers(0, 9))) for i, c in enumerate(close)]
    monkeypatch.setattr(I, "BLOCK", 150)
    monkeypatch.setattr(I, "BATCH", 64)
    bars = spark.createDataFrame(rows, "ticker long, date date, high double, low double, close double, volume long").repartition(3)
    frame = I.indicators(bars)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan, plan
    found = frame.orderBy("ticker", "date").toPandas()
    assert len(found) == sum(lengths)
    for k, own in found.groupby("ticker"):
        series = [r for r in rows if r[0] == k]
        alone = I.of_series(*(np.array([r[i] for r in series], dtype=float) for i in (2, 3, 4, 5)))
        for c, y in alone.items():
            assert own[c].tolist() == y.tolist() if c == "stx" else np.allclose(own[c].astype(float), y, rtol=1e-12, equal_nan=True), (k, c)
