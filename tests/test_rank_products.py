"""Rank correlations and percentiles by blocks of rows, ranges and bins of values, which shuffle no rows."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bias, rank_products, ranks, stats
from tidemark.plans import market
from tidemark.sources import tables as T

NAMES = ["bias", *stats.HORIZONS]


def frame(n: int, seed: int = 3) -> pd.DataFrame:
    """Correlated columns with ties, one that is mostly one value, one of values that need all digits, one of huge and tiny ones, one with a single value."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    found = pd.DataFrame({"bias": np.clip(x, -1, 1), "ret_next": np.round(x + rng.normal(size=n), 1), "ret_5": x * x + rng.normal(size=n), "ret_14": np.exp(20 * rng.normal(size=n)) * np.sign(x), "ret_30": 0.25})
    found["regime"] = np.where(rng.random(n) < 0.05, None, np.where(found["bias"] > 0, "POSITIVE", "NEGATIVE"))
    return found


def expected(rows: pd.DataFrame) -> dict:
    found = {}
    for regime in ("OVERALL", "POSITIVE", "NEGATIVE"):
        own = rows if regime == "OVERALL" else rows[rows["regime"] == regime]
        rho = own[NAMES].round(9).corr(method="spearman")
        found |= {(regime, a, b): None if np.isnan(rho.loc[a, b]) else pytest.approx(rho.loc[a, b], abs=1e-12) for a in NAMES for b in NAMES}
    return found


def shuffled(spark, of) -> int:
    """Bytes that the stages of of() shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    of()
    return total() - before


def test_ranks_over_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(rank_products, "BLOCK", 700)
    monkeypatch.setattr(rank_products, "RANGE", 250)
    rows = frame(6000)
    found = {(r.regime, r.a, r.b): r.rho for r in stats.spearman(spark.createDataFrame(rows).repartition(3)).collect()}
    assert found == expected(rows)


def test_few_rows(spark):
    rows = frame(3).assign(regime="POSITIVE")
    found = {(r.regime, r.a, r.b): r.rho for r in stats.spearman(spark.createDataFrame(rows)).collect()}
    assert found == {at: x for at, x in expected(rows).items() if at[0] != "NEGATIVE"}
    assert stats.spearman(spark.createDataFrame(rows).where("bias > 9")).collect() == []
    with pytest.raises(Exception, match="null has no rank"):
        stats.spearman(spark.createDataFrame(rows).withColumn("ret_5", F.lit(None).cast("double"))).collect()


def test_rows_are_not_shuffled(spark, tmp_path):
    """Ranks of a row with five values took some 200 bytes; without ids they take few for each value."""
    n = 60_000
    spark.createDataFrame(frame(n)).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert shuffled(spark, lambda: stats.spearman(rows).collect()) < 50 * n


def test_percentiles_shuffle_few_values(spark, tmp_path):
    """Of values that hardly repeat, each was shuffled three times and written for a percentile."""
    n = 200_000
    spark.range(n).select(F.sin("id").alias("bias_score"), F.cos("id").alias("ret_next"), F.when(F.col("id") % 2 == 0, "POSITIVE").otherwise("NEGATIVE").alias("sign")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert shuffled(spark, lambda: stats.tails(rows).collect()) < 10 * n
    assert shuffled(spark, lambda: bias.scale_of(rows).collect()) < 20 * n


def test_percentiles_of_odd_values(spark):
    """Values that aren't finite, far apart or next to each other, some of them often, in a group without name, and groups of one value or none."""
    nan, inf = float("nan"), float("inf")
    values = {
        None: [-inf, -inf, -1.7e308, -1.0, -0.0, 0.0, 5e-324, 1e-323, 1.0, 1.0000000000000002, 1.0000000000000004, 1.7e308, inf, nan, nan],
        "x": [inf, nan], "y": [2.5], "z": [None], "w": [-1.7e308, 0.5, 0.5, 0.5, 0.5, 1.7e308], "v": [1e15, *(i / 7 for i in range(500))],
    }
    rows = spark.createDataFrame([(g, x, 1 + i % 3) for g, own in values.items() for i, x in enumerate(own)], "g string, value double, n int").repartition(3)
    wanted = {f"p{i}": i / 20 for i in range(21)}
    found = {r.g: r for r in ranks.percentiles(rows, ["g"], wanted).collect()}
    assert set(found) == set(values) - {"z"}
    for g, r in found.items():
        every = sorted((x for i, x in enumerate(values[g]) for _ in range(1 + i % 3)), key=lambda x: (x != x, x))
        for name, p in wanted.items():
            at = (len(every) - 1) * p
            low, high = every[int(np.floor(at))], every[int(np.ceil(at))]
            want = low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high
            assert r[name] == want or (r[name] != r[name] and want != want), (g, name)


def test_tasks_are_dealt_so_many_lines(spark, tmp_path, monkeypatch):
    """However few shuffle partitions there are, a task sorts a bounded number of rows of bars and index."""
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, market.rounded(market.raw(spark, sf)).collect()))
    monkeypatch.setattr(T, "DEALT", 500)
    os.symlink(sf, tmp_path / "same")
    bars, raw = T.bars(spark, f"{tmp_path}/same"), market.raw(spark, f"{tmp_path}/same")
    assert bars.buckets == raw.buckets == 12
    index = bias.raw_index(bars, T.articles(spark, sf), T.outlets(spark, sf), True)
    assert set(re.findall(r"hashpartitioning\(\w+#\w+, (\d+)\), REPARTITION|hashpartitioning\(ticker#\w+, (\d+)\), ENSURE", index._jdf.queryExecution().executedPlan().toString())) == {("12", "")}
    assert sorted(map(tuple, market.rounded(raw).collect())) == want


def test_numbers_come_back():
    values = np.array([-np.inf, -1e300, -2.5, -1e-9, 0.0, 1e-9, 0.1, 4e6, 1e300, np.inf, np.nan])
    for own in (values, values[2:8], values[:0]):
        scale, numbers = rank_products.whole(own)
        again = rank_products.unpacked(rank_products.packed(scale, rank_products.steps(numbers)))
        np.testing.assert_array_equal(rank_products.doubles(again[0], np.cumsum(again[1])), own)
    assert rank_products.whole(values[2:8])[0][0] == rank_products.DIGITS and rank_products.whole(values)[0][0] == 0
