"""Percentiles and ranks over ranges of values."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bias, ranks


def test_percentiles_are_those_of_spark(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.round(F.sin("id"), 3)).alias("value"))
    counts = rows.groupBy("g", "value").agg(F.count("*").alias("n"))
    got = {r.g: (r.a, r.b, r.c) for r in ranks.percentiles(counts, ["g"], {"a": 0.01, "b": 0.5, "c": 0.99}).collect()}
    want = {r.g: tuple(r.p) for r in rows.groupBy("g").agg(F.percentile("value", F.array(*map(F.lit, (0.01, 0.5, 0.99)))).alias("p")).collect()}
    assert len(got) == 3 and got == {g: pytest.approx(p, rel=1e-12) for g, p in want.items()}


def test_positions_count_what_is_smaller(spark):
    counts = spark.createDataFrame([("x", 0.5, 2), ("x", 1.0, 3), ("x", 7.0, 1), ("y", -1.0, 4), ("y", 1.0, 1)], "g string, value double, n long")
    assert sorted((r.g, r.value, r.before) for r in ranks.positions(counts, ["g"]).collect()) == [("x", 0.5, 0), ("x", 1.0, 2), ("x", 7.0, 5), ("y", -1.0, 0), ("y", 1.0, 4)]


def test_scale_holds_no_map_of_all_values(spark):
    raw = spark.range(1001).select(F.sin("id").alias("bias_score"))
    scale, out = bias.scale_of(raw), io.StringIO()
    with contextlib.redirect_stdout(out):
        scale.explain()
    assert "percentile(" not in out.getvalue() and "median(" not in out.getvalue()
    median = raw.agg(F.median("bias_score")).first()[0]
    want = raw.agg(F.median(F.abs(F.col("bias_score") - median)), F.percentile(F.abs("bias_score"), F.lit(0.99))).first()
    assert tuple(scale.first()) == pytest.approx(tuple(want), rel=1e-12)
