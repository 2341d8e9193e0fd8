"""Learned sentiment on a planted signal; density against the sum over all rows; the least rows by a hash."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import density, learned, ranks


def test_learned_sentiment_finds_a_signal(spark):
    """Companies of which good words are said rise on the next day. Scores of documents by models that haven't seen them beat the shares of the labels."""
    rng, docs, mentions, bars, label = random.Random(4), [], [], [], {}
    for i in range(400):
        up = i % 3 != 0
        own = rng.choices(["rose", "gained"] if up else ["fell", "lost"], k=2) if rng.random() < 0.8 else []
        docs.append((i, "t", " ".join(own + rng.choices([f"w{k}" for k in range(200)], k=12)), "clash"))
        mentions.append((i, i, 0))
        bars += [(i, 1, 10.0), (i, 2, 11.0 if up else 9.0), (i, 3, 10.0)]
        label[i] = up
    docs += [(1000, None, None, "clash"), (1001, "", "", "clash")]
    bars = spark.createDataFrame(bars, "ticker long, d int, close double").select("ticker", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"), "close")
    articles = learned.labelled(spark.createDataFrame(docs, "id long, title string, content string, terms string").drop("terms"), spark.createDataFrame(mentions, "id long, ticker long, nth int"), learned.next_returns(bars))
    found = {r.id: r for r in learned.scored(articles).collect()}
    assert len(found) == 402 and {r.fold for r in found.values()} == {0, 1, 2} and all(0 <= r.pos <= 1 and 0 <= r.neg <= 1 for r in found.values())
    share = sum(label.values()) / 400
    loss = -sum(math.log(found[i].pos if up else found[i].neg) for i, up in label.items()) / 400
    prior = -(share * math.log(share) + (1 - share) * math.log(1 - share))
    assert loss < 0.7 * prior


def test_learned_sentiment_without_labels(spark):
    articles = spark.createDataFrame([(1, "a", "b", None), (2, "c", None, 1.0)], "id long, title string, content string, label double")
    assert [(r.pos, r.neg) for r in learned.scored(articles).collect()] == [(None, None)] * 2
    assert learned.scored(articles.limit(0)).count() == 0


@pytest.mark.parametrize("bins", [64, 1024])
def test_density_is_near_the_sum_over_all_rows(spark, bins):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 0.5, 100), [3.0] * 5])
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    found = sorted(map(tuple, density.density(rows, "x", bins=bins).collect()))
    h = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min(), x.max(), density.POINTS)
    want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    bound = ((x.max() - x.min()) / bins / h) ** 2 / 8 * 0.4 / h
    assert [p for p, *_ in found] == list(range(density.POINTS)) and np.allclose([v for _, v, _ in found], at)
    assert np.abs(np.array([d for *_, d in found]) - want).max() <= bound + 1e-12


def test_density_of_little(spark):
    assert density.density(spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double"), "x").count() == 0


@pytest.mark.parametrize("most", [5, 10_000])
@pytest.mark.parametrize("k", [0, 1, 37, 500, 1000])
def test_least_rows_are_those_of_a_sort(spark, monkeypatch, most, k):
    monkeypatch.setattr(ranks, "SORTED", most)
    monkeypatch.setattr(ranks, "DIGITS", 1)
    rows = [(f"{(i * 7919) % 300:06x}", i) for i in range(600)] + [(None, 7)]
    found = ranks.least(spark.createDataFrame(rows, "key string, n int").repartition(5), "key", ["n"], k)
    assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[0])[:k]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_texts_are_not_joined_with_labels(spark):
    """Labels apart give the same scores as labels beside the texts; the plan that scores has no exchange, so texts stay where they are read."""
    docs = spark.createDataFrame([(i, "t", f"{'rose' if i % 3 else 'fell'} w{i % 7}") for i in range(300)] + [(7, "t", "again"), (900, None, None)], "id long, title string, content string")
    labels = spark.createDataFrame([(i, 1.0 if i % 3 else 2.0) for i in range(0, 300, 2)] + [(7, None), (5000, 1.0)], "id long, label double")
    beside = learned.scored(docs.join(labels, "id", "left"))
    apart = learned.scored(docs, labels=labels)
    assert "Exchange" not in apart._jdf.queryExecution().executedPlan().toString()
    by = lambda rows: sorted((r.id, r.fold, round(r.pos, 6), round(r.neg, 6)) for r in rows.collect())
    a, b = by(apart), by(beside)
    assert len(a) == 302 and [x[:2] for x in a] == [x[:2] for x in b] and np.allclose(np.array(a), np.array(b), atol=2e-6)


def test_what_is_fitted_on_is_bounded(spark):
    """Of 3,000 labelled documents a model is fitted on about 300 of other folds; no more texts than any model needs are kept."""
    docs = spark.range(3000).selectExpr("id", "'t' AS title", "concat('w', id % 9) AS content")
    labels = spark.range(3000).selectExpr("id", "1.0 + id % 2 AS label").withColumn("label", F.col("label").cast("double"))
    rows, below = learned.examples(docs, labels, 3, 300)
    for fold in range(3):
        assert 200 < rows.where((F.col("fold") != fold) & (F.col("place") < below[fold])).count() < 400
    assert rows.count() < 600
