"""Hand-made cases."""

from __future__ import annotations

import contextlib
import datetime
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import bias, indicators, merge, stats
from tidemark.sources import files, shared
from tidemark.sources import tables as T


@pytest.mark.parametrize(("t", "n", "p"), [(2.8398238308362544, 69248, 0.002257580242386239), (4.3742180509465864, 64112, 6.103023349155724e-06)])
def test_t_tail(t, n, p):
    assert stats.t_tail(t, n - 1) == pytest.approx(p, rel=1e-8)
    assert stats.t_tail(-t, n - 1) == pytest.approx(1 - p, rel=1e-8)
    assert stats.t_tail(0.0, 5) == pytest.approx(0.5)


def test_normal_tails():
    assert stats.normal_tails(1.959963984540054) == pytest.approx(0.05) == stats.normal_tails(-1.959963984540054)


def test_domain(spark):
    urls = {"https://www.a.com:80/x": "a.com:80", "//h.com/p": "h.com", "a.com/x": "", "http://u:p@WWW.b.com": "u:p@WWW.b.com", "http://awww.b.com": "ab.com"}
    found = spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.domain(F.col("u")).alias("d")).collect()
    assert {r.u: r.d for r in found} == urls


def test_handles(spark):
    """Quotes of both kinds or none, upper case, order, other uses, hosts that only end like a platform."""
    html = "".join(f'<a href="https://{x}">' for x in ("twitter.com/AbC", "twitter.com/AbC", "twitter.com/intent/tweet", "facebook.com/sharer", "youtube.com/@x", "linkedin.com/company/y"))
    html += """<A HREF='http://www.TWITTER.com/b'>x</A><a class=y href=https://facebook.com/p.q>x</a><a href="https://fedex.com/tracking">x</a><a href="https://linkedin.com/in/me">x</a><a href="https://twitter.com/AbC/Share">x</a>"""
    assert spark.createDataFrame([(html,)], "h string").select(X.handles(F.col("h")).alias("m")).first().m == {"twitter": ["AbC", "b"], "youtube": ["x"], "linkedin": ["y"], "facebook": ["p.q"]}


def test_error_classes(spark):
    want = {"HTTP 429 x": ("429", None), "403 Too many requests": ("429", None), "Forbidden": ("403", "HTTP 403 Forbidden"), "Page Not Found": ("404", "HTTP 404 Not Found"), "timed out 418": ("TIMEOUT", "Connection Timeout"),
            "Certificate": ("SSL_ERR", "SSL/Certificate Error"), "status 418": ("418", "Unknown Error"), "odd": (None, "Unknown Error"), "code 5000": ("500", "HTTP 500 Internal Server Error")}
    found = spark.createDataFrame([(m,) for m in want], "m string").select("m", X.error_class(F.col("m")).alias("e")).collect()
    assert {r.m: tuple(r.e) for r in found} == want


def test_phrase_does_not_trim(spark):
    assert spark.range(1).select(X.phrase(F.lit(" A, Inc. ")).alias("p")).first().p == '" A " AND language:en'


def test_clean_repeats_backs_up(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, title string")
    assert merge.clean_repeats(rows, "title", "id", f"{tmp_path}/dry").count() == 5
    assert sorted(r.id for r in merge.clean_repeats(rows, "title", "id", f"{tmp_path}/real", dry_run=False).collect()) == [1, 3, 4, 5]
    assert all([tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/{x}").collect()] == [("2", "a", "2")] for x in ("dry", "real"))


def test_scale_where_nothing_is_said(spark):
    """Where the 99th percentile is zero, the largest score stands in for it."""
    scale = bias.scale_of(spark.range(1000).select(F.when(F.col("id") == 7, 3.0).otherwise(0.0).alias("bias_score"))).first()
    assert tuple(scale) == (1e-6, pytest.approx(3.0 + 1e-6))


def test_columns(spark, tmp_path):
    twice = spark.range(1).select(F.lit("2024-01-31 10:00:00").alias("Date"), *[F.lit(1.0).alias(c) for c in ("Open", "High", "Low", "Close", "Close", "Volume")], F.lit(9).alias("Other"))
    assert [tuple(r) for r in files.price_rows(twice).collect()] == [(datetime.date(2024, 1, 31), 1.0, 1.0, 1.0, 1.0, 1.0)]
    with pytest.raises(ValueError, match="Volume"):
        files.price_rows(twice.drop("Volume"))
    bars = spark.createDataFrame([("A/B", "2024-01-01", 1.0, 2.0, 0.5, 1.5, 10, 0.1, "x")], "ticker string, date string, open double, high double, low double, close double, volume long, norm_bias_score double, other string")
    assert files.market_rows(bars).columns == ["date", "ticker", "open", "high", "low", "close", "volume", "bias_index"] and files.market_rows(bars.drop("open")) is None
    files.export_by_key(files.market_rows(bars), "ticker", f"{tmp_path}/by-key")
    files.export(bars.select("date", "close"), f"{tmp_path}/one")
    again = files.scan(spark, f"{tmp_path}/by-key", "date string, open double, high double, low double, close double, volume long, bias_index double", "ticker")
    assert [(r.ticker, r.bias_index) for r in again.collect()] == [("A_B", 0.1)]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "X-Y.csv").write_text("a\n1\n")
    assert [tuple(r) for r in files.scan(spark, f"{tmp_path}/plain", "a int", "key").collect()] == [(1, "X-Y")]


def test_bounds_reach_the_scan(spark, tmp_path):
    """Articles of days without bars aren't read; those of unknown companies and outlets don't count."""
    day = lambda i: datetime.datetime(2024, 1, i, 10)
    spark.createDataFrame([(i, 1, day(i)) for i in range(1, 29)] + [(99, None, day(5))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 30 or 99, 7 if i < 40 else 8, 0.1, 0.0) for i in range(60)], "l_orderkey long, l_suppkey long, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    found, out = T.articles(spark, str(tmp_path), datetime.date(2024, 1, 3), datetime.date(2024, 1, 6)), io.StringIO()
    assert sorted((r.ticker, r.date.day) for r in found.collect()) == [(7, 3), (7, 3), (7, 4), (7, 4), (7, 5), (7, 5), (7, 6), (7, 6)]
    with contextlib.redirect_stdout(out):
        found.explain("formatted")
    assert "GreaterThanOrEqual(o_orderdate" in out.getvalue() and "LessThan(o_orderdate" in out.getvalue()


def test_kept_follows_its_sources(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    made = []
    make = lambda: made.append(1) or spark.read.parquet(path)
    spark.range(3).write.parquet(path)
    assert [shared.kept(spark, str(tmp_path), "x", ["t"], make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert shared.kept(spark, str(tmp_path), "x", ["t"], make).count() == 5 and len(made) == 2


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, page int")
    new = spark.createDataFrame([(2, "B", 0), (3, "c", 0)], "k int, name string, page int")
    once = merge.upsert(old, new, "k", ["name"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 5), (2, "B", 6), (3, "c", 0)] == sorted(map(tuple, merge.upsert(once, new, "k", ["name"]).collect()))
    more = merge.insert_ignore(old, new.union(new), "k", "page")
    assert sorted(map(tuple, more.collect())) == [(1, "a", 5), (2, "b", 6), (3, "c", 0)]


def test_indicators_of_short_series():
    x = np.array([1.0, 2.0, 3.0])
    assert indicators.ema(np.array([np.nan, 1.0, 2.0]), 3)[1:].tolist() == [1.0, 1.5]
    assert np.isnan(indicators.smma(x, 4)).all() and indicators.atr(x, x - 1, x, 2).tolist() == [0.0, 1.0, 1.0]
    width, line, way = indicators.supertrend(x, x, x, 10)
    assert line.tolist() == [0, 0, 0] and set(way) == {"nan"}


def test_b5_is_macd_or_its_predecessor():
    x = np.random.default_rng(1).standard_normal(200).cumsum()
    y = indicators.b5(x)
    assert all(np.isclose(y[i], x[i]) or np.isclose(y[i], x[i - 1]) for i in range(1, 200))


def test_links_are_found_once(spark, tmp_path):
    """Not once for each platform and each column that is made of them."""
    from tidemark.plans import records

    spark.createDataFrame([(i,) for i in range(20)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = records.handle_extract(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r.c_custkey: (r.twitter, r.youtube, r.n) for r in found.collect()}[3] == (None, "ch3,u_3", 1)
