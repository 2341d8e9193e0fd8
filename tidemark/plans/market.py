"""Queries on bars and the bias index, with their SQL."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import windows as W
from tidemark.operators import bias, indicators, merge, ranks, stats
from tidemark.sources import files
from tidemark.sources import tables as T
from tidemark.sources.shared import kept, placed, shared_dir
from tidemark.sources.tables import BARS_SQL, BY_DATE


#: The tables of which the index is made.
INDEXED = ["lineitem", "orders", "customer", "supplier"]
SAMPLE_ROWS, SAMPLE_TICKERS, SEED = 50_000, 10, 7


#: Quotients of two columns, which are the same wherever they are made; all other fractions are rounded.
PRICES = {"open", "high", "low", "close", "into", "inth", "intl", "intc"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in PRICES else F.col(c) for c, t in df.dtypes])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        bars = T.bars(spark, sf_dir)
        first, last = bars.agg(F.min("date"), F.max("date")).first()
        reach = (first - timedelta(days=bias.DAYS_BACK + 1), last + timedelta(days=1)) if first else (None, None)
        return bias.raw_index(bars, T.articles(spark, sf_dir, *reach), T.outlets(spark, sf_dir), T.short_series(spark, sf_dir))

    return kept(spark, sf_dir, "raw-index", INDEXED, make, BY_DATE)


def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the raw and the normalised index, which is made of the raw one whenever it is read: only the scale, a row, is kept. Only scores that are there count for it."""
    scale = kept(spark, sf_dir, "scale", INDEXED, lambda: bias.scale_of(raw(spark, sf_dir)))
    return bias.normalised(raw(spark, sf_dir), scale)


def all_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made when read: one query reads them, so a table of them would only be written to be read again."""
    return indicators.indicators(T.bars(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows where all indicators are there, what the anomalies need; the indicators themselves aren't kept."""

    def make() -> DataFrame:
        found = stats.features(norm(spark, sf_dir)).select("ticker", "date", "close", "volume", "norm_bias_score", "rel_vol")
        return placed(found, raw(spark, sf_dir).buckets)

    return kept(spark, sf_dir, "features", INDEXED, make, BY_DATE)


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        return stats.ahead(stats.study_rows(norm(spark, sf_dir), T.companies(spark, sf_dir)))

    rows = kept(spark, sf_dir, "returns", INDEXED, make)
    return stats.signed(rows, kept(spark, sf_dir, "tails", INDEXED, lambda: stats.tails(rows)))


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.regimes(signed(spark, sf_dir))


def bars_daily(spark, sf_dir):
    return T.bars(spark, sf_dir)


def bias_raw(spark, sf_dir):
    return rounded(raw(spark, sf_dir).select("ticker", "date", "bias_score", "n_articles"))


def bias_norm(spark, sf_dir):
    return rounded(norm(spark, sf_dir).select("ticker", "date", "bias_score", "norm_bias_score"))


def bias_saturation(spark, sf_dir):
    """Mean, deviation, outliers beyond two of them, clamped and nearly clamped rows, the least raw score of these, the raw scores' 99th percentile."""
    rows = norm(spark, sf_dir).select("bias_score", "norm_bias_score")
    two = rows.agg(F.avg("norm_bias_score").alias("mean"), F.stddev_samp("norm_bias_score").alias("dev"))
    sizes = rows.select(F.lit(1).alias("one"), F.abs("bias_score").alias("value"), F.lit(1).alias("n"))
    p_ref = ranks.percentiles(sizes, ["one"], {"p_ref": 0.99}).select("p_ref")
    x = F.col("norm_bias_score")
    found = rows.crossJoin(F.broadcast(two)).groupBy("mean", "dev").agg(  # one row
        F.count("*").alias("n"), F.count_if(F.abs(x - F.col("mean")) > 2 * F.col("dev")).alias("outliers"), F.count_if(F.abs(x) >= 0.999999).alias("clamped"), F.count_if(F.abs(x) >= 0.9).alias("high"),
        F.coalesce(F.min(F.when(F.abs(x) >= 0.9, F.abs("bias_score"))), F.lit(0.0)).alias("raw_threshold"),
    )
    shares = {f"{c}_percent": 100 * F.col(c) / F.col("n") for c in ("outliers", "clamped", "high")}
    return rounded(found.crossJoin(F.broadcast(p_ref)).withColumns(shares))  # one row


def bias_bands(spark, sf_dir):
    """The daily means, of the normalised and of the raw index, with what the figures draw around them: mean and two deviations of all rows."""
    rows = norm(spark, sf_dir)
    bounds = []
    for name, column in (("norm", "norm_bias_score"), ("raw", "bias_score")):
        mean, dev = F.avg(column), F.stddev_samp(column)
        bounds += [(mean - 2 * dev).alias(f"{name}_low"), mean.alias(f"{name}_all"), (mean + 2 * dev).alias(f"{name}_high")]
    days = rows.groupBy("date").agg(F.avg("norm_bias_score").alias("norm_mean"), F.avg("bias_score").alias("raw_mean"))
    return rounded(days.crossJoin(F.broadcast(rows.agg(*bounds)))).orderBy("date")  # one row


def bias_scatter(spark, sf_dir):
    """Raw and normalised scores of at most SAMPLE_ROWS rows, the first by a seeded hash."""
    key = F.md5(F.concat_ws("|", F.lit(SEED), "ticker", "date"))
    rows = norm(spark, sf_dir).select("ticker", "date", "bias_score", "norm_bias_score", key.alias("key"))
    return rounded(ranks.least(rows, "key", ["ticker", "date"], SAMPLE_ROWS).drop("key"))


def ticker_sample(spark, sf_dir):
    """SAMPLE_TICKERS of all tickers, the first by a seeded hash, and the days that a preview shows of them: the first 50 of all."""
    chosen = T.bars(spark, sf_dir).select("ticker").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(SEED), "ticker")), "ticker").limit(SAMPLE_TICKERS)
    return rounded(raw(spark, sf_dir).join(F.broadcast(chosen), "ticker").orderBy("date", "ticker").limit(50).select("ticker", "date", "bias_score", "n_articles"))  # SAMPLE_TICKERS rows


def tickers(spark, sf_dir):
    return T.bars(spark, sf_dir).select("ticker").distinct()


def study_input(spark, sf_dir):
    """Prices and index of the ten securities with the most articles."""
    return rounded(stats.study_rows(norm(spark, sf_dir), T.companies(spark, sf_dir), 10)).orderBy("ticker", "date")


def market_daily_mean(spark, sf_dir):
    return rounded(norm(spark, sf_dir).groupBy("date").agg(F.avg("bias_score").alias("raw_mean"), F.avg("norm_bias_score").alias("norm_mean")))


def bias_by_month(spark, sf_dir):
    rows = stats.silent_shocks(features(spark, sf_dir))
    return rows.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count_if("silent_anomaly").alias("silent"), F.count("*").alias("n"))


def returns(spark, sf_dir):
    rows = T.bars(spark, sf_dir).withColumns({"log_ret": W.log_return(), "ret": W.pct_change(), "rel_vol": W.relative_volume()})
    ahead = {k: F.lead("ret", 1).over(W.by_date()) if n == 1 else W.full(F.sum, "ret", 1, n) for k, n in stats.HORIZONS.items()}
    return rounded(rows.withColumns(ahead).select("ticker", "date", "log_ret", "ret", "rel_vol", *stats.HORIZONS))


def copy_projection(spark, sf_dir):
    """The prices are copied into the index's table, which has those of every other security with their scores already."""
    target = rounded(raw(spark, sf_dir).where("ticker % 2 = 0").select("ticker", "date", "close", "volume", "bias_score"))
    return merge.append_new(target, T.bars(spark, sf_dir), ["ticker", "date"])


def indicators_all(spark, sf_dir):
    return rounded(all_indicators(spark, sf_dir), 4)


def linear_indicators(spark, sf_dir):
    """Those indicators whose recurrence is linear, by a scan along the series: of short ones where their bars stand."""
    return rounded(indicators.linear(T.bars(spark, sf_dir), short=T.short_series(spark, sf_dir)), 4)


def features_full(spark, sf_dir):
    names = {"date": "time", "ticker": "stock_name", "norm_bias_score": "bias_index", "open": "into", "high": "inth", "low": "intl", "close": "intc", "volume": "v", "stx": "STX", "impulse_histo": "ImpulseHisto"}
    columns = [*names, "psi", "smooth_velocity", "macd", "b5", "rel_vol"]
    return rounded(stats.features(norm(spark, sf_dir)).select(*[F.col(c).alias(names.get(c, c)) for c in columns]), 4)


def silent_shocks(spark, sf_dir):
    """The largest moves first."""
    names = {"date": "time", "ticker": "stock_name", "norm_bias_score": "bias_index", "close": "intc", "volume": "v"}
    columns = [*names, "rel_vol", "z_score_price", "is_volume_shock", "silent_anomaly"]
    rows = rounded(stats.silent_shocks(features(spark, sf_dir)).select(*[F.col(c).alias(names.get(c, c)) for c in columns]))
    return rows.orderBy(F.desc_nulls_last(F.abs("z_score_price")), "stock_name", "time")


def silent_report(spark, sf_dir):
    return stats.silent_report(stats.silent_shocks(features(spark, sf_dir)))


def files_by_ticker(spark, sf_dir):
    """Silent shocks as a CSV file for each security, read again with the security from the file's name, times that can't be read as null."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    shocks = stats.silent_shocks(features(spark, sf_dir)).select("ticker", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("time"), "silent_anomaly", (F.round("rel_vol", 6) + 0.0).alias("rel_vol"))
    files.export_by_key(shocks, "ticker", folder)
    again = files.scan(spark, folder, "time string, silent_anomaly boolean, rel_vol double", "ticker")
    return again.select(F.col("ticker").cast("long").alias("ticker"), F.to_date(X.time_or_null(F.col("time"))).alias("date"), "silent_anomaly", "rel_vol")


def trend_follower(spark, sf_dir):
    return rounded(stats.trend_followers(features(spark, sf_dir)))


def follower_share(spark, sf_dir):
    rows = stats.trend_followers(features(spark, sf_dir))
    return rounded(rows.agg(F.count("*").alias("n"), (100 * F.avg((F.col("behavior") == "Trend Follower").cast("int"))).alias("followers")), 4)


def event_study(spark, sf_dir):
    found = rounded(stats.event_study(stats.trajectories(features(spark, sf_dir))))
    return found.select(stats.labelled("sign", stats.SHOCKS).alias("metric"), "n", "mean", "t", "p", "verdict")


def event_trajectories(spark, sf_dir):
    return rounded(stats.mean_path(stats.trajectories(features(spark, sf_dir))).withColumns({"low": F.col("mean") - 1.96 * F.col("sem"), "high": F.col("mean") + 1.96 * F.col("sem")}))


def spearman_matrix(spark, sf_dir):
    return rounded(stats.spearman(signed(spark, sf_dir)))


def panel_regression(spark, sf_dir):
    found = stats.panel(regimes(spark, sf_dir)).withColumn("label", X.significance(F.col("p"), "Insignificant"))
    return rounded(found.withColumns({"low": F.col("beta") - 1.96 * F.col("se"), "high": F.col("beta") + 1.96 * F.col("se")}))


def regression_report(spark, sf_dir):
    return stats.regression_report(stats.panel(regimes(spark, sf_dir)))


RAW_SQL = f"""{BARS_SQL},
daily AS (SELECT l_suppkey AS ticker, CAST(o_orderdate AS DATE) AS date, count(*) AS n,
  sum((coalesce(l_discount, 0) - coalesce(l_tax, 0)) * log10(1 + greatest(coalesce(c_acctbal, 0), 0)) / log10(41000001e0)) AS s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2),
raw AS (SELECT b.ticker, b.date, any_value(b.close) AS close, any_value(b.volume) AS volume, coalesce(sum(d.s), 0) AS bias_score, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n_articles
  FROM bars b LEFT JOIN daily d ON d.ticker = b.ticker AND d.date BETWEEN b.date - 14 AND b.date GROUP BY b.ticker, b.date)"""
NORM_SQL = f"""{RAW_SQL},
sc AS (SELECT greatest(mad(bias_score), 1e-6) AS s, CASE WHEN quantile_cont(abs(bias_score), 0.99) > 0 THEN quantile_cont(abs(bias_score), 0.99) ELSE max(abs(bias_score)) + 1e-6 END AS p FROM raw),
norm AS (SELECT raw.*, greatest(-1e0, least(1e0, asinh(bias_score / s) / asinh(p / s))) AS norm_bias_score FROM raw, sc)"""
FEATURES_SQL = f"""{NORM_SQL},
vols AS (SELECT *, row_number() OVER w - 1 AS t, CASE WHEN count(*) OVER v = 50 THEN volume / nullif(avg(volume) OVER v, 0) END AS rel_vol FROM norm
  WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
feat AS (SELECT * EXCLUDE (t), close / nullif(lag(close) OVER w, 0) AS ratio, row_number() OVER w - 1 AS t FROM vols WHERE t >= 49 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
lr AS (SELECT *, CASE WHEN ratio > 0 THEN ln(ratio) END AS log_ret FROM feat)"""
SILENT_SQL = f"""{FEATURES_SQL},
zed AS (SELECT *, CASE WHEN stddev_samp(log_ret) OVER w = 0 THEN 0 ELSE (log_ret - avg(log_ret) OVER w) / stddev_samp(log_ret) OVER w END AS z, count(*) OVER w AS n FROM lr WINDOW w AS (PARTITION BY ticker)),
silent AS (SELECT ticker, date, close, volume, norm_bias_score, rel_vol, z AS z_score_price, coalesce(rel_vol > 3, false) AS is_volume_shock,
  (coalesce(abs(z) > 3, false) OR coalesce(rel_vol > 3, false)) AND coalesce(abs(norm_bias_score) < 0.1, false) AS silent_anomaly FROM zed WHERE n >= 10)"""
FOLLOW_SQL = f"""{FEATURES_SQL},
xy AS (SELECT ticker, log_ret AS x, CASE WHEN count(*) OVER f = 28 THEN avg(norm_bias_score) OVER f END AS y FROM lr WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 14 FOLLOWING AND 41 FOLLOWING)),
follow AS (SELECT ticker, regr_slope(y, x) AS slope, count(*) AS n FROM xy WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ticker HAVING count(*) >= 50)"""
PATHS_SQL = f"""{FEATURES_SQL},
around AS (SELECT ticker, date, norm_bias_score AS here, log_ret, t, list(norm_bias_score) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 10 FOLLOWING) AS a FROM lr),
paths AS (SELECT CASE WHEN log_ret > 0.02 THEN 'positive' ELSE 'negative' END AS sign, ticker, date, list_transform(a, lambda x: x - here) AS path FROM around WHERE len(a) = 16 AND t >= 5 AND abs(log_ret) > 0.02)"""
REGIMES_SQL = f"""{NORM_SQL},
pc AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM norm WINDOW w AS (PARTITION BY ticker ORDER BY date)),
ah AS (SELECT ticker, norm_bias_score AS bias, lead(ret) OVER w AS ret_next,
  CASE WHEN count(ret) OVER a = 5 THEN sum(ret) OVER a END AS ret_5, CASE WHEN count(ret) OVER b = 14 THEN sum(ret) OVER b END AS ret_14, CASE WHEN count(ret) OVER c = 30 THEN sum(ret) OVER c END AS ret_30
  FROM pc WINDOW w AS (PARTITION BY ticker ORDER BY date), a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),
  b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), c AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)),
ok AS (SELECT *, CASE WHEN bias > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sign FROM ah
  WHERE abs(bias) > 0.001 AND ret_next IS NOT NULL AND ret_5 IS NOT NULL AND ret_14 IS NOT NULL AND ret_30 IS NOT NULL),
q AS (SELECT sign, quantile_cont(ret_next, 0.01) AS lo, quantile_cont(ret_next, 0.99) AS hi FROM ok GROUP BY sign),
reg AS (SELECT sign AS regime, ok.* EXCLUDE (sign) FROM ok JOIN q USING (sign) WHERE ret_next BETWEEN lo AND hi UNION ALL SELECT 'OVERALL', ok.* EXCLUDE (sign) FROM ok)"""
_RANK = ", ".join(f"rank() OVER (PARTITION BY regime ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY regime, round({c}, 9)) - 1) / 2e0 AS {c}" for c in ("bias", "ret_next", "ret_5", "ret_14", "ret_30"))
_MEANS = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY regime, ticker) AS {c}" for c in ("bias", "ret_next", "ret_5", "ret_14", "ret_30"))
_NAMES = "['bias', 'ret_next', 'ret_5', 'ret_14', 'ret_30']"

_INDICATORS = """
b0 AS (SELECT *, CAST(volume AS DOUBLE) AS v, row_number() OVER w - 1 AS t, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
b1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, (high + low + close) / 3 AS src,
  CASE WHEN t > 0 THEN sum(CASE WHEN t > 0 THEN sign(close - pc) * v ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) END AS v1,
  (SELECT 0) AS z FROM b0),
vel AS (SELECT b.ticker, b.t, coalesce(sum((b.close / p.close - 1) / (b.t - p.t)), 0) / 20 AS vel FROM b0 b LEFT JOIN b0 p ON p.ticker = b.ticker AND p.t BETWEEN b.t - 20 AND b.t - 1 GROUP BY b.ticker, b.t),
b2 AS (SELECT b1.*, vel.vel, avg(high) OVER s34 AS h34, avg(low) OVER s34 AS l34, avg(tr) OVER s10 AS tr10, avg(v1) OVER s20 AS v20, count(v1) OVER s20 AS n20, stddev_pop(high - low) OVER s20 AS ps,
  CASE WHEN t >= 49 THEN v / nullif(avg(v) OVER s50, 0) END AS rel_vol FROM b1 JOIN vel USING (ticker, t)
  WINDOW s10 AS (PARTITION BY ticker ORDER BY t ROWS 9 PRECEDING), s20 AS (PARTITION BY ticker ORDER BY t ROWS 19 PRECEDING), s34 AS (PARTITION BY ticker ORDER BY t ROWS 33 PRECEDING), s50 AS (PARTITION BY ticker ORDER BY t ROWS 49 PRECEDING)),
b3 AS (SELECT *, CASE WHEN n20 = 20 THEN v1 - v20 END AS off FROM b2),
b4 AS (SELECT *, CASE WHEN count(off) OVER s = 20 AND stddev_samp(off) OVER s > 0 THEN off / stddev_samp(off) OVER s * ps END AS sh FROM b3 WINDOW s AS (PARTITION BY ticker ORDER BY t ROWS 19 PRECEDING)),
b5 AS (SELECT *, CASE WHEN sh > 0 THEN high + sh ELSE low + sh END AS ov FROM b4),
r AS (SELECT ticker, t, close AS ema10, src AS e1, src AS e2, CAST(NULL AS DOUBLE) AS sh34, CAST(NULL AS DOUBLE) AS sl34, 0e0 AS atr, close AS mx, close AS mn, vel AS ve, close AS e26, ov AS oe, ov AS d1, ov AS d2 FROM b5 WHERE t = 0
  UNION ALL
  SELECT ticker, t, ema10, e1, 2e0/35 * e1 + (1 - 2e0/35) * pe2, sh34, sl34, atr, mx, mn, ve, e26, oe, d1, CASE WHEN d1 IS NULL THEN NULL WHEN pd2 IS NULL THEN d1 ELSE 2e0/10 * d1 + (1 - 2e0/10) * pd2 END
  FROM (SELECT *, CASE WHEN oe IS NULL THEN NULL WHEN pd1 IS NULL THEN oe ELSE 2e0/10 * oe + (1 - 2e0/10) * pd1 END AS d1
    FROM (SELECT b5.ticker, b5.t, 2e0/11 * close + (1 - 2e0/11) * r.ema10 AS ema10, 2e0/35 * src + (1 - 2e0/35) * r.e1 AS e1, r.e2 AS pe2,
      CASE WHEN b5.t < 33 THEN NULL WHEN b5.t = 33 THEN h34 ELSE (r.sh34 * 33 + high) / 34 END AS sh34, CASE WHEN b5.t < 33 THEN NULL WHEN b5.t = 33 THEN l34 ELSE (r.sl34 * 33 + low) / 34 END AS sl34,
      CASE WHEN b5.t < 9 THEN 0 WHEN b5.t = 9 THEN tr10 ELSE (r.atr * 9 + tr) / 10 END AS atr, greatest(close, r.mx - (r.mx - close) / 2) AS mx, least(close, r.mn + (close - r.mn) / 2) AS mn,
      2e0/11 * vel + (1 - 2e0/11) * r.ve AS ve, 2e0/27 * close + (1 - 2e0/27) * r.e26 AS e26,
      CASE WHEN ov IS NULL THEN NULL WHEN r.oe IS NULL THEN ov ELSE 2e0/11 * ov + (1 - 2e0/11) * r.oe END AS oe, r.d1 AS pd1, r.d2 AS pd2
      FROM r JOIN b5 ON b5.ticker = r.ticker AND b5.t = r.t + 1))),
s0 AS (SELECT ticker, t, close, pc, (high + low) / 2 + 3 * atr AS bu, (high + low) / 2 - 3 * atr AS bl FROM b5 JOIN r USING (ticker, t)),
st AS (SELECT ticker, t, 0e0 AS ub, 0e0 AS lb, 0e0 AS st FROM s0 WHERE t = least(9, (SELECT max(t) FROM s0 x WHERE x.ticker = s0.ticker))
  UNION ALL
  SELECT ticker, t, ub, lb, CASE WHEN pst = pub THEN (CASE WHEN close <= ub THEN ub ELSE lb END) WHEN pst = plb THEN (CASE WHEN close >= lb THEN lb ELSE ub END) ELSE 0 END
  FROM (SELECT s0.ticker, s0.t, s0.close, st.st AS pst, st.ub AS pub, st.lb AS plb, CASE WHEN bu < st.ub OR pc > st.ub THEN bu ELSE st.ub END AS ub, CASE WHEN bl > st.lb OR pc < st.lb THEN bl ELSE st.lb END AS lb
    FROM st JOIN s0 ON s0.ticker = st.ticker AND s0.t = st.t + 1)),
j AS (SELECT b5.*, r.* EXCLUDE (ticker, t), coalesce(st.st, 0) AS st, 2 * e1 - e2 AS zl, 2 * d1 - d2 - e26 AS macd, CASE WHEN mx > mn THEN ln(mx - mn) END AS ld FROM b5 JOIN r USING (ticker, t) LEFT JOIN st USING (ticker, t)),
k AS (SELECT *, CASE WHEN zl > sh34 THEN zl - sh34 WHEN zl < sl34 THEN zl - sl34 ELSE 0 END AS md, abs(macd - lag(macd) OVER w) AS dm, lag(macd) OVER w AS pm FROM j WINDOW w AS (PARTITION BY ticker ORDER BY t)),
l AS (SELECT *, CASE WHEN t >= 8 THEN md - avg(md) OVER s9 END AS histo, CASE WHEN pm IS NOT NULL THEN sum(dm) OVER w / greatest(t, 1) END AS a15,
  CASE WHEN count(ld) OVER s20 = 20 AND stddev_pop(ld) OVER s20 > 0 THEN 50 - 50 * covar_pop(ld, CAST(t AS DOUBLE)) OVER s20 / (stddev_pop(ld) OVER s20 * stddev_pop(CAST(t AS DOUBLE)) OVER s20) END AS psi
  FROM k WINDOW w AS (PARTITION BY ticker ORDER BY t), s9 AS (PARTITION BY ticker ORDER BY t ROWS 8 PRECEDING), s20 AS (PARTITION BY ticker ORDER BY t ROWS 19 PRECEDING)),
ind AS (SELECT ticker, date, round(ema10, 4) + 0e0 AS ema10, round(sh34, 4) + 0e0 AS smma34, round(zl, 4) + 0e0 AS zlema34, round(md, 4) + 0e0 AS impulse_macd, round(histo, 4) + 0e0 AS impulse_histo, round(md - histo, 4) + 0e0 AS impulse_signal, round(atr, 4) + 0e0 AS atr, round(st, 4) + 0e0 AS supertrend,
  CASE WHEN st > 0 AND close < st THEN 'down' WHEN st > 0 THEN 'up' ELSE 'nan' END AS stx, round(psi, 4) + 0e0 AS psi, round(100 * ve, 4) + 0e0 AS smooth_velocity, round(macd, 4) + 0e0 AS macd,
  round(CASE WHEN pm IS NULL THEN NULL WHEN macd > pm + a15 OR macd < pm - a15 THEN macd ELSE pm END, 4) + 0e0 AS b5, round(rel_vol, 4) AS rel_vol FROM l)"""
INDICATORS_SQL = f"WITH RECURSIVE {BARS_SQL}, {_INDICATORS} SELECT * FROM ind"
FULL_SQL = f"""WITH RECURSIVE {NORM_SQL}, {_INDICATORS}
SELECT n.date AS time, n.ticker AS stock_name, round(norm_bias_score, 4) + 0e0 AS bias_index, b.open AS into, b.high AS inth, b.low AS intl, b.close AS intc, b.volume AS v,
  stx AS STX, impulse_histo AS ImpulseHisto, psi, smooth_velocity, macd, b5, rel_vol
FROM norm n JOIN bars b USING (ticker, date) JOIN ind USING (ticker, date)
WHERE impulse_histo IS NOT NULL AND psi IS NOT NULL AND smooth_velocity IS NOT NULL AND macd IS NOT NULL AND b5 IS NOT NULL AND rel_vol IS NOT NULL AND bias_score IS NOT NULL AND smma34 IS NOT NULL"""
_SIMPSON = "(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"

PANEL_SQL = f"""{REGIMES_SQL}, dm AS (SELECT regime, ticker, {_MEANS} FROM reg),
long AS (SELECT regime, ticker, bias AS x, unnest(['ret_next', 'ret_5', 'ret_14', 'ret_30']) AS horizon, unnest([ret_next, ret_5, ret_14, ret_30]) AS y FROM dm),
fit AS (SELECT regime, horizon, regr_slope(y, x) AS beta, regr_intercept(y, x) AS a, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM long GROUP BY 1, 2),
u AS (SELECT regime, horizon, ticker, sum(y - a - beta * x) AS u0, sum((y - a - beta * x) * x) AS u1 FROM long JOIN fit USING (regime, horizon) GROUP BY 1, 2, 3),
m AS (SELECT regime, horizon, count(*) AS g, sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM u GROUP BY 1, 2),
o AS (SELECT regime, horizon, beta, sqrt((g * 1e0 / (g - 1)) * ((n - 1) * 1e0 / (n - 2)) * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11)) / abs(n * sxx - sx * sx) AS se FROM fit JOIN m USING (regime, horizon)),
panel AS (SELECT *, beta / se AS z, 1 - abs(beta / se) / 3000 / sqrt(2 * pi()) * (SELECT sum({_SIMPSON} * exp(-pow(beta / se * i / 2000e0, 2) / 2)) FROM range(2001) r(i)) AS p FROM o)"""

SQL = {
    "bars_daily": f"WITH {BARS_SQL} SELECT ticker, date, open, high, low, close, volume FROM bars",
    "bias_raw": f"WITH {RAW_SQL} SELECT ticker, date, round(bias_score, 6) + 0e0 AS bias_score, n_articles FROM raw",
    "bias_norm": f"WITH {NORM_SQL} SELECT ticker, date, round(bias_score, 6) + 0e0 AS bias_score, round(norm_bias_score, 6) + 0e0 AS norm_bias_score FROM norm",
    "bias_saturation": f"""WITH {NORM_SQL}, two AS (SELECT avg(norm_bias_score) AS mean, stddev_samp(norm_bias_score) AS dev FROM norm),
      f AS (SELECT mean, dev, count(*) AS n, count_if(abs(norm_bias_score - mean) > 2 * dev)::BIGINT AS outliers, count_if(abs(norm_bias_score) >= 0.999999)::BIGINT AS clamped,
      count_if(abs(norm_bias_score) >= 0.9)::BIGINT AS high, coalesce(min(abs(bias_score)) FILTER (abs(norm_bias_score) >= 0.9), 0) AS raw_threshold, quantile_cont(abs(bias_score), 0.99) AS p_ref FROM norm, two GROUP BY mean, dev)
      SELECT round(mean, 6) + 0e0 AS mean, round(dev, 6) AS dev, n, outliers, clamped, high, round(raw_threshold, 6) AS raw_threshold, round(p_ref, 6) AS p_ref, round(100e0 * outliers / n, 6) AS outliers_percent,
      round(100e0 * clamped / n, 6) AS clamped_percent, round(100e0 * high / n, 6) AS high_percent FROM f""",
    "bias_bands": f"""WITH {NORM_SQL}, a AS (SELECT avg(norm_bias_score) AS nm, stddev_samp(norm_bias_score) AS nd, avg(bias_score) AS rm, stddev_samp(bias_score) AS rd FROM norm),
      d AS (SELECT date, avg(norm_bias_score) AS n, avg(bias_score) AS r FROM norm GROUP BY date)
      SELECT date, round(n, 6) + 0e0 AS norm_mean, round(r, 6) + 0e0 AS raw_mean, round(nm - 2 * nd, 6) + 0e0 AS norm_low, round(nm, 6) + 0e0 AS norm_all, round(nm + 2 * nd, 6) + 0e0 AS norm_high,
      round(rm - 2 * rd, 6) + 0e0 AS raw_low, round(rm, 6) + 0e0 AS raw_all, round(rm + 2 * rd, 6) + 0e0 AS raw_high FROM d, a""",
    "bias_scatter": f"""WITH {NORM_SQL} SELECT ticker, date, round(bias_score, 6) + 0e0 AS bias_score, round(norm_bias_score, 6) + 0e0 AS norm_bias_score FROM norm
      ORDER BY md5('{SEED}|' || ticker || '|' || date), ticker, date LIMIT {SAMPLE_ROWS}""",
    "ticker_sample": f"""WITH {RAW_SQL}, c AS (SELECT DISTINCT ticker FROM bars ORDER BY md5('{SEED}|' || ticker), ticker LIMIT {SAMPLE_TICKERS})
      SELECT ticker, date, round(bias_score, 6) + 0e0 AS bias_score, n_articles FROM raw JOIN c USING (ticker) ORDER BY date, ticker LIMIT 50""",
    "tickers": "SELECT DISTINCT l_suppkey AS ticker FROM lineitem",
    "study_input": f"""WITH {NORM_SQL}, top AS (SELECT s_suppkey AS ticker FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY count(l_suppkey) DESC, 1 LIMIT 10)
      SELECT ticker, date, close, round(norm_bias_score, 6) + 0e0 AS norm_bias_score FROM norm WHERE ticker IN (FROM top) AND close IS NOT NULL AND norm_bias_score IS NOT NULL""",
    "market_daily_mean": f"WITH {NORM_SQL} SELECT date, round(avg(bias_score), 6) + 0e0 AS raw_mean, round(avg(norm_bias_score), 6) + 0e0 AS norm_mean FROM norm GROUP BY date",
    "silent_monthly": f"WITH {SILENT_SQL} SELECT strftime(date, '%Y-%m') AS month, count_if(silent_anomaly)::BIGINT AS silent, count(*) AS n FROM silent GROUP BY 1",
    "returns": f"""WITH {BARS_SQL}, x AS (SELECT *, close / nullif(lag(close) OVER w, 0) AS q FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
      y AS (SELECT *, q - 1 AS ret FROM x)
      SELECT ticker, date, round(CASE WHEN q > 0 THEN ln(q) END, 6) + 0e0 AS log_ret, round(ret, 6) + 0e0 AS ret, round(CASE WHEN count(*) OVER v = 50 THEN volume / nullif(avg(volume) OVER v, 0) END, 6) AS rel_vol,
      round(lead(ret) OVER w, 6) + 0e0 AS ret_next, round(CASE WHEN count(ret) OVER a = 5 THEN sum(ret) OVER a END, 6) + 0e0 AS ret_5, round(CASE WHEN count(ret) OVER b = 14 THEN sum(ret) OVER b END, 6) + 0e0 AS ret_14,
      round(CASE WHEN count(ret) OVER c = 30 THEN sum(ret) OVER c END, 6) + 0e0 AS ret_30 FROM y
      WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING), a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),
      b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), c AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)""",
    "copy_projection": f"""WITH {RAW_SQL} SELECT ticker, date, close, volume, round(bias_score, 6) + 0e0 AS bias_score FROM raw WHERE ticker % 2 = 0
      UNION ALL SELECT ticker, date, close, volume, NULL FROM bars WHERE ticker % 2 <> 0""",
    "indicators": INDICATORS_SQL,
    "linear_indicators": INDICATORS_SQL.replace("SELECT * FROM ind", "SELECT ticker, date, ema10, smma34, zlema34, atr, smooth_velocity FROM ind"),
    "features_full": FULL_SQL,
    "silent_shocks": f"""WITH {SILENT_SQL} SELECT date AS time, ticker AS stock_name, round(norm_bias_score, 6) + 0e0 AS bias_index, close AS intc, volume AS v, round(rel_vol, 6) AS rel_vol,
      round(z_score_price, 6) + 0e0 AS z_score_price, is_volume_shock, silent_anomaly FROM silent ORDER BY abs(round(z_score_price, 6)) DESC NULLS LAST, ticker, date""",
    "silent_report": f"""WITH {SILENT_SQL}, o AS (SELECT count(*) AS n, count_if(silent_anomaly)::BIGINT AS s FROM silent)
      SELECT CAST(unnest(range(6)) AS INTEGER) AS line_no, unnest(['=== SILENT SHOCK ANALYSIS ===', 'Total Data Points Analyzed: ' || n, 'Total Silent Shocks Detected: ' || s,
      printf('Global Rate: %.2f%%', CASE WHEN n > 0 THEN 100e0 * s / n ELSE 0 END), '-----------------------------',
      'Definition: Days where Price moved > 2 Sigma but Media Sentiment remained Neutral (< 0.5 Sigma).']) AS line FROM o""",
    "files_by_ticker": f"WITH {SILENT_SQL} SELECT ticker, date, silent_anomaly, round(rel_vol, 6) AS rel_vol FROM silent",
    "trend_follower": f"WITH {FOLLOW_SQL} SELECT ticker, round(slope, 6) + 0e0 AS slope, n, CASE WHEN slope > 0 THEN 'Trend Follower' ELSE 'Contrarian' END AS behavior FROM follow WHERE slope IS NOT NULL",
    "follower_share": f"WITH {FOLLOW_SQL} SELECT count(*) AS n, round(100 * avg(CASE WHEN slope > 0 THEN 1 ELSE 0 END), 4) AS followers FROM follow WHERE slope IS NOT NULL",
    "event_study": f"""WITH {PATHS_SQL}, s AS (SELECT sign, count(*) AS n, avg(path[16]) AS mean, avg(path[16]) / (stddev_samp(path[16]) / sqrt(count(*))) AS t FROM paths GROUP BY sign),
      q AS (SELECT *, 0.5 - exp(lgamma(n / 2e0) - lgamma((n - 1) / 2e0)) / sqrt((n - 1) * pi()) * t / 6000
        * (SELECT sum({_SIMPSON} * pow(1 + pow(t * i / 2000e0, 2) / (n - 1), -n / 2e0)) FROM range(2001) r(i)) AS p FROM s WHERE (SELECT count(*) FROM s) = 2)
      SELECT CASE sign WHEN 'positive' THEN '{stats.SHOCKS["positive"]}' ELSE '{stats.SHOCKS["negative"]}' END AS metric, n, round(mean, 6) + 0e0 AS mean, round(t, 6) + 0e0 AS t, round(p, 6) AS p,
      CASE WHEN p < 0.05 THEN 'Significant' ELSE 'Noise' END AS verdict FROM q""",
    "event_trajectories": f"""WITH {PATHS_SQL}, e AS (SELECT sign, unnest(path) AS x, unnest(range(16)) AS i FROM paths),
      m AS (SELECT sign, i, avg(x) AS mean, stddev_pop(x) / sqrt(count(*)) AS sem FROM e GROUP BY sign, i)
      SELECT sign, CAST(i - 5 AS INTEGER) AS day, round(mean, 6) + 0e0 AS mean, round(sem, 6) + 0e0 AS sem, round(mean - 1.96 * sem, 6) + 0e0 AS low, round(mean + 1.96 * sem, 6) + 0e0 AS high FROM m""",
    "spearman_matrix": f"""WITH {REGIMES_SQL}, ranks AS (SELECT regime, {_RANK} FROM reg),
      long AS (SELECT regime, unnest({_NAMES}) AS a, unnest([bias, ret_next, ret_5, ret_14, ret_30]) AS x, [bias, ret_next, ret_5, ret_14, ret_30] AS ys FROM ranks),
      pairs AS (SELECT regime, a, x, unnest({_NAMES}) AS b, unnest(ys) AS y FROM long)
      SELECT regime, a, b, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) + 0e0 AS rho FROM pairs GROUP BY 1, 2, 3""",
    "panel_regression": f"""WITH {PANEL_SQL} SELECT regime, horizon, round(beta, 6) + 0e0 AS beta, round(se, 6) AS se, round(z, 6) + 0e0 AS z, round(p, 6) AS p, CASE WHEN p < 0.05 THEN 'Significant' ELSE 'Insignificant' END AS label,
      round(beta - 1.96 * se, 6) + 0e0 AS low, round(beta + 1.96 * se, 6) + 0e0 AS high FROM panel""",
    "regression_report": f"""WITH {PANEL_SQL} SELECT CAST(4 + 4 * (CASE regime WHEN 'OVERALL' THEN 0 WHEN 'POSITIVE' THEN 1 ELSE 2 END) + (CASE horizon WHEN 'ret_next' THEN 0 WHEN 'ret_5' THEN 1 WHEN 'ret_14' THEN 2 ELSE 3 END) AS INTEGER) AS line_no,
      '| ' || (CASE regime WHEN 'OVERALL' THEN 'OVERALL' WHEN 'POSITIVE' THEN 'POSITIVE (>0)' ELSE 'NEGATIVE (<0)' END) || ' | ' || (CASE horizon WHEN 'ret_next' THEN '1-Day' WHEN 'ret_5' THEN '5-Day' WHEN 'ret_14' THEN '14-Day' ELSE '30-Day' END)
      || printf(' | %.4f | %.4f | ', beta, p) || (CASE WHEN p < 0.05 THEN 'Significant' ELSE 'Insignificant' END) || ' |' AS line FROM panel
      UNION ALL SELECT CAST(unnest(range(4)) AS INTEGER), unnest(['REGRESSION RESULTS', '', '| Regime | Forecast Horizon | Beta | P-Value | Significance |', '| :--- | :--- | :--- | :--- | :--- |'])""",
}
QUERIES = {
    "bars_daily": bars_daily, "bias_raw": bias_raw, "bias_norm": bias_norm, "bias_saturation": bias_saturation, "bias_bands": bias_bands, "bias_scatter": bias_scatter, "ticker_sample": ticker_sample, "tickers": tickers,
    "study_input": study_input, "market_daily_mean": market_daily_mean, "silent_monthly": bias_by_month, "returns": returns, "copy_projection": copy_projection, "indicators": indicators_all, "linear_indicators": linear_indicators, "features_full": features_full,
    "silent_shocks": silent_shocks, "silent_report": silent_report, "files_by_ticker": files_by_ticker, "trend_follower": trend_follower, "follower_share": follower_share, "event_study": event_study,
    "event_trajectories": event_trajectories, "spearman_matrix": spearman_matrix, "panel_regression": panel_regression, "regression_report": regression_report,
}
