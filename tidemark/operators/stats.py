"""Anomalies and their statistics over bars with a normalised bias index."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import windows as W
from tidemark.operators import indicators, ranks
from tidemark.operators.rank_products import rank_products
from tidemark.sources.shared import stable, written

HORIZONS = {"ret_next": 1, "ret_5": 5, "ret_14": 14, "ret_30": 30}
#: Names of what is reported.
SHOCKS = {"positive": "Positive Price Shock (>2%)", "negative": "Negative Price Shock (<-2%)"}
REGIMES = {"OVERALL": "OVERALL", "POSITIVE": "POSITIVE (>0)", "NEGATIVE": "NEGATIVE (<0)"}
HORIZON_NAMES = {"ret_next": "1-Day", "ret_5": "5-Day", "ret_14": "14-Day", "ret_30": "30-Day"}


def features(index: DataFrame) -> DataFrame:
    """Bars with their index and all indicators, without the rows where any of them isn't there yet."""
    return indicators.with_indicators(index).dropna()


def silent_shocks(rows: DataFrame, z: float = 3.0, volume: float = 3.0, quiet: float = 0.1, least_rows: int = 10) -> DataFrame:
    """rows (ticker, date, close, rel_vol, norm_bias_score) with the moves in price or volume that no news goes with. Securities with fewer than least_rows rows go."""
    rows = rows.withColumns({"log_ret": W.log_return(), "n": F.count("*").over(W.whole())}).where(F.col("n") >= least_rows)
    mean, dev = F.avg("log_ret").over(W.whole()), F.stddev_samp("log_ret").over(W.whole())
    rows = rows.withColumn("z_score_price", F.when(dev == 0, 0.0).otherwise(F.try_divide(F.col("log_ret") - mean, dev)))
    rows = rows.withColumn("is_volume_shock", F.coalesce(F.col("rel_vol") > volume, F.lit(False)))
    loud = F.coalesce(F.abs("z_score_price") > z, F.lit(False)) | F.col("is_volume_shock")
    return rows.withColumn("silent_anomaly", loud & F.coalesce(F.abs("norm_bias_score") < quiet, F.lit(False)))


def trend_followers(rows: DataFrame, first: int = 14, last: int = 41, least_rows: int = 50) -> DataFrame:
    """Whether news of a security follows its price: the slope of the later mean bias over the return."""
    rows = rows.select("ticker", W.log_return().alias("x"), W.full(F.avg, "norm_bias_score", first, last).alias("y")).dropna()
    found = rows.groupBy("ticker").agg(F.regr_slope("y", "x").alias("slope"), F.count("*").alias("n")).where((F.col("n") >= least_rows) & F.col("slope").isNotNull())
    return found.withColumn("behavior", F.when(F.col("slope") > 0, "Trend Follower").otherwise("Contrarian"))


def trajectories(rows: DataFrame, shock: float = 0.02, before: int = 5, after: int = 10) -> DataFrame:
    """sign, ticker, date, path (of before + after + 1 biases, less that of the day) of each shock that has all these rows."""
    frame = W.by_date().rowsBetween(-before, after)
    rows = rows.withColumns({"log_ret": W.log_return(), "around": F.collect_list("norm_bias_score").over(frame), "t": F.row_number().over(W.by_date()) - 1})
    rows = rows.where((F.size("around") == before + after + 1) & (F.col("t") >= before))
    sign = F.when(F.col("log_ret") > shock, "positive").when(F.col("log_ret") < -shock, "negative")
    path = F.transform("around", lambda x: x - F.col("norm_bias_score"))
    return rows.select(sign.alias("sign"), "ticker", "date", path.alias("path")).where("sign is not null")


def event_study(paths: DataFrame) -> DataFrame:
    """sign, n, mean, t, p, verdict of the change at the end of the paths: whether it is above zero. Nothing if one of the signs lacks."""
    end = F.element_at("path", -1)
    found = paths.groupBy("sign").agg(F.count("*").alias("n"), F.avg(end).alias("mean"), F.stddev_samp(end).alias("dev"))
    found = found.select("sign", "n", "mean", F.try_divide(F.col("mean"), F.col("dev") / F.sqrt("n")).alias("t"))
    both = found.agg(F.count("*").alias("signs")).where("signs = 2")
    found = with_p(found.crossJoin(F.broadcast(both)).drop("signs"), lambda r: t_tail(r["t"], r["n"] - 1))  # two rows
    return found.withColumn("verdict", X.significance(F.col("p"), "Noise"))


def mean_path(paths: DataFrame, before: int = 5) -> DataFrame:
    """sign, day, mean and standard error (of the population) over all paths."""
    each = paths.select("sign", F.posexplode("path").alias("day", "x"))
    return each.groupBy("sign", (F.col("day") - before).alias("day")).agg(F.avg("x").alias("mean"), (F.stddev_pop("x") / F.sqrt(F.count("*"))).alias("sem"))


def t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's distribution, by the continued fraction of the incomplete beta function."""

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + n * d), 1 + n / c
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    x, a, b = df / (df + t * t), df / 2, 0.5
    # log(1 + ...) and lgamma differences keep digits where df is large
    log_x, log_rest = -math.log1p(t * t / df), math.log(t * t / (df + t * t)) if t else -math.inf
    front = math.exp(a * log_x + b * log_rest + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if t else 0.0
    inside = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return inside / 2 if t > 0 else 1 - inside / 2


def normal_tails(z: float) -> float:
    """P(|N| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def with_p(results: DataFrame, p_of: Callable[[pd.Series], float]) -> DataFrame:
    """A few rows of results with p; null where it can't be told."""

    def run(batches):
        for batch in batches:
            p = [None if r.isna().any() else p_of(r) for _, r in batch.iterrows()]
            yield batch.assign(p=pd.array(p, dtype="Float64"))

    return results.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in results.dtypes), "p double"]))


def study_rows(index: DataFrame, companies: DataFrame, top: int | None = None) -> DataFrame:
    """ticker, date, close, norm_bias_score, where both are there, of known companies; top: of those with the most articles."""
    wanted = companies.select(F.col("symbol").alias("ticker"), "current_page")
    if top is not None:
        wanted = wanted.orderBy(F.desc("current_page"), "ticker").limit(top)
    rows = index.select("ticker", "date", "close", "norm_bias_score").where("close is not null and norm_bias_score is not null")
    return rows.join(wanted.select("ticker"), "ticker", "left_semi")


def ahead(rows: DataFrame) -> DataFrame:
    """ticker, bias, returns to come, sign of the bias. Zero biases don't count."""
    rows = rows.withColumn("ret", W.pct_change())
    to_come = {k: F.lead("ret", 1).over(W.by_date()) if n == 1 else W.full(F.sum, "ret", 1, n) for k, n in HORIZONS.items()}
    rows = rows.select("ticker", F.col("norm_bias_score").alias("bias"), *[c.alias(k) for k, c in to_come.items()]).dropna()
    return rows.where(F.abs("bias") > 0.001).withColumn("sign", F.when(F.col("bias") > 0, "POSITIVE").otherwise("NEGATIVE"))


def tails(rows: DataFrame) -> DataFrame:
    """sign, low, high: the bounds of the tails of ret_next, of rows as ahead() gives them."""
    counts = stable(rows, "returns").select("sign", F.col("ret_next").alias("value"), F.lit(1).alias("n"))
    return ranks.percentiles(counts, ["sign"], {"low": 0.01, "high": 0.99})


def signed(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """ticker, bias, returns to come, and regime: the sign of the bias, null for the tails (bounds) of ret_next of either sign."""
    inside = F.when(F.col("ret_next").between(F.col("low"), F.col("high")), F.col("sign"))
    return rows.join(F.broadcast(bounds), "sign").withColumn("regime", inside).drop("sign", "low", "high")  # two rows


def regimes(rows: DataFrame) -> DataFrame:
    """signed rows once for their regime, and once for OVERALL, which has all."""
    return rows.where("regime is not null").unionByName(rows.withColumn("regime", F.lit("OVERALL")))


def spearman(rows: DataFrame) -> DataFrame:
    """regime, a, b, rho of signed rows: rank correlations of bias and all returns with each other; ties have their mean rank.

    Values are rounded, as sums of doubles may differ in the last bits when made again, so that ties stay ties.
    """
    names, regime = ["bias", *HORIZONS], ["OVERALL", "POSITIVE", "NEGATIVE"]
    kind = F.when(F.col("regime") == "POSITIVE", 1).when(F.col("regime") == "NEGATIVE", 2).otherwise(0)
    found = rank_products(rows.select(kind.alias("kind"), *[F.round(c, 9).alias(c) for c in names]), names)
    size = lambda i: F.sqrt(f"{i}_{i}")
    rho = lambda i, j: F.try_divide(F.col(f"{min(i, j)}_{max(i, j)}"), size(i) * size(j))
    cells = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), rho(i, j).alias("rho")) for i in range(len(names)) for j in range(len(names))]
    return found.select(F.element_at(F.array(*map(F.lit, regime)), F.col("kind") + 1).alias("regime"), F.explode(F.array(*cells)).alias("x")).select("regime", "x.*")


def panel(rows: DataFrame) -> DataFrame:
    """regime, horizon, beta, se, z, p: fixed-effects regression of returns on bias, errors clustered by security.

    Taking each security's means off leaves sums of squares and products about these means, which one aggregation by
    security gives; the rest is made of these sums. The intercept is zero, and so are a security's summed errors.
    """
    n = F.count("*")
    moments = rows.groupBy("regime", "ticker").agg(n.alias("n"), (F.var_pop("bias") * n).alias("sxx"), *[(F.covar_pop("bias", k) * n).alias(k) for k in HORIZONS])
    long = written(moments.unpivot(["regime", "ticker", "n", "sxx"], list(HORIZONS), "horizon", "sxy"), "moments")
    fit = long.groupBy("regime", "horizon").agg(F.try_divide(F.sum("sxy"), F.sum("sxx")).alias("beta"), F.sum("n").alias("n"), F.sum("sxx").alias("s"), F.count("*").alias("g"))
    score = F.col("sxy") - F.col("beta") * F.col("sxx")
    meat = long.select("regime", "horizon", "sxy", "sxx").join(F.broadcast(fit), ["regime", "horizon"]).groupBy("regime", "horizon", "beta", "n", "s", "g").agg(F.sum(score * score).alias("m"))  # twelve rows
    small = F.try_divide(F.col("g") * (F.col("n") - 1), (F.col("g") - 1) * (F.col("n") - 2))
    se = F.try_divide(F.sqrt(small * F.col("m")), F.col("s"))
    found = meat.select("regime", "horizon", "beta", se.alias("se"), F.try_divide("beta", se).alias("z"))
    return with_p(found, lambda r: normal_tails(r["z"]))


def silent_report(shocks: DataFrame) -> DataFrame:
    """line_no, line: the report on silent shocks."""
    n = F.count_if("silent_anomaly")
    one = shocks.agg(F.count("*").alias("n"), n.alias("silent"), F.coalesce(F.try_divide(100 * n, F.count("*")), F.lit(0.0)).alias("rate"))
    # fixed values
    lines = F.array(
        F.lit("=== SILENT SHOCK ANALYSIS ==="),
        F.format_string("Total Data Points Analyzed: %d", "n"),
        F.format_string("Total Silent Shocks Detected: %d", "silent"),
        F.format_string("Global Rate: %.2f%%", "rate"),
        F.lit("-----------------------------"),
        F.lit("Definition: Days where Price moved > 2 Sigma but Media Sentiment remained Neutral (< 0.5 Sigma)."),
    )
    return one.select(F.posexplode(lines).alias("line_no", "line"))


def labelled(column: str, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(column))


def place(column: str, names: dict[str, str]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int") - 1


def regression_report(fits: DataFrame) -> DataFrame:
    """line_no, line: the table of regressions."""
    line = F.format_string("| %s | %s | %.4f | %.4f | %s |", labelled("regime", REGIMES), labelled("horizon", HORIZON_NAMES), "beta", "p", X.significance(F.col("p"), "Insignificant"))
    return fits.select((4 + place("regime", REGIMES) * len(HORIZONS) + place("horizon", HORIZON_NAMES)).alias("line_no"), line.alias("line")).unionByName(
        # fixed values
        fits.sparkSession.createDataFrame(list(enumerate(["REGRESSION RESULTS", "", "| Regime | Forecast Horizon | Beta | P-Value | Significance |", "| :--- | :--- | :--- | :--- | :--- |"])), "line_no int, line string")
    )
