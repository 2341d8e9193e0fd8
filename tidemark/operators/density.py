"""Density of a column by a Gaussian kernel: values are counted in bins first, so that what is summed for a point doesn't grow with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins between the least and the largest value, and points at which the density is told.
BINS, POINTS = 1024, 200


def density(rows: DataFrame, column: str, points: int = POINTS, bins: int = BINS) -> DataFrame:
    """point, x, density at equal steps from the least to the largest value; nulls don't count.

    The bandwidth is Scott's: the deviation times n ** -0.2. A value between two bins counts for both, for the nearer one
    more, in proportion; with bins d apart and a bandwidth h that changes the density by less than (d / h) ** 2 / 8 of
    the kernel's largest value, 0.4 / h. No rows where there are fewer than two different values.
    """
    x = F.col(column).cast("double")
    values = rows.select(x.alias("x")).where(x.isNotNull())
    scale = values.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"), (F.stddev_samp("x") * F.pow(F.count("*"), F.lit(-0.2))).alias("h")).where("high > low")
    placed = values.crossJoin(F.broadcast(scale)).withColumn("at", (F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins)  # one row
    bin_ = F.least(F.floor("at"), F.lit(bins - 1))
    near = F.explode(F.array(F.struct(bin_.alias("bin"), (1 - (F.col("at") - bin_)).alias("w")), F.struct((bin_ + 1).alias("bin"), (F.col("at") - bin_).alias("w")))).alias("b")
    weights = placed.select("low", "high", "n", "h", near).groupBy("b.bin", "low", "high", "n", "h").agg(F.sum("b.w").alias("w"))
    step = lambda i, n: F.col("low") + (F.col("high") - F.col("low")) * F.col(i) / n
    met = weights.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))  # bins + 1 rows
    z = (step("point", points - 1) - step("bin", bins)) / F.col("h")
    return met.groupBy("point", step("point", points - 1).alias("x")).agg(F.sum(F.col("w") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"))
