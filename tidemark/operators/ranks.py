"""Exact positions and percentiles of values, by sums over ranges or bins of values: no task holds all of them."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written


def positions(counts: DataFrame, by: list[str], counted: tuple[str, ...] = ("n",)) -> DataFrame:
    """by, value, counted, before: how many rows of the group have a smaller value. counts: by, value, counted; a row for each value of a group.

    counted: several counts are placed at once; then there is a column before_<count> for each.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.select(*by, "value", *counted).repartitionByRange(parts, *by, "value")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "part").agg(*[F.sum(n).alias(n) for n in counted])
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*by, "part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"start_{n}") for n in counted])
    # only a group's ranges after its first: as ranges follow each other in order of the group, there are fewer than ranges
    start = start.where(" or ".join(f"`start_{n}` > 0" for n in counted))
    within = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(n).over(within), F.lit(0)).alias(f"within_{n}") for n in counted])
    same = (placed["part"] == start["part"]) & reduce(and_, [placed[c].eqNullSafe(start[c]) for c in by])
    found = placed.join(F.broadcast(start), same, "left").select(*[placed[c] for c in placed.columns], *[F.coalesce(f"start_{n}", F.lit(0)).alias(f"start_{n}") for n in counted])
    names = ["before"] if len(counted) == 1 else [f"before_{n}" for n in counted]
    return found.select(*by, "value", *counted, *[(F.col(f"start_{n}") + F.col(f"within_{n}")).alias(name) for n, name in zip(counted, names, strict=True)])


#: Bins by which values are counted at once.
BINS = 1 << 12


def percentiles(counts: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """by and a column for each wanted percentile, interpolated as by F.percentile; null values don't count. counts: by, value, n; values may repeat.

    Values are counted in bins of equal width from the least to the greatest, then those of the bin where a wanted one stands, until
    a bin has one value; its ends have bins of their own, so it always gets narrower. So hardly anything is shuffled, but counts is
    read some four times, and must be the same each time. There are few groups: their bounds are in the driver.
    """
    rows = counts.where("value is not null").select(*by, (F.col("value") + F.lit(0.0)).alias("value"), "n")  # no negative zero
    finite = F.when(F.abs("value") < math.inf, F.col("value"))
    groups = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")).collect()
    places = {(g, name): (r["n"] - 1) * float(p) for g, r in enumerate(groups) for name, p in wanted.items()}
    # group, number of the wanted row: its number within a cell, the cell's bounds
    ahead = {(g, x): (x, groups[g]["low"], groups[g]["high"]) for (g, _), at in places.items() for x in (math.floor(at), math.ceil(at))}
    found, first = {}, True
    while ahead:
        cells = list(dict.fromkeys((g, low, high) for (g, _), (_, low, high) in ahead.items()))
        here = [reduce(and_, [F.col(c).eqNullSafe(F.lit(groups[g][c])) for c in by]) for g, _, _ in cells]
        if not first:
            here = [x & F.col("value").between(low, high) for x, (_, low, high) in zip(here, cells, strict=True)]
        inside = lambda values: F.coalesce(*[F.when(x, value) for x, value in zip(here, values, strict=True)])
        bins = rows.select(inside([F.lit(i) for i in range(len(cells))]).alias("cell"), inside([_bin(low, high) for _, low, high in cells]).alias("bin"), "value", "n").where("cell is not null")
        bins = bins.groupBy("cell", "bin").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))  # BINS + 5 rows at most for each cell
        before = F.sum("n").over(Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("one", F.col("low") == F.col("high"))
        holds = lambda cell, x: (F.col("cell") == cell) & (F.col("before") <= x) & (F.lit(x) < F.col("before") + F.col("n"))
        hits = bins.where(reduce(or_, [holds(cells.index((g, low, high)), x) for (g, _), (x, low, high) in ahead.items()])).collect()
        rest = {}
        for (g, at), (x, low, high) in ahead.items():
            hit = next(r for r in hits if cells[r["cell"]] == (g, low, high) and r["before"] <= x < r["before"] + r["n"])
            if hit["one"]:
                found[g, at] = hit["low"]
            else:
                rest[g, at] = (x - hit["before"], hit["low"], hit["high"])
        ahead, first = rest, False
    out = []
    for g, r in enumerate(groups):
        row = [r[c] for c in by]
        for name in wanted:
            at = places[g, name]
            low, high = found[g, math.floor(at)], found[g, math.ceil(at)]
            row.append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
        out.append(tuple(row))
    types = dict(rows.dtypes)
    return counts.sparkSession.createDataFrame(out, ", ".join([*(f"`{c}` {types[c]}" for c in by), *(f"`{c}` double" for c in wanted)]))


def _bin(low: float | None, high: float | None) -> Column:
    """The bin of value between finite bounds, in order of values; the bounds and what isn't finite have their own."""
    value, low, high = F.col("value"), F.lit(low).cast("double"), F.lit(high).cast("double")
    share = F.try_divide(value / 2 - low / 2, high / 2 - low / 2)  # halves don't overflow
    special = F.when(value == -math.inf, -2).when(F.isnan(value), BINS + 3).when(value == math.inf, BINS + 2).when(value <= low, -1).when(value >= high, BINS + 1)
    return special.otherwise(F.coalesce(F.floor(share * BINS), F.lit(0)))


#: Hex digits by which rows are counted at once, and rows that one task may sort.
DIGITS, SORTED = 4, 10_000


def least(rows: DataFrame, key: str, ties: list[str], k: int) -> DataFrame:
    """The k rows of least key, a column of hex digits such as a hash gives, then of least ties; all rows if there are fewer.

    Rows are counted by the first digits of their key, then those of the digits where the k-th row stands by the next ones,
    until so few are left there that they can be sorted. All rows before them are taken as they are, wherever they stand.
    """
    rows = rows.where(F.col(key).isNotNull())
    prefix, rest = "", k
    while True:
        at = len(prefix) + 1
        here = rows.where(F.col(key).startswith(prefix)) if prefix else rows
        counts = here.groupBy(F.substring(key, at, DIGITS).alias("digits")).agg(F.count("*").alias("n"))  # 16 ** DIGITS rows at most
        before = F.sum("n").over(Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1))
        place = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < rest).orderBy(F.desc("digits")).first()
        if place is None:
            return rows.limit(0)
        prefix, rest = prefix + place["digits"], rest - place["before"]
        if place["n"] <= max(rest, SORTED) or len(place["digits"]) < DIGITS:
            break
    edge = rows.where(F.col(key).startswith(prefix))
    edge = edge if place["n"] <= rest else edge.orderBy(key, *ties).limit(rest)
    return rows.where(F.col(key) < prefix).unionByName(edge)
