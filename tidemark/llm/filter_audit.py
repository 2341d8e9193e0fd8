"""Audit of filters that interact: what each of them removes in every order, and its Shapley share of all removals.

1. Every document becomes a mask, the set of the filters that it fails, and masks are counted by part: a few counts
   whatever the number of documents. All that follows is made of these.
2. A coalition (a set of filters) removes the documents whose mask meets it. The removals of all coalitions are
   tabulated; a step of an order is a difference of two of them: what its filter and those before it remove, less what
   those before it remove.
3. Shapley values are the solution of a least squares problem over the coalitions, weighted by the Shapley kernel, under
   the constraint that they add up to what all filters remove. Its normal equations don't depend on the counts: they are
   solved in fractions once, and give integer weights of the coalitions for the sum over all orders, so it is exact.

A text that stands at a smaller doc_id, anywhere in the table, is told by its SHA-256. Rows are counted by text and part
before any of them meet, so a text that stands in a third of the table is a few rows for each part.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read

#: The filters, in the order of the mask's bits.
FILTERS = "ABCDE"
SHORT_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
MARKS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
TALLIES = ("n", "good", "toxic")


def solved(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan on an augmented matrix: the columns right of the square part, solved."""
    n = len(rows)
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """For each of n filters the integer weight of every coalition's removals, of which the sum over all n! orders is made.

    Minimises the sum over coalitions S, but for the empty and the full one, of k(S) * (v(S) - sum of the shares in S)^2
    where all shares add up to v(all); k is the Shapley kernel. With a multiplier for the constraint the normal equations
    are linear in v, so each coalition is a right-hand side of its own.
    """
    full = (1 << n) - 1
    kernel = [Fraction(n - 1, comb(n, s) * s * (n - s)) if 0 < s < n else Fraction(0) for s in range(n + 1)]
    inside = lambda i, s: s >> i & 1
    weight = lambda s: kernel[s.bit_count()]
    rows = [[sum((weight(s) for s in range(full + 1) if inside(i, s) and inside(k, s)), Fraction(0)) for k in range(n)] + [Fraction(1)] + [weight(s) * inside(i, s) for s in range(full + 1)] for i in range(n)]
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(s == full) for s in range(full + 1)])
    shares = [[factorial(n) * x for x in row] for row in solved(rows)[:n]]
    if any(x.denominator != 1 for row in shares for x in row):
        raise ArithmeticError("weights of coalitions aren't whole")
    return [[int(x) for x in row] for row in shares]


def steps(filters: str) -> list[dict]:
    """Every step of every order: filter_order, step, its filter's bit, and the coalitions before and after it."""
    found = []
    for order in permutations(filters):
        before = 0
        for i, name in enumerate(order):
            bit = filters.index(name)
            found.append({"filter_order": "".join(order), "step": i + 1, "bit": bit, "before": before, "after": before | 1 << bit})
            before |= 1 << bit
    return found


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of each step, of masks (part, mask, n, good, toxic): counts by part and set of failed filters.

    filters: a letter for each bit of the mask. A row for every part, order and step; no masks give no rows. Rows of one
    part and mask may repeat and add up; nulls in counts are 0.
    """
    full = (1 << len(filters)) - 1
    removed = lambda c, s: F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c))), F.lit(0)).cast("long")
    table = masks.groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[F.array(*[removed(c, s) for s in range(full + 1)]).alias(c) for c in TALLIES])
    of_all = F.lit(json.dumps(steps(filters)))
    table = table.select("*", F.explode(F.from_json(of_all, "array<struct<filter_order: string, step: int, bit: int, before: int, after: int>>")).alias("s"))
    v = lambda c, s: F.col(c)[s]
    lost = lambda c: v(c, F.col("s.after")) - v(c, F.col("s.before"))
    own = F.array(*[F.lit(1 << i) for i in range(len(filters))])[F.col("s.bit")]
    share = F.array(*[sum((F.lit(w) * v("n", s) for s, w in enumerate(row) if w), F.lit(0).cast("long")) for row in shapley_weights(len(filters))])
    return table.select(
        "part", "s.filter_order", "s.step", (F.col("total") - v("n", F.col("s.after"))).alias("kept"), lost("n").alias("removed"), (v("n", own) - lost("n")).alias("redundant"),
        (v("n", F.lit(full)) - v("n", F.lit(full) - own)).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), share[F.col("s.bit")].alias("shapley"),
    )


def text_mask(text: Column) -> Column:
    """The bits of the first four filters."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [n < SHORT_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(MARKS)]
    return sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails)), F.lit(0))


def masks_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents (doc_id, text, source) counted by source (null: empty) and the filters that they fail, and those of them that some label (doc_id, quality, toxic) calls good or toxic.

    A null text is empty. Rows that repeat a doc_id count each, with the labels of that id; those with its text too don't
    fail for each other. A row without doc_id has no label, and neither fails for another's text nor makes another fail.
    Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in TALLIES[1:]])
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("n_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id")
    )
    # a text has a row for each part and pair of labels here
    first = F.min("least").over(Window.partitionBy("digest"))
    own = F.col("without_id") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    copy = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - own).alias("n"))))
    counted = texts.withColumn("first", first).select("part", "good", "toxic", both.alias("x")).select("part", "x.*", *[(F.col(c) * F.col("x.n")).alias(c) for c in TALLIES[1:]])
    return counted.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in TALLIES])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (
  SELECT part, doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
g AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d LEFT JOIN g USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
x AS (
  SELECT o, f.i AS step, o[f.i] AS own, o[1:f.i - 1] AS earlier FROM o, f),
y AS (
  SELECT part, o, step, own, n, good, toxic, fails[own] AS fails_own, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone,
    len(list_filter(fails, lambda v: v)) = 1 AS once FROM x, m),
z AS (
  SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_own), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails_own), 0) AS redundant, coalesce(sum(n) FILTER (once AND fails_own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails_own), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_own), 0) AS toxic_lost
  FROM y GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z"""
