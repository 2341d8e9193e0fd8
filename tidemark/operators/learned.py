"""Sentiment learned from what the market did: documents take the sign of the return that came after them as their label."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import windows as W
from tidemark.sources.shared import written

#: Classes: no move, up, down.
FLAT, UP, DOWN = 0.0, 1.0, 2.0
TERMS, FOLDS, SAMPLE_ROWS, ROUNDS, PENALTY = 1 << 16, 3, 100_000, 30, 0.01
#: Places of a sample by a hash.
PLACES = 1 << 40


def next_returns(bars: DataFrame) -> DataFrame:
    """ticker, nth (the bar's place, from 0), ahead (return of the next bar) of bars (ticker, date, close); the last bar has none."""
    rows = bars.select("ticker", (F.row_number().over(W.by_date()) - 1).alias("nth"), F.try_divide(F.lead("close").over(W.by_date()), F.col("close")).alias("ratio"))
    return rows.select("ticker", "nth", (F.col("ratio") - 1).alias("ahead")).where("ahead is not null")


def labels_of(mentions: DataFrame, returns: DataFrame) -> DataFrame:
    """id, label: the class of the mean return after the bars (ticker, nth) that mentions (id, ticker, nth) name; no row where there is none."""
    ahead = mentions.join(returns, ["ticker", "nth"]).groupBy("id").agg(F.avg("ahead").alias("ahead"))
    label = F.when(F.col("ahead") > 0, UP).when(F.col("ahead") < 0, DOWN).when(F.col("ahead") == 0, FLAT)
    return ahead.select("id", label.alias("label"))


def labelled(articles: DataFrame, mentions: DataFrame, returns: DataFrame) -> DataFrame:
    """articles (id, ...) with label, as of labels_of(); null where there is none."""
    return articles.join(labels_of(mentions, returns), "id", "left")


def terms(articles: DataFrame) -> DataFrame:
    """articles (id, title, content, ...) with terms: counts of the words of the text that a model gets, hashed to TERMS numbers."""
    words = F.filter(F.split(F.lower(X.model_text(F.col("title"), F.col("content"))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return HashingTF(numFeatures=TERMS, binary=True, inputCol="words", outputCol="terms").transform(articles.withColumn("words", F.coalesce(words, F.array().cast("array<string>")))).drop("words")


def fold_of(folds: int):
    return F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int")


def place() -> Column:
    """A row's place below PLACES, by a hash of its id."""
    return F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(PLACES))


def examples(articles: DataFrame, labels: DataFrame | None, folds: int, most: int) -> tuple[DataFrame, list[int]]:
    """label, terms, fold, place of the labelled articles that any fold's model is fitted on, and for each fold the place below which its model's rows stand.

    A model is fitted on all labelled articles of other folds, or where there are more than most, on about so many. Texts
    aren't moved unless they are among them.
    """
    rows = articles.where("label is not null") if labels is None else articles.select("id").join(labels.where("label is not null"), "id")
    if labels is not None:
        rows = written(rows, "labels")
    sizes = {r.fold: r.n for r in rows.groupBy(fold_of(folds).alias("fold")).agg(F.count("*").alias("n")).collect()}  # a row for each fold
    others = [sum(sizes.values()) - sizes.get(fold, 0) for fold in range(folds)]
    below = [PLACES if n <= most else int(most / n * PLACES) for n in others]
    rows = rows.where(place() < max(below))
    if labels is not None:
        chosen = rows.dropDuplicates(["id"])
        rows = articles.where(place() < max(below)).join(chosen, "id")
    return written(terms(rows).select("label", "terms", fold_of(folds).alias("fold"), place().alias("place")), "terms"), below


def fitted(rows: DataFrame, fold: int, below: int) -> LogisticRegressionModel | None:
    """A multinomial logistic regression of label on terms, on the rows of examples() of other folds; None where they have fewer than two labels."""
    rows = rows.where((F.col("fold") != fold) & (F.col("place") < below))
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="terms", labelCol="label", family="multinomial", maxIter=ROUNDS, regParam=PENALTY, standardization=False).fit(rows)


def scored(articles: DataFrame, folds: int = FOLDS, most: int = SAMPLE_ROWS, labels: DataFrame | None = None) -> DataFrame:
    """id, fold, pos, neg of articles (id, title, content, label), each by a model fitted on the labelled articles of other folds; null where these have fewer than two labels.

    labels: id and label, a row for an id, if articles don't have them; their texts needn't be joined with them then. Null
    texts count as empty. Rows that repeat an id are of one fold. At most about `most` labelled rows are fitted on; all are
    scored where they are read, in the engine, by hashed terms and coefficients.
    """
    rows, below = examples(articles, labels, folds, most)
    texts, out = articles.select("id", "title", "content", fold_of(folds).alias("fold")), None
    for fold in range(folds):
        model, own = fitted(rows, fold, below[fold]), texts.where(F.col("fold") == fold)
        if model is None:
            found = own.select("id", "fold", F.lit(None).cast("double").alias("pos"), F.lit(None).cast("double").alias("neg"))
        else:
            share = vector_to_array("probability")
            classes = model.numClasses
            of = lambda k: share[int(k)] if k < classes else F.lit(0.0)  # noqa: E731, B023
            found = model.transform(terms(own)).select("id", "fold", of(UP).alias("pos"), of(DOWN).alias("neg"))
        out = found if out is None else out.unionByName(found)
    return out
