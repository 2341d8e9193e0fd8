"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon holds words and beginnings of words that mark toxic training texts. Features are the densities of both in a
text, how near they stand to words of the second person, and rates of capitals, punctuation and obfuscated words. Trees
are fitted on four fifths of the sample; the rest calibrates their scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, per_row, read, row_key, sampled, small_batches, written

#: At most so many labelled rows are learned from, the first by a hash of doc_id and text; the lexicon has at most LEXICON entries.
SAMPLE_ROWS = 20_000
LEXICON = 600
#: A lexicon entry stands in at least so many toxic texts of the sample, and that many times likelier than in others.
LEAST_TEXTS, LEAST_RATIO = 3, 15
BEGINNINGS = (4, 5, 6)
NEAR = 5
TREES, DEPTH, SEED = 20, 4, 5
THRESHOLD = 0.3
EDGES = ".,;:!?\"'()[]{}«»…-–—*_"
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch ihr sie ihnen ti tú usted ustedes vosotros vuestro tus".split())
OBFUSCATED = re.compile(r"[^\W\d_][*$@#0-9]+[^\W\d_]")
FEATURES = ["log_words", "word_density", "word_count", "begin_density", "begin_count", "second_person", "near_second_person", "capitals", "exclaims", "punctuation", "obfuscated", "digits"]


def tokens(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def entries(words: set[str]) -> set[str]:
    """What of a text can be in the lexicon: its words, and beginnings of its longer words marked by a star."""
    return words | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) > n}


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            (toxic if label else clean).update(entries(set(tokens(text or ""))) - {""})
        yield pd.DataFrame([(w, toxic[w], clean[w]) for w in toxic | clean], columns=["entry", "toxic", "clean"])


def lexicon_of(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and beginnings; sample: text, toxic."""
    n = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    found = sample.mapInPandas(counted, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    found = found.withColumn("ratio", ratio).where((F.col("toxic") >= LEAST_TEXTS) & (F.col("ratio") >= LEAST_RATIO))
    best = [r["entry"] for r in found.orderBy(F.desc(F.col("toxic") * F.ln("ratio")), "entry").limit(LEXICON).collect()]
    return frozenset(w for w in best if not w.endswith("*")), frozenset(w[:-1] for w in best if w.endswith("*"))


def features(text: str | None, words: frozenset[str], begins: frozenset[str]) -> tuple[float, ...]:
    text = text or ""
    found = tokens(text)
    n, chars = max(1, len(found)), max(1, len(text))
    hits = [i for i, w in enumerate(found) if w in words] if not words.isdisjoint(found) else []
    begin = sum(any(w[:k] in begins for k in BEGINNINGS if len(w) > k) for w in found) if begins else 0
    second = sum(map(SECOND_PERSON.__contains__, found))
    near = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(found[max(0, i - NEAR) : i + NEAR + 1]))
    raw = text.split()
    return (
        math.log1p(len(found)), len(hits) / n, math.log1p(len(hits)), begin / n, math.log1p(begin), second / n, near / n,
        sum(map(str.isupper, raw)) / n, text.count("!") / n, sum(map(text.count, ".,;:?-")) / n, len(OBFUSCATED.findall(text)) / n, sum(map(text.count, "0123456789")) / chars,
    )


SCHEMA = "doc_id long, held_out boolean, toxic int, " + ", ".join(f"{x} double" for x in FEATURES)


def featured(words: frozenset[str], begins: frozenset[str]):
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame([features(t, words, begins) for t in batch["text"]], columns=FEATURES, dtype="float64")
        return pd.concat([batch[["doc_id", "held_out", "toxic"]].reset_index(drop=True), made], axis=1)

    return per_row(fn)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score double, predicted int for every row of docs (doc_id, text). labels: doc_id, toxic.

    Labels are learned from rows alone whose crc32(doc_id as text) mod 4 is not 2, of these from sample_rows at most; of
    several labels of one doc_id the greatest counts, null ones don't; rows that repeat doc_id and text are learned from
    once. Null and empty texts are scored like any other, very long ones as a whole. With training rows of one label
    only, all scores are that label; without any, 0. Null and repeated doc_id keep their rows. No rows give no rows.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    keyed = docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    labelled = written(keyed.where(~F.col("held_out")).select("row_key", "doc_id").join(own, "doc_id").select("row_key", "toxic").distinct(), "toxic-labelled")
    chosen = written(sampled(labelled, sample_rows), "toxic-sample")  # sample_rows at most
    sample = keyed.join(F.broadcast(chosen), "row_key").dropDuplicates(["row_key"])
    sample = written(sample.select("doc_id", "held_out", "toxic", "text"), "toxic-texts")
    words, begins = lexicon_of(sample)
    training = written(sample.mapInPandas(featured(words, begins), SCHEMA).coalesce(4), "toxic-training")
    n, n_toxic = training.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    everything = docs.withColumn("toxic", F.lit(None).cast("int")).select("doc_id", "held_out", "toxic", "text").mapInPandas(featured(words, begins), SCHEMA)
    if not 0 < n_toxic < n:
        score = float(n_toxic > 0)
        return everything.select("doc_id", "held_out", F.lit(score).alias("score"), F.lit(int(score >= threshold)).alias("predicted"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep")
    ready = vector.transform(training).withColumn("label", F.col("toxic").cast("double")).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)))
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, cacheNodeIds=False).fit(ready.where("fold <> 0"))

    def margin(rows: DataFrame) -> DataFrame:
        return trees.transform(rows).withColumn("p", vector_to_array("probability")[1])

    held = margin(ready.where("fold = 0"))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(held if held.select("label").distinct().count() == 2 else margin(ready))
    out = isotonic.transform(margin(vector.transform(everything)))
    score = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def op5_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
