"""Sentiment of articles by a model that the caller brings: it is loaded once for a task and gets texts in batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

#: From texts to shares of positive and of negative sentiment.
Scorer = Callable[[list[str]], list[tuple[float, float]]]
BATCH = 64


def lexicon(positive: list[str] = X.POSITIVE, negative: list[str] = X.NEGATIVE) -> Callable[[], Scorer]:
    """A stand-in for a model: shares of the words that stand in one of two lists."""

    def load() -> Scorer:
        good, bad, apart = set(positive), set(negative), re.compile(r"[^a-z]+")

        def score(texts: list[str]) -> list[tuple[float, float]]:
            words = [apart.split(t.lower()) for t in texts]
            return [(sum(map(good.__contains__, w)) / len(w), sum(map(bad.__contains__, w)) / len(w)) for w in words]

        return score

    return load


def scored(articles: DataFrame, load: Callable[[], Scorer], batch: int = BATCH) -> DataFrame:
    """id, pos, neg of articles (id, title, content): what the scorer that load makes says of the beginning of title and content. A null text counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in frames:
            found = [x for i in range(0, len(frame), batch) for x in score(frame["text"].iloc[i : i + batch].fillna("").tolist())]
            yield pd.DataFrame({"id": frame["id"], "pos": [x for x, _ in found], "neg": [x for _, x in found]})

    texts = articles.select("id", X.model_text(F.col("title"), F.col("content")).alias("text"))
    return texts.mapInPandas(run, "id long, pos double, neg double")
