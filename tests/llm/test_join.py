"""The n-gram Jaccard join against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import group_join as J

DOCS = "doc_id long, text string, node long, keys string, page int"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(docs, size, percent):
    sets = [(d, shingles(t, size)) for d, t, *_ in docs]
    of = {d: d for d, s in sets if d is not None}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                of[q] = p
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)


def found(spark, docs, size, percent):
    return sorted(map(tuple, J.jaccard_components(spark.createDataFrame(docs, DOCS).repartition(3), size, percent).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, passage = ["", None, " \t", "one", "ONE", "one two", "one two", "a b c", "A b C", "a b c d", "\xa0 x", "\x1c", "é É", "é é"], [word() for _ in range(60)]
    for _ in range(40):  # near copies, some by chains alone
        own = [word() for _ in range(rng.randrange(5, 150))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(own)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(rng.randrange(0, 40))] + passage) for _ in range(60)]  # what they share is most of them
    own = [word() for _ in range(200)]
    for _ in range(60):
        if rng.random() < 0.7:
            own = list(own)
            own[rng.randrange(200)] = word()
        texts.append(" ".join(own))
    docs = [(i, t, i % 3, "clash", 1) for i, t in enumerate(texts)]
    docs += [(None, texts[20], 1, "c", None), (None, None, 1, "c", None), (5, texts[30], 1, "c", None), (5, texts[60], 1, "c", None), (5, texts[60], 1, "c", None), (-3, texts[80], None, None, None)]
    return docs + [(2**60 + 1, texts[90], None, None, None), (2**60 + 2, texts[90] + " more", None, None, None)]


@pytest.mark.parametrize(("size", "percent", "group"), [(3, 90, 256), (3, 90, 3), (2, 70, 16)])
def test_join_is_that_of_brute_force(spark, monkeypatch, size, percent, group):
    monkeypatch.setattr(J, "GROUP", group)
    docs = corpus()
    assert found(spark, docs, size, percent) == brute(docs, size, percent)


def test_join_of_nothing(spark):
    assert found(spark, [], 3, 90) == []
    assert found(spark, [(1, None, 1, "x", 1)], 3, 90) == [(1, 0, 1)]


def test_links_hold_for_any_sketch_and_blocks(spark, monkeypatch):
    """The order of shingles and the cutting of work change no result."""
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "UNIT", 10)
    monkeypatch.setattr(J, "GROUP", 8)
    docs = corpus()[:200]
    assert found(spark, docs, 3, 85) == brute(docs, 3, 85)


def test_first_shingles_meet():
    """Any two sets that are linked share as many of the first shingles as either asks for."""
    rng, counts = np.random.default_rng(1), np.random.default_rng(2).integers(0, 9, J.CELLS).astype(np.float32)

    def first(text):
        import pandas as pd

        row = next(J.first_shingles(counts, 1, 80)(iter([pd.DataFrame({"row_key": [1], "text": [text]})])))
        return set(row["first"].iat[0].tolist()), row["shared"].iat[0]

    for _ in range(300):
        x = [f"a{i}" for i in range(rng.integers(1, 40))]
        y = [w for w in x if rng.random() < 0.93] + [f"b{i}" for i in range(rng.integers(0, 4))]
        if y and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)):
            (p, k), (q, m) = first(" ".join(x)), first(" ".join(y))
            assert len(p & q) >= max(k, m)
