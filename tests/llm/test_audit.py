"""The audit of filters against brute force over documents and orders."""

from __future__ import annotations

import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from tidemark.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, part string, n int"
LABELS = "doc_id long, quality int, toxic int, good string"


def fails_of(text, doc_id, ids):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [
        len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)),
        doc_id is not None and any(x is not None and x < doc_id for x in ids[text]),
    ]


def brute(docs, labels):
    ids, out = {}, {}
    for d, t, *_ in docs:
        ids.setdefault(t or "", []).append(d)
    good, toxic = {d for d, q, _, _ in labels if q == 1 and d is not None}, {d for d, _, t, _ in labels if t == 1 and d is not None}
    rows = [(s or "", d, fails_of(t or "", d, ids)) for d, t, s, *_ in docs]
    for part in {p for p, _, _ in rows}:
        own, shares = [(d, f) for p, d, f in rows if p == part], [0] * 5
        for order in permutations(range(5)):
            left = own
            for i, k in enumerate(order):
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                shares[k] += len(gone)
                failing = [x for x in own if x[1][k]]
                out[part, "".join("ABCDE"[x] for x in order), i + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(f) == 1 for _, f in failing), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, i), x in out.items():
            if p == part:
                x.append(shares["ABCDE".index(order[i - 1])])
    return out


def audited(spark, docs, labels):
    found = A.audit(A.masks_of(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))).collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(out) == len(found)
    return out


def test_audit_is_that_of_brute_force(spark):
    words = " ".join(f"w{i}" for i in range(250))
    texts = [words, words, "", None, "", "\x0b\x1c \t", "a b A B", "é" * 60 + "É" * 40, words.upper(), words + " #", "x " * 300, "X " * 300, "X$ " * 300, words + "\xa0|", words.title(), "😀" * 48 + "AB", "😀" * 98 + "AB", "😀" * 97 + "ABC", "w " * 200 + words]
    docs = [(i if i % 7 else None, t, ["x", "y", None, ""][i % 4], "clash", 5) for i, t in enumerate(texts * 2)]
    docs += [(3, words, "x", "clash", 5), (3, words, "y", "clash", 5), (3, "other", "x", "clash", 5), (1, words, "z", None, None), (1, words, "z", None, None), (-4, "", "z", None, None)]
    labels = [(i, i % 2, (i // 2) % 2, "clash") for i in range(0, 40, 3)] + [(3, 0, 1, "c"), (3, None, None, "c"), (None, 1, 1, "c"), (999, 1, 1, "c")]
    got, want = audited(spark, docs, labels), brute(docs, labels)
    assert got == want
    assert len(got) == 600 * len({p for p, _, _ in got})


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    only = audited(spark, [(1, "x", "s", "c", 1)], [])
    assert len(only) == 600 and all(x[4:6] == [0, 0] for x in only.values())


def test_weights_of_coalitions_are_those_of_shapley():
    for n in (2, 3, 5):
        for i, row in enumerate(A.shapley_weights(n)):
            for s, w in enumerate(row[1:], 1):  # the empty coalition removes nothing
                k = s.bit_count()
                inside = s >> i & 1
                size = k - inside
                assert w == (Fraction(1 if inside else -1) * factorial(size) * factorial(n - size - 1))
