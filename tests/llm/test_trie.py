"""The trie of conversations against brute force, with containers of any size."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefix_trie as P

TURNS = "conv_id long, turn long, role string, text string, head string, n int"


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    convs = {c: [(r, x) for *_, r, _, x in sorted(t)] for c, t in convs.items()}
    made = {}
    for c, t in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(convs.get(first, [])[:h] + t[h:])
    nodes = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if made[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows, **limits):
    made = P.rebuilt(P.sequences(spark.createDataFrame(rows, TURNS).repartition(3)))
    return sorted(map(tuple, P.trie(made, **limits).collect()), key=repr)


def conversations():
    rng, rows = random.Random(3), []
    for c in range(90):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "é😀", "", None]), "clash", 5))
    for c in range(200, 230):  # one conversation, again and again
        rows += [(c, t, "user", f"same {t}", "clash", 5) for t in range(9)]
    rows += [(300, None, None, None, None, None), (300, 1, "b", "x", None, None), (300, 1, "a", "y", None, None), (300, 1, "a", "y", None, None), (None, 1, "user", "no id", None, None)]
    rows += [(302, t, "user", f"t{t}", None, None) for t in range(40)] + [(2**60 + 1, 1, "u", "far", None, None), (-7, 1, "u", "below", None, None), (307, 5, "user", "w " * 9000, None, None)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"least": 2, "heads": 1000}, {"least": 1, "heads": 7}])
def test_trie_is_that_of_brute_force(spark, limits):
    rows = conversations()
    assert built(spark, rows, **limits) == brute(rows)


def test_trie_of_nothing(spark):
    assert built(spark, []) == []
    assert built(spark, [(1, 0, "user", "x", "h", 1)], least=0) == brute([(1, 0, "user", "x", "h", 1)])


def test_sweep_goes_over_batches(spark):
    rows = conversations()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert built(spark, rows, least=3) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
