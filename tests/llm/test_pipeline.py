"""The pipeline on the smallest data, stage by stage."""

from __future__ import annotations

import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from .test_ops import brute_lines
from tidemark.llm import packing
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept and kept <= ids
        ids = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == ids
    ends: dict[int, int] = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def odd_tables(folder, spark):
    rng = random.Random(3)
    words = lambda n, k: " ".join(f"{k}{rng.randint(0, 5000)}" for _ in range(n))
    passage = "\n".join(words(20, "p") for _ in range(4))
    texts = [f"{words(15, 'h')}\n{passage if i % 3 == 0 else words(60, 'x')}\n{words(15, 't')}" for i in range(40)]
    texts += [texts[1], texts[2] + " more", passage, None, "", " \n", "long " + words(9_000, "l")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], "en", "s", 9), (None, None, None, None, None), (6, "another text of number 6", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty, very long and repeated texts: every stage has the columns of documents, and no stage invents or loses what it shouldn't."""
    import corpus_pipeline

    rows = odd_tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before.columns and docs.count() <= before.count()
        assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        empty = stage(spark, before.limit(0), str(tmp_path))
        assert empty.columns == before.columns and empty.count() == 0
    assert len(rows) > docs.count() > 30 and {r.text for r in docs.where("doc_id is null").collect()} >= {None}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.agg(F.count_if(F.col("piece") == 0)).first()[0] == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_is_brute_force(spark, tmp_path):
    """Line dedup, near copies and packing one after the other, where the classifiers reject nothing, against plain Python."""
    import corpus_pipeline

    rng = random.Random(8)
    pool = [" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate([60, 30, 30, 9])]
    texts = []
    for i in range(120):
        own = [" ".join(f"o{i}w{j}" for j in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 3))]
        texts.append("\n".join(rng.sample([*own, *rng.sample(pool, 2)], len(own) + 2)))
        if i % 10 == 9:  # a near copy, whose only line differs
            long = " ".join(f"n{i}w{j}" for j in range(120))
            texts += [long, f"{long} c{i}"]
    texts.append(pool[0])  # of which nothing is left
    docs = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    gone = brute_lines(docs)
    kept = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))) for d, t in docs]
    kept = [(d, t) for d, t in kept if t.strip()]
    sets = {d: set(zip(*[t.lower().split()[i:] for i in range(5)])) or {tuple(t.lower().split())} for d, t in kept}
    first = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = first[a], first[b]
            first = {d: min(x, y) if c in (x, y) else c for d, c in first.items()}
    own = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: zlib.crc32(np.array([*own.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in kept if first[d] == d}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in out} == want and len(want) < len(kept) < len(docs)
