"""Names of elements, layouts that nearly fit, clashing columns, unlabelled text; parts of the classifiers against plain Python."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, html_text, line_dedup, quality, toxicity

PAGE = "<html><body>{}</body></html>"


def test_html_names_of_several_parts(spark):
    """Adverts, comments and notices go, in an article and where none is marked; what frames an article, and its own header, stay."""
    gone = ["class='related-posts'", "class='comments-area'", "id='cookie-banner'", "class=comment-list", "class='x ad-slot y'", 'class="adSlot"', "class='post_share_bar'", "role='site:banner'", "id=SponsoredBox"]
    kept = ["class='has-sidebar'", "class='comments-open'", "class='no-ads'", "class='sidebar-layout'", "class='address'", "class='adult-school'", "class='navigational'", "class='post-body'", "class='x comments-closed'"]
    pages, want = [], {}
    for i, names in enumerate(gone + kept):
        for k, page in enumerate((PAGE.format(f"<article><p>own</p><div {names}><p>x</p></div></article>"), PAGE.format(f"<p>own</p><div {names}><p>x</p></div>"))):
            pages.append((2 * i + k, f"http://h{2 * i + k}.x/", page))
            want[2 * i + k] = "own" if names in gone else "own\n\nx"
    pages += [(100, "http://a.x/", PAGE.format("<article><div class='article-header'><h1>T</h1></div><p>own</p></article>")), (101, "http://b.x/", PAGE.format("<div class='site-header'>S</div><p>own</p>"))]
    pages += [(102, "http://c.x/", PAGE.format("<div class='comments-frame'><article>a</article></div>"))]
    want |= {100: "T\n\nown", 101: "own", 102: "a"}
    out = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = {r.page_id: r.text for r in out}
    assert found == want


def test_layouts_take_what_fits_whole(spark):
    """Fields of an item's own fields, items without one, items that are no records: no layout, and nothing is lost silently. A field that is null counts as there."""
    json = [
        '{"messages":[{"meta":{"role":"user","content":"hidden"},"x":1}]}', '{"messages":[{"role":"user","content":"q"},{"content":"a"}]}', '{"messages":[{"role":"user","content":"q"},"text"]}', '{"messages":"role: content: "}',
        '{"messages":{"role":"user","content":"q"}}', '{"messages":[{"role":"user","content":null}]}', '{"messages":[[{"role":"user","content":"q"}]]}', '{"messages":[{"role":"user","content":"q","meta":{"role":"x"}}]}',
    ]
    records = spark.createDataFrame([(i, j, "own") for i, j in enumerate(json)], "id int, j string, fingerprint string").select("id", "fingerprint", F.parse_json("j").alias("record"))
    out = {r.id: r for r in chat.canonical(records).select("id", "fingerprint", "layout", "turns").collect()}
    assert {i: None if r.turns is None else [tuple(t) for t in r.turns] for i, r in out.items()} == {**dict.fromkeys(range(5)), 5: [("user", "")], 6: None, 7: [("user", "q")]}
    assert all(r.fingerprint == "own" and (r.layout is None) == (r.turns is None) for r in out.values())
    assert chat.canonical(records).columns == ["id", "fingerprint", "record", "layout", "turns"]


def test_lines_leave_clashing_columns(spark):
    passage = "\n".join(f"line {i} " + "w " * 20 for i in range(4))
    names = ["__gone", "__doc_id", "__text_id", "gone", "own_id", "d", "text_id", "odd.name"]
    rows = [(i, f"head {i}\n{passage}", 77, *range(len(names))) for i in range(2)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "n_removed", *names])
    found = line_dedup.dedup_lines(docs).orderBy("doc_id")
    assert set(found.columns) == set(docs.columns)
    assert [(r.doc_id, r.n_removed, r.text.count("\n"), *(r[c] for c in names)) for r in found.collect()] == [(0, 0, 4, *range(len(names))), (1, 4, 0, *range(len(names)))]
    found = line_dedup.dedup_lines(docs, counted="went").orderBy("doc_id").collect()
    assert [(r.n_removed, r.went) for r in found] == [(77, 0), (77, 4)]


def test_line_stage_leaves_clashing_columns(spark):
    import corpus_pipeline

    passage = "\n".join(f"line {i} " + "w " * 20 for i in range(4))
    docs = spark.createDataFrame([(0, f"a\n{passage}", 77, 5, 1), (1, f"b\n{passage}", 77, 5, 1), (2, passage, 77, 5, 1)], "doc_id long, text string, n_removed int, lines_removed int, n_chars long")
    out = corpus_pipeline.lines(spark, docs, "").orderBy("doc_id")
    assert out.columns == docs.columns and [(r.doc_id, r.n_removed, r.lines_removed, r.n_chars) for r in out.collect()] == [(0, 77, 5, len(f"a\n{passage}")), (1, 77, 5, 1)]


def test_quality_sees_unlabelled_text(spark):
    """Only good texts have labels: poor ones are known from unlabelled text alone, and still get lower scores."""
    rng = np.random.default_rng(3)
    good = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) + "."
    poor = lambda: "BUY NOW !!! $$$ " * 15
    docs = [(i, good() if i % 2 else poor()) for i in range(600)]
    labels = [(i, 1) for i in range(1, 600, 2) if i % 3]
    out = quality.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), unlabelled_rows=300).collect()
    scores = {r.doc_id: r.score for r in out}
    assert np.mean([scores[i] for i in range(0, 600, 2)]) < 0.3 < 0.7 < np.mean([scores[i] for i in range(1, 600, 2)])


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_slopes_of_the_risk(shift):
    """Against finite differences: of the whole risk, and where that on negatives is below zero, of it alone and backwards."""
    rng, prior = np.random.default_rng(1), 0.6
    gp, gu = rng.standard_normal(7) + (4 if shift else 0), rng.standard_normal(9) + shift
    below = quality.risks(gp, gu, prior)[1] < 0
    assert below == (shift < 0)
    risk = lambda g: -quality.risks(g[:7], g[7:], prior)[1] if below else sum(quality.risks(g[:7], g[7:], prior))
    at, want = np.concatenate([gp, gu]), []
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-6
        want.append((risk(at + step) - risk(at - step)) / 2e-6)
    assert np.allclose(quality.slopes(gp, gu, prior), want, atol=1e-7)


def test_toxic_features_are_those_of_plain_python():
    text = "You are a (Nasty) nastiest THING, you!! 4 n*sty and fine words nasty"
    found = dict(zip(toxicity.FEATURES, toxicity.features(text, frozenset({"nasty"}), frozenset({"nast"})), strict=True))
    words = [w.strip(toxicity.EDGES) for w in text.lower().split()]
    hits = [i for i, w in enumerate(words) if w == "nasty"]
    assert found["log_words"] == math.log1p(len(words)) and found["word_density"] == len(hits) / len(words)
    assert found["begin_density"] == sum(len(w) > 4 and w[:4] == "nast" for w in words) / len(words)
    assert found["second_person"] == words.count("you") / len(words) and found["exclaims"] == 2 / len(words)
    assert found["near_second_person"] == sum(any(w == "you" for w in words[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i in hits) / len(words)
    assert found["capitals"] == 1 / len(words) and found["digits"] == 1 / len(text) and found["obfuscated"] == len(re.findall(r"[a-zA-Z][*$@#0-9]+[a-zA-Z]", text)) / len(words)
