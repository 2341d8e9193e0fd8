"""Small cases of the numbered operators: nulls, empty and repeated rows, ties, empty tables, clashing columns; brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat, html_text, line_dedup, near_dedup, packing, quality, topk, toxicity
from tidemark.llm.common import sampled

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a  b", "a\n\nb\n\n\nc ", "x<|endoftext|> y", "it's  don't", "\x1c!\x1c ", "\xa0 x", "日本語 😀", "é Å İ", "Same text", "Same text", "word " * 9000]


def docs_of(spark, texts, **more):
    rows = [(None if t == "no id" else i, t, 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, node string").repartition(3)


# 1
PAGE = "<html><head><title>T</title></head><body><nav>Menu</nav>{}<div class='ad box'>Buy</div><footer>F</footer><script>var a='<p>';</script></body></html>"


def test_html(spark):
    pages = [
        (1, "http://a.b/other/1", PAGE.format("<article><h1>A&amp;B</h1><p>one\n two<br>three<p>four</article>"), 1),
        (2, "http://a.b/x/2", PAGE.format("<div>Site head</div><p>first own</p><p>second own</p><p>third own</p>"), 1),
        (3, "http://a.b/x/3", PAGE.format("<div>Site head</div><p>other</p><p>words</p><p>here</p>"), 1),
        (4, "http://c.d/", PAGE.format("<p>alone</p>"), 1), (5, None, None, 1), (6, "http://c.e/", "", 1), (4, "http://c.d/", PAGE.format("<p>alone</p>"), 1), (None, "http://z.z/", "<p>no id", 1),
    ]
    out = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, lines int")).collect()
    found = {r.page_id: r.text for r in out}
    assert len(out) == 8 and all(r.n_chars == len(r.text) for r in out)
    assert found == {1: "A&B\n\none two three\n\nfour", 2: "first own\n\nsecond own\n\nthird own", 3: "other\n\nwords\n\nhere", 4: "alone", 5: "", 6: "", None: "no id"}
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_articles(spark):
    """What is named like no content but holds the article, or lacks its end; a comment that is an article; a nested notice."""
    cases = [
        ("<article class='post comments-open'><p>x</article>", "x"), ("<div class='wrap has-sidebar'><article>x</article></div>", "x"), ("<div class='sidebar'><article>x</article></div>", "x"),
        ("<p class='share'>s<p>t</p>", "t"), ("<div class='ad'>never ended<p>y", "never ended\n\ny"), ("<main><p>m</p><aside>no</aside><header>h</header></main><article class='comment'>c</article>", "m\n\nh"),
        ("<ul><li class='ad'>x<li>y</ul>", "y"), ("a<span class='ad'>b</span>c", "a\n\nc"), ("<div id=comments><p>no</div>z", "z"), ("x" * 3_000_000, "x" * 3_000_000),
    ]
    pages = [(i, f"http://h{i}.x/", PAGE.format(x), "clash") for i, (x, _) in enumerate(cases)]
    out = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, kept string")).collect()
    assert {r.page_id: r.text for r in out} == {i: t for i, (_, t) in enumerate(cases)}


def test_html_is_that_of_brute_force(spark):
    """Pages without marks, on two hosts: by the nearest path, whose first 250 characters are the same, shared lines go; near copies keep theirs."""
    rng, pages, want = random.Random(11), [], {}
    base = "s" * 250
    for host in ("a.x", "b.x"):
        paths = sorted({f"/{base}/{rng.choice(['news', 'sport', 'zoo'])}/{rng.randint(0, 10**rng.randint(1, 6))}" for _ in range(40)})
        bodies = []
        for i, path in enumerate(paths):
            # the template has 30 lines, the text one to three; some pages are copies of the page before, but for a word
            own = [f"{host} own {i} {k} " + " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(3, 30))) for k in range(rng.randint(1, 3))]
            own = [x.rsplit(" ", 1)[0] + " edited" if k == 0 else x for k, x in enumerate(bodies[-1][1])] if i % 7 == 3 else own
            bodies.append((path, own))
        template = [f"{host} template {k}" for k in range(30)]

        def edits(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, old = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
            return row[-1]

        for i, (path, own) in enumerate(bodies):
            lines = template[:10] + own + template[10:]
            pages.append((len(pages), f"https://{host}{path}", "".join(f"<p>{x}</p>" for x in lines)))
            near = sorted((k for k in (i - 1, i + 1) if 0 <= k < len(bodies)), key=lambda k: (edits(path, bodies[k][0]), k))
            other = next((bodies[k][1] for k in near if not (len(own) == len(bodies[k][1]) and abs(sum(x.count(" ") + 1 for x in own if x not in bodies[k][1]) - sum(x.count(" ") + 1 for x in bodies[k][1] if x not in own)) <= 0.2 * sum(x.count(" ") + 1 for x in own if x not in bodies[k][1]))), None)
            want[len(pages) - 1] = "\n\n".join(lines if other is None else [x for x in own if x not in other])
    out = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    assert {r.page_id: r.text for r in out} == want and sum("template" not in x for x in want.values()) > 60


def test_common_lines():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        c, rest = html_text.common_lines(a, b), iter(b)
        assert len(c) == d[-1, -1] and all(a[i] in rest for i in c)


# 2, 3
def vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 16)) * 0.3
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in np.float32(y)], 0) for i, y in enumerate(v)]
    rows += [(900, None, 0), (901, [1.0, None] + [0.0] * 14, 0), (902, [float("nan")] * 16, 0), (903, [0.0] * 16, 0), (904, [float("inf")] * 16, 0), (905, [], 0), (50, rows[50][1], 0), (None, rows[1][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")


@pytest.mark.parametrize("cosine", [False, True])
def test_searches(spark, cosine):
    rows, df = vectors(spark)
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and (not cosine or any(v))]
    fn = ann.nearest if cosine else topk.top_k
    got: dict[int, list] = {}
    for r in sorted(fn(df.where("vec_id % 50 = 0"), df, 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in {i for i, _ in good if i % 50 == 0}:
        a = next(v for i, v in good if i == q)
        score = (lambda x, y: (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())) if cosine else (lambda x, y: int(np.floor(256 * x) @ np.floor(256 * y)))
        want = sorted(((-score(a, v), i) for i, v in good if i != q))[:5]
        if cosine:
            hits += len({i for i, _ in got[q]} & {i for _, i in want})
            assert all(s == pytest.approx(score(a, dict(good)[i])) for i, s in got[q])
        else:
            assert got[q] == [(i, -s) for s, i in want]
    assert not cosine or hits >= 0.9 * 5 * len(got)
    assert fn(df.limit(0), df, 5).count() == 0 == fn(df, df.limit(0), 5).count()
    assert fn(df.where("vec_id % 50 = 0"), df, 5).select("rank").count() == sum(map(len, got.values()))


# 4, 5
def labelled(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    texts, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(20, 80))]
        poor, toxic = i % 5 == 0, i % 7 == 0
        if poor:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[3:3] = rng.sample(["grunkle", "blarg", "snivvet"], 2)
        texts.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    texts += [(1000, None), (1001, ""), (None, "no id"), (1, "twice")]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None, None)], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_sampled(spark):
    """The filter before the sort leaves the sample as it is; small and empty tables go whole; so do keys that aren't spread as hashes are."""
    rows = spark.range(5000).select(F.xxhash64("id").alias("row_key"), "id")
    plain = sorted(r[0] for r in rows.orderBy("row_key").limit(300).collect())
    assert sorted(r[0] for r in sampled(rows.union(rows), 300).collect()) == plain
    assert sampled(rows, 9000).count() == 5000 and sampled(rows.limit(0), 300).count() == 0
    assert [sampled(spark.range(5000).select((F.col("id") + k).alias("row_key")), 300).count() for k in (0, 2**62)] == [300, 300]


def test_prior():
    """Positives and negatives of overlapping scores; the unlabelled hold 30 or 80 % positives."""
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.8):
        p, u = rng.beta(6, 2, 20_000), np.concatenate([rng.beta(6, 2, int(40_000 * prior)), rng.beta(2, 6, 40_000 - int(40_000 * prior))])
        assert quality.prior_of(np.stack([np.histogram(x, 1000, (0, 1))[0] for x in (p, u)], axis=1)) == pytest.approx(prior, abs=0.03)


@pytest.mark.parametrize(("fn", "k"), [(quality.scored, 0), (toxicity.scored, 1)])
def test_classifiers(spark, fn, k):
    docs, labels, truth = labelled(spark)
    out = fn(docs, labels).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    held = [(r.predicted, truth[r.doc_id][k]) for r in out if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert fn(docs, labels.limit(0)).count() == 604 and fn(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize(("fn", "name"), [(quality.scored, "quality"), (toxicity.scored, "toxic")])
def test_classifiers_on_odd_tables(spark, fn, name):
    """One doc_id for nearly all rows, or none; labels of one kind; columns named like the operator's; very long and repeated texts."""
    schema = "doc_id long, text string, score double, x string, row_key int, toxic string, held_out int"
    texts = ["good words " * 3, "BAD!! " * 4, "word " * 200_000, None, "", "good words " * 3]
    for ids in ([1] * 300, [None] * 300, list(range(300))):
        docs = spark.createDataFrame([(d, f"{texts[i % 6]} {i % 50}" if texts[i % 6] and i % 6 != 2 else texts[i % 6], 9.0, "x", 1, "t", 7) for i, d in enumerate(ids) if i % 6 != 2 or i < 6], schema)
        for kinds in ([0, 1], [1], [0]):
            labels = spark.createDataFrame([(i, kinds[i % len(kinds)], 5) for i in range(300)], f"doc_id long, {name} int, score int")
            if kinds == [0, 1] or ids[0] == 0:
                out = fn(docs, labels, sample_rows=20).collect()
                assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)


# 6
def test_recall_on_a_whole_block():
    """5,000 rows around centres: what the search opens is a part of the block, and recall against brute force is 0.9 or more."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((50, 64))
    v = centres[rng.integers(0, 50, 5_000)] + 0.5 * rng.standard_normal((5_000, 64))
    rows = pd.DataFrame({"vec_id": np.arange(5_000), "v": list(v)})
    found = ann.search_block(rows, rows[::50], 5).groupby("query_id")["vec_id"].agg(set)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit[::50] @ unit.T
    near[np.arange(100), np.arange(0, 5_000, 50)] = -2
    want = {50 * i: set(np.argsort(-x)[:5].tolist()) for i, x in enumerate(near)}
    assert sum(len(found[q] & w) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_more_than_64_neighbours():
    v = np.random.default_rng(5).standard_normal((300, 8))
    rows = pd.DataFrame({"vec_id": np.arange(300), "v": list(v)})
    found = ann.search_block(rows, rows[:1], 100)
    assert len(found) == found.vec_id.nunique() == 100 and found.score.is_monotonic_decreasing


@pytest.mark.parametrize("text", ["a\n\n\nb\tc\td", "a\tb\tc\n\n", "one two\n\n\nthree\tfour\xa0five", "a  b\u3000c", " a\x85b", "a \x1cb", "a b\nc", "a\0 b", ""])
def test_words_are_those_of_the_library(text):
    """Also where surplus spaces and missing ones add up to one for each word."""
    own = bpe.tokenizer(BYTE)
    words = bpe.words_of(text, None)
    assert words == bpe.CHUNKS.findall(text)
    assert [i for w in words for i in own.encode(w, add_special_tokens=False).ids] == own.encode(text, add_special_tokens=False).ids


def test_bpe(spark):
    own = bpe.tokenizer(BYTE)
    got = {r.doc_id: r for r in bpe.digests(docs_of(spark, ODD), BYTE).collect()}
    full = {r.doc_id: r for r in bpe.encode(docs_of(spark, ODD), BYTE).collect()}
    for i, t in enumerate(ODD):
        ids = own.encode(t or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and list(full[i].ids) == ids and full[i].decoded == text
    assert bpe.digests(docs_of(spark, ["x"]).limit(0), BYTE).count() == 0


# 7
def test_chat(spark):
    texts = ["plain", "</s>[INST] ok [/INST] &lt; &amp;lt; <|turn|>x<|end|>", "a\nb", None, ""]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, 0, None, "x"), (1, 0, "user", "plain")]
    out = chat.format_chat(chat.conversations_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = {r.conv_id: r.t for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in back[1]] == [("user", "plain"), ("user", "plain"), *[("assistant" if i % 2 else "user", texts[i] or "") for i in range(1, 5)]]
    assert [tuple(t) for t in back[None]] == [("", "x")]
    loss = out.select("conv_id", chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("t")).collect()
    assert {r.conv_id: r.t for r in loss} == {1: [texts[1], ""], None: []}


def test_chat_of_odd_tables(spark):
    """Very long and repeated texts, columns named like the operator's, no rows."""
    long = "a 😀 <b> & [c]\n" * 50_000
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", long, "x"), (1, 1, "assistant", long, "x"), (2, None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(chat.conversations_of(df).withColumns({"turns": F.lit(1), "loss_spans": F.lit(2), "formatted": F.lit("f")}))
    found = {r.conv_id: (r.t, r.l) for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [tuple(t) for t in found[1][0]] == [("user", "hi"), ("assistant", long), ("assistant", long)] and found[1][1] == [long, long]
    assert [tuple(t) for t in found[2][0]] == [("", "")] and found[2][1] == []
    assert chat.format_chat(chat.conversations_of(df.limit(0))).count() == 0


def test_layouts(spark):
    json = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"extra":{"x":1}}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","response":"a"}',
            '{"instruction":"q","output":"a"}', '{"system":"s","instruction":"q","input":"i","output":"a"}', '{"other":1}', '{"messages":[]}']
    out = chat.format_chat(spark.createDataFrame(list(enumerate(json)), "id int, j string").select("id", F.parse_json("j").alias("record"))).collect()
    turns = {r.id: None if r.turns is None else [tuple(t) for t in r.turns] for r in out}
    qa = [("user", "q"), ("assistant", "a")]
    assert turns == {0: qa, 1: qa, 2: qa, 3: qa, 4: [("system", "s"), ("user", "q"), ("user", "i"), ("assistant", "a")], 5: None, 6: []}


# 8
def test_packing(spark):
    own = packing.tokenizer(WORD)
    out = packing.pack(docs_of(spark, ODD), WORD).collect()
    for i, t in enumerate(ODD):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert mine == [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    gapless(out)
    assert packing.pack(docs_of(spark, ["x"]).limit(0), WORD).count() == 0


def test_words_are_encoded_as_by_the_library():
    """Each code point between two letters, alone, and after a letter with a mark."""
    encode, own = packing.word_encoder(WORD), packing.tokenizer(WORD)
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    for make in (lambda c: f"a{c}b", lambda c: c, lambda c: f"e\u0301{c}"):
        words = [w for c in points for w in make(c).split() if packing.WORD_END not in w and not set(w) & set("\x1c\x1d\x1e\x1f")]
        want = [np.array(x.ids, "<u4").tobytes() for x in own.encode_batch(words, add_special_tokens=False)]
        assert [w for w, x, y in zip(words, encode(words), want, strict=True) if x != y] == []


def gapless(rows):
    at: dict[int, list] = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096


def test_plan():
    rng = random.Random(1)
    histogram: dict[int, int] = {}
    for _ in range(5000):
        n = rng.choice([rng.randint(1, 4096), rng.randint(1, 500), 4096])
        histogram[n] = histogram.get(n, 0) + 1
    plan, room, got = packing.make_plan(histogram), {}, {}
    for r in plan.itertuples():
        got[r.length] = got.get(r.length, 0) + r.n
        for i in range(r.n):
            room.setdefault(r.sequence + i // r.copies, []).append((r.offset + i % r.copies * r.length, r.length))
    assert got == histogram and len(room) <= 1.01 * sum(a * b for a, b in histogram.items()) / 4096 + 1
    assert all(sum(n for _, n in x) <= 4096 and sorted(x)[-1][0] + sorted(x)[-1][1] == sum(n for _, n in x) for x in room.values())


# 9
def test_near(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = [" ".join(base), " ".join(base), None, "", " ", "one", "ONE", "one two"]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(1, 14)):
            own[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"w{rng.randint(0, 400)}" for _ in range(80)) for _ in range(30)] + ["no id"]
    out = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts), 2, 80).collect()}
    sets = {}
    for i, t in enumerate(texts[:-1]):
        w = (t or "").lower().split()
        sets[i] = {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))
    parent = {i: i for i in sets}
    for _ in range(len(sets)):
        for i in sets:
            for j in range(i):
                c = len(sets[i] & sets[j])
                if c and 100 * c >= 80 * len(sets[i] | sets[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert {i: (out[i].n_shingles, out[i].component_id, out[i].kept) for i in sets} == {i: (len(s), parent[i], parent[i] == i) for i, s in sets.items()}
    assert out[None].component_id is None and out[None].kept
    assert near_dedup.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_near_of_repeated_ids(spark):
    """A doc_id with two texts, each with a near copy; three texts of no doc_id; a very long text and its copy; repeated rows."""
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    long = " ".join(f"l{i % 7919}" for i in range(200_000))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (4, "else"), (None, a), (None, None), (9, long), (8, long + " end"), (1, a)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, 80).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in out} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True), (8, 8, True), (9, 8, False)}


# 10
def brute_lines(rows, least=50):
    docs = [(d, [(i, y) for i, x in enumerate((t or "").split("\n")) if (y := re.sub(r"\s+", " ", x).strip(" "))]) for d, t in rows]
    seen, gone = set(), {}
    for d, lines in docs:
        for s in range(len(lines)):
            words = 0
            for e in range(s, len(lines)):
                words += lines[e][1].count(" ") + 1
                key = tuple(x for _, x in lines[s : e + 1])
                if words >= least and key in seen:
                    gone.setdefault(d, set()).update(i for i, _ in lines[s : e + 1])
                elif words >= least:
                    seen.add(key)
    return gone


@pytest.mark.parametrize("partitions", [4, 40])
def test_lines(spark, partitions):
    """With 40 partitions intervals of the array go over many ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        lines_are_those_of_brute_force(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def lines_are_those_of_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate([60, 20, 20, 20, 9, 3])]
    texts = []
    for _ in range(80):
        lines = [rng.choice([*pool, *pool, "", f"own {rng.random()}"]) for _ in range(rng.randint(0, 9))]
        texts.append("\n".join(lines))
    texts += [None, "", "\n".join(pool[1:4]), "  ".join(pool[0].split())]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    gone = brute_lines(rows)
    for d, t in rows:
        away = gone.get(d, set())
        assert out[d].n_removed == len(away) and out[d].text == (t if not away else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in away))
        assert out[d].node == "clash"
    assert line_dedup.dedup_lines(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_lines_of_odd_rows(spark):
    """Repeated doc_ids and rows, rows without doc_id, a very long text, columns named like the operator's own."""
    passage = "\n".join(" ".join(f"q{k}w{i}" for i in range(12)) for k in range(6))
    long = "\n".join(f"line {i} of a very long text" for i in range(30_000))
    rows = [(1, passage, "p"), (1, "own\n" + passage, "q"), (None, passage, "r"), (2, "x\n" + passage + "\ny", "s"), (2, "x\n" + passage + "\ny", "t"), (3, long, "u"), (4, long + "\nend", "v"), (5, " \n\t\n", "w")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, seq string").repartition(5)).collect()
    found = sorted((r.doc_id or 0, r.seq, r.n_removed, r.text) for r in out)
    assert [x for x in found if x[0] != 1] == [(0, "r", 0, passage), (2, "s", 6, "x\ny"), (2, "t", 6, "x\ny"), (3, "u", 0, long), (4, "v", 30_000, "end"), (5, "w", 0, " \n\t\n")]
    assert {x[1]: x[2:] for x in found if x[0] == 1} == {"p": (6, ""), "q": (6, "own")}
