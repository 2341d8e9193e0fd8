"""Near duplicates by MinHash: many universal hash minima, banding, verification, connected components.

1. A document becomes the set of its word shingles, as 64-bit hashes, and this its MINIMA minima of universal hashes.
   Documents with equal sets are one class, told by a 128-bit digest; only one of its rows goes on, as its node.
2. ROWS minima make a band; classes with an equal band share a bucket. Classes at a similarity of 0.8 share one of the
   BANDS with a probability of over 0.999995. Each class is first compared with the smallest of each of its buckets, on
   the full sets. That joins most of a bucket, however large, with as many comparisons as it has members.
3. Members that this leaves outside of the bucket's largest component are compared with one of its members, HUBS times,
   and those still outside with the whole bucket, in blocks: by signature, then by their rarest shingles,
   of which linked documents share a known part, and what passes on the full sets. So no link
   between members of a bucket is missed, and pairs within one component, which could add nothing, aren't made.
4. Components of all links are found by alternating large-star and small-star. Classes of one doc_id are linked besides;
   a component's smallest doc_id is taken at the end.

A bucket may hold any share of the rows: its members carry the bucket's size, and by it are salted where they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import per_row, read, small_batches, written
from tidemark.llm.components import components

BANDS, ROWS = 28, 4
MINIMA = BANDS * ROWS
SEED = 7
#: Words whose hashes a task remembers, and the longest of them.
MEMO_WORDS, MEMO_LENGTH = 250_000, 64
HUBS = 1
#: Members of a bucket that are compared with as many others at once.
BLOCK = 1024
UNIT = 4 * BLOCK
#: Keys of at most so many bytes, at so many for each, are sent to every executor.
BROADCAST_BYTES, KEY_BYTES = 32_000_000, 96
#: Members of a bucket that are joined in one task.
SALT = 4096


class WordHashes(dict):
    """Hashes of words, of a task, and gone with it."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) > MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of size words, ascending; of fewer words the whole sequence is the one shingle.

    Only A-Z are lower-cased, and only ASCII white space parts words, as bytes.lower() and bytes.split() do.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for i in range(min(size, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1), rng.integers(0, 2**64, MINIMA, np.uint64)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of a * x + b mod 2**64, for each a and b."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(out, (a[:, None] * found[None, i : i + 2048] + b[:, None]).min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in signature.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def signed(size: int):
    a, b = coefficients()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text, size, hashes)
                signature = minima(found, a, b) if len(found) else None
                # 16 bits of each minimum tell whether two agree
                rows.append((len(found), *((None,) * 3 if signature is None else (digest(found), band_keys(signature).view(np.int64), (signature >> np.uint64(48)).astype("<u2").tobytes()))))
            made = pd.DataFrame(rows, columns=["n_shingles", "set_id", "bands", "signature"])
            yield pd.concat([batch[["doc_id", "row_key"]].reset_index(drop=True), made], axis=1)

    return run


SIGNED = "doc_id long, row_key long, n_shingles long, set_id binary, bands array<long>, signature binary"


def sets_of(size: int):
    """Sets of the rows whose set is the node's: a row_key is a hash, and may be another row's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(x, size, hashes) for x in batch["text"]]
            own = np.array([digest(x) == y for x, y in zip(found, batch["set_id"], strict=True)], bool)
            yield pd.DataFrame({"node": batch["node"], "shingles": [x.tobytes() for x in found]})[own]

    return run


def linked(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                same.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[np.array(same, bool), ["a", "b"]]

    return run


def sets_for(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, shingles binary, of the nodes that wanted (node) names; no other text is taken."""
    keys = nodes.select("node", "row_key", "set_id").join(wanted.select("node").distinct(), "node", "left_semi")
    keys = F.broadcast(keys) if keys.count() * KEY_BYTES <= BROADCAST_BYTES else keys
    texts = docs.join(keys, "row_key").select("node", "set_id", "text")
    return written(texts.mapInPandas(sets_of(size), "node long, shingles binary").dropDuplicates(["node"]), "sets")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that the full sets link."""
    sets = sets_for(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, docs, size)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInPandas(linked(percent), "a long, b long"), "links")


def as_longs(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"node": batch["node"], "s": [np.frombuffer(x, np.int64) for x in batch["shingles"]]})


def rarest(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """node, rare array<long>: the rarest of its shingles among those wanted, rarest first; a good part more than can differ from those of a linked document."""
    each = sets_for(wanted, nodes, docs, size).mapInPandas(per_row(as_longs), "node long, s array<long>").select("node", F.explode("s").alias("s"))
    times = each.groupBy("s").agg(F.count("*").alias("times"))
    sorted_ = each.join(times, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "s"))).alias("all"))
    n = F.size("all")
    first = F.slice("all", F.lit(1), (2 * (n - F.ceil(n * F.lit(percent) / F.lit(100))) + 2).cast("int"))
    return sorted_.select("node", F.transform(first, lambda x: x["s"]).alias("rare"))


def may_link(x: list[int], n_x: int, y: list[int], n_y: int, percent: int) -> bool:
    """Whether sets of n_x and n_y shingles, of which x and y are the first in one order, can have the common ones that a link takes.

    With c in common, the first n_x - c + k and the first n_y - c + k share k, for every k.
    """
    c = -(-percent * (n_x + n_y) // (100 + percent))
    k = min(len(x) - (n_x - c), len(y) - (n_y - c))
    return k <= 0 or len(set(x[: n_x - c + k]).intersection(y[: n_y - c + k])) >= k


def agreeing(percent: int):
    """Pairs of members of a bucket, of which the left ones stand in blocks, whose signatures agree in about that many minima or more.

    Of MINIMA minima, those of a pair at the least similarity agree in fewer with a probability of under 1e-7.
    """
    p = percent / 100
    least = int(MINIMA * p - 5.2 * (MINIMA * p * (1 - p)) ** 0.5)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        left = left.rename(columns=lambda x: x.removeprefix("left_"))
        right = right.sort_values("bucket", kind="stable", ignore_index=True)
        x, y = (np.frombuffer(b"".join(z["signature"]), "<u2").reshape(len(z), MINIMA) for z in (left, right))
        u, w = (np.stack(z["bands"].to_numpy()) for z in (left, right))
        c, d, p, q, nodes, buckets = left["component"].to_numpy(), right["component"].to_numpy(), left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy(), right["node"].to_numpy(), left["bucket"].to_numpy()
        first, end = (np.searchsorted(right["bucket"].to_numpy(), buckets, side) for side in ("left", "right"))
        a, b = [], []
        for i, node in enumerate(left["node"].to_numpy()):
            own = slice(first[i], end[i])
            at = first[i] + np.flatnonzero((c[i] != d[own]) & (100 * np.minimum(p[i], q[own]) >= percent * np.maximum(p[i], q[own])))
            if len(at):  # a pair that shares several buckets is made in the first of them alone
                at = at[u[i][(w[at] == u[i]).argmax(axis=1)] == buckets[i]]
            if len(at):
                at = at[(y[at] == x[i]).sum(axis=1) >= least]
            for k in at.tolist():
                if may_link(left["rare"].iat[i].tolist(), p[i], right["rare"].iat[k].tolist(), q[k], percent):
                    a.append(node)
                    b.append(nodes[k])
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def with_links(joined: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b): the components so far stand for the links so far."""
    if more.isEmpty():
        return joined
    return components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def largest_parts(known: DataFrame, turn: int) -> DataFrame:
    """Of each bucket of several components: n_open (members outside of the largest), most (that component) and hub (a member of it), for every salt."""
    inside = known.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.max_by("node", F.xxhash64("node", F.lit(turn))).alias("hub"))
    largest = inside.groupBy("bucket").agg(F.max(F.struct("m", "component", "hub")).alias("most"), F.sum("m").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    salts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SALT) - 1)
    return largest.select("bucket", (F.col("n") - F.col("most.m")).alias("n_open"), F.col("most.component").alias("most"), F.col("most.hub").alias("hub"), F.explode(salts).alias("salt"))


def links_of(docs: DataFrame, nodes: DataFrame, same_doc: DataFrame | None, size: int, percent: int) -> DataFrame:
    """node, component of the classes (node, row_key, set_id, n_shingles, bands, signature) that some link joins with another. same_doc: links besides."""
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SALT)).alias("salt")
    members = written(buckets.join(heads, "bucket").select("bucket", salt, "head", "n", "node"), "buckets")
    links = verify(members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), nodes, docs, size, percent)
    joined = components(links if same_doc is None else links.unionByName(same_doc))
    for turn in range(HUBS + 1):
        known = members.join(joined, "node", "left").select("bucket", "salt", "n", "node", F.coalesce("component", "node").alias("component"))
        known = known.join(largest_parts(known, turn), ["bucket", "salt"])
        known = written(known.select("bucket", "n", "n_open", "node", "component", "hub", (F.col("component") != F.col("most")).alias("open")), "known")
        if turn < HUBS:
            pairs = known.where("open").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
            joined = with_links(joined, verify(pairs, nodes, docs, size, percent))
    if known.isEmpty():
        return joined
    full = known.drop("hub").join(nodes.select("node", "n_shingles", "signature", "bands"), "node")
    full = written(full.join(rarest(known, nodes, docs, size, percent), "node"), "open")
    n_left, n_right = F.ceil(F.col("n_open") / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    spread = F.xxhash64("node")
    left = full.where("open").withColumn("i", F.pmod(spread, n_left)).withColumn("j", F.explode(F.sequence(F.lit(0), n_right - 1)))
    right = full.withColumn("j", F.pmod(spread, n_right)).withColumn("i", F.explode(F.sequence(F.lit(0), n_left - 1)))
    keep = ["node", "component", "n_shingles", "signature", "bands", "rare", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")]
    unit = F.pmod(F.xxhash64("bucket"), F.lit(max(1, full.count() // UNIT))).alias("unit")  # small buckets go together
    left, right = left.select(unit, "bucket", *keep), right.select(unit, "bucket", *keep)
    left = left.select([F.col(c).alias(f"left_{c}") for c in left.columns])
    pairs = left.groupBy("left_unit", "left_i", "left_j").cogroup(right.groupBy("unit", "i", "j")).applyInPandas(agreeing(percent), "a long, b long")
    pairs = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    return with_links(joined, verify(pairs, nodes, docs, size, percent))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles long, component_id long, kept boolean, for every row of docs (doc_id, text).

    Documents are linked if 100 * common shingles >= percent * shingles of both; component_id is the smallest doc_id
    that links reach, kept tells the document that stays. Documents without words are linked with nothing. Rows that
    repeat a doc_id are one document for this, whose links are those of all its texts; each row has its own n_shingles.
    A row without doc_id has a null component_id and is kept. No rows give no rows. Other columns are ignored. Texts are
    whole, of any length.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    small_batches(docs.sparkSession)
    found = written(docs.mapInPandas(signed(shingle_words), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    linkable = found.where("set_id is not null and doc_id is not null")
    classes = linkable.groupBy("set_id").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    firsts = linkable.join(classes.select("node"), linkable["row"] == F.col("node")).drop("row", "doc_id")
    of_doc = linkable.join(classes, "set_id").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("doc_id", "b")
    same_doc = None
    if not of_doc.isEmpty():
        same_doc = written(linkable.join(of_doc, "doc_id").join(classes, "set_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "same-doc")
    joined = links_of(docs, firsts, same_doc, shingle_words, percent)
    least = classes.join(joined, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    linked_classes = classes.join(joined, "node", "left").join(least, "component", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id"))
    out = linkable.join(linked_classes, "set_id").select("doc_id", "n_shingles", "component_id")
    rest = found.where("set_id is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2, percent=80)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS sh FROM d),
g AS (SELECT min(doc_id) AS node, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT node, n, unnest(sh) AS x FROM g),
p AS (
  SELECT a.node AS a, b.node AS b, a.n + b.n AS n, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node, node AS c FROM g UNION SELECT o.b, r.c FROM r JOIN both_ways o ON o.a = r.node),
m AS (SELECT node, min(c) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, s.doc_id = coalesce(m.component, s.doc_id) AS kept
FROM s LEFT JOIN g ON g.sh = s.sh LEFT JOIN m ON m.node = g.node"""
