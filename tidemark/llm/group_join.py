"""Jaccard join on word n-grams by a token-group matrix, exact whatever the groups are.

1. A document becomes the set of its word shingles, as 64-bit hashes; documents with equal sets are one class, told by a
   128-bit digest, of which one row goes on as its node. All shingles are counted in a sketch of CELLS counters, whose
   size is fixed; by it, then by hash, shingles have one order for all, roughly from rare to frequent.
2. Nodes are partitioned into groups of similar sets: each has KEYS minima of hashes, and goes by the one that most nodes
   have. Large groups are cut by hash, so that a group holds about GROUP nodes at most.
3. The matrix has a cell for a shingle and a group that a set's first shingles hold, in that order: all but a least
   overlap, and SHARED more, so that linked sets share SHARED of them. A set whose first shingles stand in fewer cells of
   a group than that, not counting cells of its own alone, has no link there. Of two groups the one of fewer nodes asks.
4. A query and a group that meet come to one task, where the group's matrix column is whole: the union of its members'
   shingles. If the union holds fewer of the query's shingles than a link takes, the group stays closed. Else it is
   opened: its members' full overlaps with the query are counted, and links are told exactly. Members of one group
   are compared likewise. Pairs that links of the task join already aren't looked at again.
5. Components of all links are found by alternating large-star and small-star.

Only components are asked for, so links that could add nothing aren't made; none between components is lost. Queries of
one group are dealt in blocks. A shingle that the sketch tells from others, by a count above the mean of a counter, comes
last in the order, so what very many documents share is in few of their first shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, small_batches, written
from tidemark.llm.components import components
from tidemark.llm.near_dedup import WordHashes, digest, sets_for, shingles

#: Hashes whose minima may name a group, and nodes of a group.
KEYS, GROUP = 4, 256
#: Counters of the sketch, of which PAGE make a row.
CELLS, PAGE = 1 << 20, 1 << 16
#: Queries of a group that go to one task; members that come to one task, of as many groups as it takes.
BLOCK, UNIT = 1024, 2048
SEED = 12
#: First shingles that linked sets have in common.
SHARED = 10
#: Rows of a table of counters that are added up in one task at first.
FAN = 64

SIGNED = "doc_id string, row_key long, n_shingles long, set_id binary, keys array<long>, page int, counts binary"


def signed(size: int):
    """Documents with their sets' sizes, digests and keys; after them the task's pages of the sketch, as rows of their own."""
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 2**64, KEYS, np.uint64) | np.uint64(1), rng.integers(0, 2**64, KEYS, np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, cells = WordHashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            rows = []
            for doc_id, key, text in batch.itertuples(index=False):
                found = shingles(text, size, hashes)
                if not len(found):
                    rows.append((doc_id, key, 0, None, None, None, None))
                    continue
                np.add.at(cells, cell_of(found), 1)
                keys = [int((a[i] * found + b[i]).min().view(np.int64)) for i in range(KEYS)]
                rows.append((doc_id, key, len(found), digest(found), keys, None, None))
            yield table(rows)
        yield table([(None, None, None, None, None, p, cells[p * PAGE : (p + 1) * PAGE].tobytes()) for p in range(CELLS // PAGE) if cells[p * PAGE : (p + 1) * PAGE].any()])

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "row_key", "n_shingles", "set_id", "keys", "page", "counts"], dtype=object)
        return out.astype({"row_key": "Int64", "n_shingles": "Int64", "page": "Int32"})

    return run


def cell_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(20)) & np.uint64(CELLS - 1)


def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a page of the sum of its counters."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, counts in zip(batch["page"], batch["counts"], strict=True):
            x = np.frombuffer(counts, np.int64)
            sums[page] = sums[page] + x if page in sums else x
    yield pd.DataFrame({"page": list(sums), "counts": [x.tobytes() for x in sums.values()]})


def sketch_of(pages: DataFrame) -> DataFrame:
    """One row: the whole sketch (8 * CELLS bytes), of pages (page, counts) that tasks have written; in two steps, so that no task adds up those of all tasks."""
    schema = "page int, counts binary"
    some = pages.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(FAN))).repartition(FAN, "page", "salt").select("page", "counts").mapInPandas(added, schema)
    return some.repartition(CELLS // PAGE, "page").mapInPandas(added, schema)


def first_shingles(sketch: np.ndarray, size: int, percent: int):
    """row_key, set_id, those shingles, first in the order, that linked sets have `shared` of in common, and shared.

    Of n shingles any linked set has at least c = percent * n in common, and so has at least percent * n shingles itself. The
    first k that both have in common are among the first n - c + k of either, for any k up to c. A set takes them for k up to
    SHARED, and asks for as many as the least linked set has taken them for.
    """
    part = lambda n: -(-percent * n // 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for key, text in zip(batch["row_key"], batch["text"], strict=True):
                found = shingles(text, size, hashes)
                if len(found):
                    c = part(len(found))
                    # sets are ascending, and the sort is stable: ties by hash
                    first = found[np.argsort(sketch[cell_of(found)], kind="stable")[: len(found) - c + min(SHARED, c)]]
                    rows.append((key, digest(found), first.view(np.int64), min(SHARED, part(c))))
            yield pd.DataFrame(rows, columns=["row_key", "set_id", "first", "shared"])

    return run


def grouped(nodes: DataFrame) -> DataFrame:
    """node, group of nodes (node, keys): by the key that most nodes have. Groups are cut by hash; those of fewer nodes have smaller numbers."""
    each = nodes.select("node", F.explode("keys").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("n"))
    best = each.join(often, "key").groupBy("node").agg(F.max(F.struct("n", "key")).alias("k")).select("node", "k.*")
    parts = F.ceil(F.col("n") / GROUP)
    hashed = F.xxhash64("key", F.pmod(F.xxhash64("node"), parts)).bitwiseAND(F.lit(2**48 - 1))
    return best.select("node", (F.ceil(F.col("n") / parts) * 2**48 + hashed).alias("group"))


def joined(percent: int):
    """Links (a, b) of queries (unit, i, group, node, shingles) with the members of the groups that they ask."""

    def root(of: dict[int, int], x: int) -> int:
        while of.setdefault(x, x) != x:
            of[x] = x = of[of[x]]
        return x

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        asked = dict(iter(left.groupby("left_group", sort=False))) if len(left) else {}
        of: dict[int, int] = {}
        for group, members in right.groupby("group", sort=False) if asked else ():
            queries = asked.get(group)
            if queries is None:
                continue
            nodes, sets = members["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in members["shingles"]]
            sizes = np.array([len(x) for x in sets])
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens, kind="stable")
            union, starts = np.unique(tokens[order], return_index=True)  # the group's column
            ends, owner = np.append(starts[1:], len(tokens)), owner[order]
            for node, text in zip(queries["left_node"], queries["left_shingles"], strict=True):
                query = np.frombuffer(text, np.uint64)
                n = len(query)
                mine = root(of, node)
                fits = (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)) & (nodes != node)
                fits[fits] = [root(of, x) != mine for x in nodes[fits].tolist()]
                if not fits.any():
                    continue
                at = np.minimum(np.searchsorted(union, query), len(union) - 1)
                at = at[union[at] == query]
                if 100 * len(at) < percent * n:  # the bound: the group stays closed
                    continue
                spans = ends[at] - starts[at]
                held = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                both = np.bincount(owner[held], minlength=len(sets))
                for k in np.flatnonzero(fits & (100 * both >= percent * (n + sizes - both))).tolist():
                    a, b = root(of, node), root(of, int(nodes[k]))
                    if a != b:
                        of[a] = b
                        links.append((node, int(nodes[k])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def links_of(docs: DataFrame, nodes: DataFrame, sketch: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join all nodes (node, row_key, set_id, keys) which links of all pairs join."""
    counts = np.zeros(CELLS, np.int64)
    for page, x in sketch.toLocalIterator():  # CELLS counters, whatever the input
        counts[page * PAGE : (page + 1) * PAGE] = np.frombuffer(x, np.int64)
    counts = counts.astype(np.float32)
    nodes = written(nodes.select("node", "row_key", "set_id").join(grouped(nodes), "node"), "groups")
    first = docs.select("row_key", "text").mapInPandas(first_shingles(counts, size, percent), "row_key long, set_id binary, first array<long>, shared int")
    first = written(first.dropDuplicates(["row_key", "set_id"]).join(nodes, ["row_key", "set_id"]).select("node", "group", "first", "shared"), "first-shingles")
    cells = first.select(F.explode("first").alias("token"), "node", "group", "shared").repartition("token")
    column = cells.groupBy("token", F.col("group").alias("asked")).agg(F.count("*").alias("holders"))
    met = cells.join(column, "token").where("group <> asked or holders > 1").groupBy("node", "group", "asked", "shared").agg(F.count("*").alias("n"))
    met = written(met.where("n >= shared").select("node", "group", "asked"), "met")
    asks = met.where("group <= asked").select("node", F.col("asked").alias("group"))
    asked = written(asks.groupBy("group").agg(F.count("*").alias("n")), "asked")
    # who is linked with a set of a group meets that group, so only sets that meet some are compared
    members = written(met.select("node", "group").distinct().join(asked, "group").select("node", "group", "n"), "members")
    sets = sets_for(asks.select("node").unionByName(members.select("node")), nodes, docs, size)
    units = max(1, (asks.count() + members.count()) // UNIT)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    unit = F.pmod(F.xxhash64("group"), F.lit(units))
    left = asks.join(asked, "group").join(sets, "node").select(unit.alias("left_unit"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("left_i"), F.col("group").alias("left_group"), F.col("node").alias("left_node"), F.col("shingles").alias("left_shingles"))
    right = members.join(sets, "node").select(unit.alias("unit"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), "group", "node", "shingles")
    found = left.groupBy("left_unit", "left_i").cogroup(right.groupBy("unit", "i")).applyInPandas(joined(percent), "a long, b long")
    return written(found, "links")


def jaccard_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles long, component_id long, for every row of docs (doc_id, text).

    Documents are linked if 100 * common shingles >= percent * shingles of both; component_id is the smallest doc_id that
    links reach, itself included. Documents without words are linked with nothing. Rows that repeat a doc_id are one
    document for this, whose links are those of all its texts; each row has its own n_shingles. A row without doc_id has
    a null component_id. No rows give no rows. Other columns are ignored. Texts are whole, of any length.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    small_batches(docs.sparkSession)
    # ids go as text, as pandas has no longs with nulls
    both = written(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "row_key", "text").mapInPandas(signed(shingle_words), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    found = both.where("page is null").select(F.col("doc_id").cast("long").alias("doc_id"), "row_key", "n_shingles", "set_id", "keys", "row")
    linkable = found.where("set_id is not null and doc_id is not null")
    classes = written(linkable.groupBy("set_id").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = written(linkable.join(classes.select("node"), linkable["row"] == F.col("node")).select("node", "row_key", "set_id", "keys"), "nodes")
    links = links_of(docs, nodes, sketch_of(both.where("page is not null").select("page", "counts")), shingle_words, percent)
    of_doc = linkable.join(classes, "set_id").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("doc_id", "b")
    same_doc = linkable.join(of_doc, "doc_id").join(classes, "set_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    reached = components(links.unionByName(same_doc))
    least = classes.join(reached, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = classes.join(reached, "node", "left").join(least, "component", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id"))
    out = linkable.join(of_class, "set_id").select("doc_id", "n_shingles", "component_id")
    rest = found.where("set_id is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def op12_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), shingle_words=3, percent=90)


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS sh FROM d),
g AS (SELECT min(doc_id) AS node, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT node, n, unnest(sh) AS x FROM g),
p AS (
  SELECT a.node AS a, b.node AS b, a.n + b.n AS n, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node, node AS c FROM g UNION SELECT o.b, r.c FROM r JOIN both_ways o ON o.a = r.node),
m AS (SELECT node, min(c) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id
FROM s LEFT JOIN g ON g.sh = s.sh LEFT JOIN m ON m.node = g.node"""
