"""Prefix trie of conversations as burst tries.

1. A turn becomes an id, the MD5 of its role and text; a conversation the list of its turns' ids and lengths. Equal lists
   are one row, with the number and the smallest of its conversations and a digest of all of them.
2. All rows start in one container, whose head is the root. A container of more than its share of the rows is burst: its
   head becomes a node of its own, its rows go to containers by their next turn id. Rounds end when no container is too
   large. At most HEADS containers are too large in a round, whatever the number of rows, so their counts can be sent to all tasks.
3. The remaining containers are dealt to shards by their head, and sorted there by the ids that are left; one sweep over
   them makes all nodes below each head, with a stack of the nodes on the current path.
4. What the sweep finds below a burst head is summed by that head first, and then added to all heads on its path.

A turn, or a whole conversation, that a third of the table shares is burst like others, level by level, and counted once
for equal rows. A conversation's list is one row: 24 bytes or so for a turn. Rounds are as many as the turns that more
than a container's share of different conversations have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop, read, written

#: Conversations of each family of FAMILY ids may begin with up to MOST_TURNS - 1 turns of its first one.
FAMILY, MOST_TURNS = 5, 9
#: A container holds LEAST rows or one HEADS-th of all, whichever is more.
LEAST, HEADS = 1024, 50_000
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """The hex digits of an MD5 of both. The role's length keeps pairs of other cuts apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<id binary, size int>> of turns (conv_id, turn, role, text): in order of turn (null first), then role, then the turn's id.

    Null role or text is empty. Rows that are the same in all of that count each. Rows without conv_id belong to no
    conversation. size: bytes of the text in UTF-8. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), turn_id(role, text).alias("id"), F.octet_length(text).alias("size")).alias("t"))
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return found.select("conv_id", F.transform("t", lambda x: F.struct(F.unhex(x["id"]).alias("id"), x["size"].alias("size"))).alias("turns"))


def rebuilt(found: DataFrame) -> DataFrame:
    """found (conv_id, turns) with the first h turns of each family's first conversation in place of a conversation's own first h; h: its id's CRC-32 mod MOST_TURNS."""
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_TURNS).cast("int")
    first = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first")
    begun = found.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, MOST_TURNS - 1).alias("begun"))
    joined = found.select("conv_id", "turns", h.alias("h"), first).join(begun, "first", "left")
    none = F.slice("turns", 1, 0)
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).otherwise(none)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("begun", F.lit(1), F.col("h")), none), own).alias("turns"))


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, ends: SHA-256 of the ids of each path, joined by commas. Rows come in order of path, then id; a path may go over many batches."""
    path, running = None, None
    for batch in batches:
        done = []
        for key, ids in batch.groupby("path", sort=False)["conv_id"]:
            text = ",".join(map(str, ids.tolist())).encode()
            if key == path:
                running.update(b"," + text)
            else:
                if path is not None:
                    done.append((path, running.hexdigest()))
                path, running = key, hashlib.sha256(text)
        yield pd.DataFrame(done, columns=["path", "ends"])
    if path is not None:
        yield pd.DataFrame([(path, running.hexdigest())], columns=["path", "ends"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """ids array<binary>, sizes array<int>, n, least (smallest conv_id), ends of the different lists of convs (conv_id, turns)."""
    rows = convs.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))
    rows = written(rows.withColumn("path", F.md5(F.array_join(F.transform("ids", F.hex), ""))), "paths")
    one = rows.groupBy("path").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"))
    kept = rows.withColumnRenamed("conv_id", "least").join(one, ["path", "least"])
    ends = rows.select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id").mapInPandas(digests, "path string, ends string")
    return kept.join(ends, "path").select("ids", "sizes", "n", "least", "ends")


def burst(rows: DataFrame, least: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Containers (head, depth, size, parent, parent_conv, ids, sizes, n, least, ends) that are small enough, and the heads (head, depth, size, parent_conv, path, n, least, ends) of those that were burst."""
    columns = ["head", "depth", "size", "parent", "parent_conv", "path"]
    active = written(rows.select(F.lit("").alias("head"), F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("parent_conv"), F.array().cast("array<string>").alias("path"), "ids", "sizes", "n", "least", "ends"), "containers")
    most = max(1, least, active.count() // heads)
    small, burst_heads = None, None
    while True:
        end = F.max(F.when(F.size("ids") == 0, F.col("ends")))
        large = active.groupBy("head").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("least").alias("least"), end.alias("ends"), *[F.first(c).alias(c) for c in ("depth", "size", "parent_conv")], F.max("path").alias("path")).where(F.col("rows") > most)
        large = written(large.drop("rows"), "heads")
        keys = F.broadcast(large.select("head", F.col("least").alias("head_least")))  # heads rows at most
        done = active.join(keys, "head", "left_anti")
        small = done if small is None else small.unionByName(done)
        if large.isEmpty():
            return small, burst_heads
        burst_heads = large if burst_heads is None else burst_heads.unionByName(large)
        next_id = F.col("ids")[0]
        rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
        down = active.join(keys, "head").where(F.size("ids") > 0).select(
            F.md5(F.concat("head", F.hex(next_id))).alias("head"), (F.col("depth") + 1).alias("depth"), F.col("sizes")[0].alias("size"), F.col("head").alias("parent"), F.col("head_least").alias("parent_conv"),
            F.concat("path", F.array("head")).alias("path"), rest("ids").alias("ids"), rest("sizes").alias("sizes"), "n", "least", "ends",
        ).select(*columns, "ids", "sizes", "n", "least", "ends")
        active = written(down, "containers")


class Node:
    __slots__ = ("depth", "size", "n", "least", "ends", "children", "leaves", "saved", "below")

    def __init__(self, depth: int, size: int):
        self.depth, self.size, self.n, self.least, self.ends = depth, size, 0, None, NO_ENDS
        self.children = self.leaves = self.saved = 0
        self.below: list[tuple] = []  # children whose parent's smallest conversation isn't known yet

    def finished(self) -> tuple:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size
        return self.least, self.depth, self.n, self.children, self.leaves, self.saved, self.ends


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of containers, whose rows come in order of head, then ids. Of a container's own head the parent's key is told too."""
    out: list[tuple] = []
    stack: list[Node] = []
    head, top, before = None, (None, None), []

    def close(depth: int) -> None:
        """Ends the nodes of the current path below the first depth + 1 of the stack."""
        while len(stack) > depth + 1:
            child, up = stack.pop(), stack[-1]
            row = child.finished()
            up.n, up.leaves, up.saved, up.children = up.n + child.n, up.leaves + child.leaves, up.saved + child.saved, up.children + 1
            up.least = child.least if up.least is None else min(up.least, child.least)
            up.below.append(row)
            out.extend((*x[:2], child.least, *x[2:], None) for x in child.below)

    def end() -> None:
        close(0)
        row, own = stack[0].finished(), stack.pop()
        out.extend((*x[:2], own.least, *x[2:], None) for x in own.below)
        out.append((*row[:2], top[1], *row[2:], top[0]))

    def table() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent"])
        out.clear()
        return made.astype({"parent_conv_id": "Int64"})

    for batch in batches:
        for x in batch.itertuples(index=False):
            if x.head != head:
                if stack:
                    end()
                head, top, before = x.head, (x.parent, None if x.parent_conv is None else int(x.parent_conv)), []
                stack.append(Node(x.depth, x.size))
            ids, shared = list(x.ids), 0
            for a, b in zip(before, ids, strict=False):
                if a != b:
                    break
                shared += 1
            close(shared)
            for size in list(x.sizes)[shared:]:
                stack.append(Node(stack[-1].depth + 1, size))
            last = stack[-1]
            last.n, last.ends = last.n + x.n, x.ends
            last.least = x.least if last.least is None else min(last.least, x.least)
            before = ids
        yield table()
    if stack:
        end()
        yield table()


def trie(convs: DataFrame, least: int = LEAST, heads: int = HEADS) -> DataFrame:
    """A row of NODE for every node of the trie of convs (conv_id, turns array<struct<id binary, size int>>; conv_id is a key).

    conv_id: smallest member; the root has depth 0 and no parent. n_leaves and saved_tokens are of the whole subtree, the
    node included. No conversations give no nodes; a conversation without turns is a member of the root alone.
    """
    small, large = burst(distinct_sequences(convs), least, heads)
    # text, as pandas has no longs with nulls
    shards = small.select("head", "depth", "size", "parent", F.col("parent_conv").cast("string").alias("parent_conv"), "ids", "sizes", "n", "least", "ends").repartition("head").sortWithinPartitions("head", "ids")
    swept = shards.mapInPandas(sweep, f"{NODE}, parent string")
    if large is None:
        return swept.drop("parent")
    swept = written(swept, "nodes")
    below = swept.where("parent is not null").groupBy(F.col("parent").alias("head")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"))
    own = large.join(below, "head", "left")
    up = F.explode(F.concat("path", F.array("head"))).alias("head")
    saved = F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("size")
    totals = own.select(up, F.coalesce("leaves", F.lit(0)).alias("leaves"), saved.alias("saved")).groupBy("head").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    of_heads = large.where("size(path) > 0").groupBy(F.element_at("path", -1).alias("head")).agg(F.count("*").alias("children_heads"))
    nodes = own.join(totals, "head").join(of_heads, "head", "left").select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.coalesce("children", F.lit(0)) + F.coalesce("children_heads", F.lit(0))).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return swept.drop("parent").unionByName(nodes)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie(rebuilt(sequences(read(spark, sf_dir, "conversations"))))
    return nodes.withColumn("depth", F.col("depth").cast("long"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, list(struct_pack(id := md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), size := strlen(coalesce(text, '')))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS first, (4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 9 AS h FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(f.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN t f ON f.conv_id = h.first),
m AS (
  SELECT conv_id, len(turns) AS l, unnest(range(0, len(turns) + 1)) AS d, list_transform(turns, lambda x: x.id) AS ids, turns FROM r),
p AS (
  SELECT d, ids[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE turns[d].size END) AS size,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '') AS ends FROM m GROUP BY ALL),
c AS (
  SELECT p.*, u.conv_id AS parent, (SELECT count(*) FROM p k WHERE k.d = p.d + 1 AND k.p[1:p.d] = p.p) AS n_children FROM p LEFT JOIN p u ON u.d = p.d - 1 AND u.p = p.p[1:p.d - 1])
SELECT a.conv_id, a.d AS depth, a.parent AS parent_conv_id, a.n AS n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves,
  CAST(sum((b.n - 1) * b.size) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM c a JOIN c b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.conv_id, a.d, a.p, a.parent, a.n, a.n_children, a.ends"""
