"""Removal of repeated runs of lines, by a suffix array over line ids that distributed prefix doubling builds.

The corpus is read as sequences of line ids, one per document; blank lines don't count. Lines that occur once end every
repeated run, so only stretches of the others are kept, and of these the ones that have min_words words.

1. Prefix doubling. Rank 0 of a position is that of its line in sorted order. Rank k + 1 is that of the pair (rank k
   here, rank k 2**k lines on): the order of suffixes by their first 2**(k+1) lines.
2. The suffix array is the positions in order of the last rank, dealt by ranges of it. The common prefix of two
   neighbours is counted in lines. A suffix is compared as far as a run must go: until the lines after its first have
   min_words words, or all lines together have. So no comparison is longer than min_words lines, whatever the input.
3. Where neighbours have l lines in common, they are of one interval of the array. A position that isn't the earliest
   of its interval, in order of doc_id, text and line, starts a copy of l lines; the largest l counts. Of an interval
   that goes over several ranges, the earliest position is told by sums over ranges: no task holds an interval.
4. Copies of min_words words go. A longer repeated run is the union of the copies that start at its lines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop, read, written

MIN_WORDS = 50
#: Suffixes in a range of the array.
RANGE_ROWS = 100_000
NEVER = np.iinfo(np.int64).max


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, seq (among lines that aren't blank), line_no, line_id, n_words."""
    split = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), F.trim(F.regexp_replace(x, r"\s+", " ")).alias("line")))
    lines = docs.select("doc_id", "text_id", F.posexplode(F.filter(split, lambda s: s["line"] != "")).alias("seq", "s"))
    n_words = F.length("s.line") - F.length(F.translate("s.line", " ", "")) + 1
    return lines.select("doc_id", "text_id", "seq", F.col("s.line_no").alias("line_no"), F.unhex(F.md5("s.line")).alias("line_id"), n_words.alias("n_words"))


def numbered(groups: DataFrame, name: str) -> DataFrame:
    """Distinct groups, numbered in sorted order (with gaps). To be read once: what it's joined into is written."""
    return groups.orderBy(*groups.columns).withColumn(name, F.monotonically_increasing_id())


def reach(words: Column, min_words: int) -> Column:
    """How many of words (of the lines from here on, in order) a suffix is compared by; null if all don't make min_words."""
    start = F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("later"), F.lit(0).alias("n"))

    def add(a: Column, x: Column) -> Column:
        later = a["later"] + F.when(a["n"] > 0, x).otherwise(0)
        more = (a["n"] == 0) | (later < min_words) | (a["all"] < min_words)
        return F.when(more & (a["later"] < NEVER // 2), F.struct((a["all"] + x).alias("all"), later.alias("later"), (a["n"] + 1).alias("n"))).otherwise(F.struct(a["all"].alias("all"), F.lit(NEVER // 2).alias("later"), a["n"].alias("n")))

    return F.aggregate(words, start, add, lambda a: F.when(a["all"] >= min_words, a["n"]))


def shortest(words: Column, min_words: int) -> Column:
    """How many of words make min_words."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    add = lambda a, x: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")))
    return F.aggregate(words, start, add, lambda a: a["n"])


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """lines that are repeated, with rank0 and run, of stretches that have min_words words."""
    repeated = numbered(lines.groupBy("line_id").count().where("count > 1").select("line_id"), "rank0")
    doc = Window.partitionBy("doc_id", "text_id")
    found = lines.join(repeated, "line_id").drop("line_id")
    found = found.withColumn("run", F.col("seq") - F.row_number().over(doc.orderBy("seq")))
    whole = Window.partitionBy("doc_id", "text_id", "run")
    return found.withColumn("whole", F.sum("n_words").over(whole)).where(F.col("whole") >= min_words).drop("whole")


def suffixes(places: DataFrame, min_words: int) -> DataFrame:
    """places with prefix (the rank0 of the lines that a suffix is compared by), and least (how many of them make min_words); null where none do."""
    ahead = Window.partitionBy("doc_id", "text_id", "run").orderBy("seq").rowsBetween(0, min_words)
    words, ranks = F.collect_list("n_words").over(ahead), F.collect_list("rank0").over(ahead)
    found = places.withColumns({"words": words, "ranks": ranks}).withColumn("n", reach(F.col("words"), min_words))
    found = found.withColumns({"prefix": F.when(F.col("n").isNotNull(), F.slice("ranks", F.lit(1), F.coalesce("n", F.lit(1)))), "least": F.when(F.col("n").isNotNull(), shortest(F.col("words"), min_words))})
    return found.drop("words", "ranks", "n")


def suffix_array(places: DataFrame) -> DataFrame:
    """doc_id, text_id, seq, prefix, least, pos (a number in order of doc_id, text and line) and part (ranges in order of the suffixes)."""
    doc = Window.partitionBy("doc_id", "text_id", "run").orderBy("seq")
    longest = places.where("prefix is not null").agg(F.max(F.size("prefix"))).first()[0] or 1
    ranked = places.select("doc_id", "text_id", "run", "seq", F.col("rank0").alias("rank"))
    for k in range(math.ceil(math.log2(longest))):  # at most log2(min_words) + 1 rounds
        pairs = ranked.withColumn("later", F.coalesce(F.lead("rank", 2**k).over(doc), F.lit(-1).cast("long")))
        ranks = numbered(pairs.select("rank", "later").distinct(), "next")
        last, ranked = ranked, written(pairs.join(ranks, ["rank", "later"]).select("doc_id", "text_id", "run", "seq", F.col("next").alias("rank")), "ranks")
        drop(last)
    ranked = ranked.select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), F.col("seq").alias("s"), "rank")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_id") == F.col("t")) & (F.col("seq") == F.col("s"))
    found = places.where("prefix is not null").join(ranked, on).select("doc_id", "text_id", "seq", "prefix", "least", "rank")
    found = written(found.orderBy(F.asc_nulls_first("doc_id"), "text_id", "seq").withColumn("pos", F.monotonically_increasing_id()), "suffixes")
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(found.count() / RANGE_ROWS))
    return written(found.repartitionByRange(parts, "rank", "pos").withColumn("part", F.spark_partition_id().cast("long")), "array")


def in_order(own: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A range in order; the prefixes as rows of one matrix (-1 and -2 past the end); lines in common with the row before (the first: 0)."""
    own = own.sort_values(["rank", "pos"], ignore_index=True)
    size = own["prefix"].map(len).to_numpy()
    lines = np.full((len(own), size.max(initial=1)), -1, np.int64)
    lines[np.arange(lines.shape[1]) < size[:, None]] = np.concatenate(own["prefix"].to_list())
    same = np.cumprod((lines[1:] == lines[:-1]) & (lines[1:] >= 0), axis=1).sum(axis=1)
    return own, lines, np.concatenate([[0], same]).astype(np.int64)


def summed(levels: int):
    """A range's first and last prefix, and for each number of lines l: the earliest position of the rows joined with the first, with the last, and whether all are joined."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own, _, common = in_order(own)
        pos = own["pos"].to_numpy()
        left, right, whole = [], [], []
        for level in range(1, levels + 1):
            cuts = np.flatnonzero(common[1:] < level) + 1
            left.append(pos[: cuts[0]].min() if len(cuts) else pos.min())
            right.append(pos[cuts[-1] :].min() if len(cuts) else pos.min())
            whole.append(not len(cuts))
        return pd.DataFrame({"part": own["part"][:1], "first": [own["prefix"].iat[0]], "last": [own["prefix"].iat[-1]], "left": [left], "right": [right], "whole": [whole]})

    return run


def beyond(array: DataFrame, levels: int) -> DataFrame:
    """part, before, after: for each number of lines the earliest position that a range's first row, and its last, is joined with in other ranges (NEVER: none)."""
    sums = array.groupBy("part").applyInPandas(summed(levels), "part long, first array<long>, last array<long>, left array<long>, right array<long>, whole array<boolean>")
    sums = written(sums, "ranges")  # a row for each range
    # only the numbers of ranges meet in one place; the prefixes come to their neighbour's by its number
    neighbours = sums.select("part").withColumn("earlier", F.lag("part").over(Window.orderBy("part")))
    sums = sums.join(neighbours, "part").join(sums.select(F.col("part").alias("earlier"), F.col("last").alias("was")), "earlier", "left").drop("earlier")
    agree = F.transform(F.arrays_zip("first", "was"), lambda x: x["first"] == x["was"])
    common = F.coalesce(F.array_position(F.transform(agree, lambda x: ~F.coalesce(x, F.lit(False))), True) - 1, F.lit(0))
    common = F.when(F.col("was").isNull(), 0).when(common < 0, F.size("first")).otherwise(common)
    sums = sums.withColumn("common", common.cast("int"))
    each = sums.select("part", "common", F.posexplode(F.arrays_zip("left", "right", "whole")).alias("level", "x")).select("part", (F.col("level") + 1).alias("level"), "common", "x.*")
    by_level = Window.partitionBy("level").orderBy("part")
    each = each.withColumns({"joined": F.col("common") >= F.col("level"), "joins": F.coalesce(F.lead("common").over(by_level) >= F.col("level"), F.lit(False))})
    # ranges through which an interval goes from end to end hand on what was before them
    backward = Window.partitionBy("level").orderBy(F.desc("part"))
    each = each.withColumns({"chain": F.sum((~(F.col("whole") & F.col("joined"))).cast("int")).over(by_level), "chain_back": F.sum((~(F.col("whole") & F.col("joins"))).cast("int")).over(backward)})
    each = each.withColumns({"so_far": F.min("right").over(Window.partitionBy("level", "chain").orderBy("part")), "from_here": F.min("left").over(Window.partitionBy("level", "chain_back").orderBy(F.desc("part")))})
    never = F.lit(int(NEVER))
    before, after = F.when(F.col("joined"), F.lag("so_far").over(by_level)), F.when(F.col("joins"), F.lead("from_here").over(by_level))
    each = each.select("part", "level", F.coalesce(before, never).alias("before"), F.coalesce(after, never).alias("after"))
    found = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("level", "before", "after"))).alias("x"))
    return found.select(F.col("part").alias("of_part"), F.col("x.before").alias("before"), F.col("x.after").alias("after"))


def copies_in(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
    """doc_id, text_id, first, n: what a range's rows, with what they are joined with in other ranges, repeat of earlier positions."""
    own, _, common = in_order(own)
    pos, longest = own["pos"].to_numpy(), np.zeros(len(own), np.int64)
    before, after = (np.asarray(other[c].iat[0], np.int64) for c in ("before", "after"))
    for level in range(1, len(before) + 1):
        starts = np.concatenate([[0], np.flatnonzero(common[1:] < level) + 1])
        earliest = np.minimum.reduceat(pos, starts)
        earliest[0] = min(earliest[0], before[level - 1])
        earliest[-1] = min(earliest[-1], after[level - 1])
        sizes = np.diff(np.append(starts, len(pos)))
        longest[np.repeat(earliest, sizes) < pos] = level
    least = own["least"].to_numpy()
    return own.assign(first=own["seq"], n=longest.astype("int32")).loc[longest >= least, ["doc_id", "text_id", "first", "n"]]


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_id, gone (array of line numbers) of the documents that hold later copies. docs: doc_id, text_id, text."""
    lines = written(lines_of(docs), "lines")
    places = written(suffixes(stretches(lines, min_words), min_words), "places")
    array = suffix_array(places)
    levels = array.agg(F.max(F.size("prefix"))).first()[0] or 1
    found = array.groupBy("part").cogroup(beyond(array, levels).groupBy("of_part")).applyInPandas(copies_in, "doc_id long, text_id binary, first int, n int")
    key = ["doc_id", "text_id"]
    gone = found.select(*key, F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("seq")).distinct()
    numbers = places.select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), F.col("seq").alias("s"), "line_no")
    gone = gone.join(numbers, gone["doc_id"].eqNullSafe(numbers["d"]) & (gone["text_id"] == numbers["t"]) & (gone["seq"] == numbers["s"]))
    out = written(gone.groupBy(*key).agg(F.collect_list("line_no").alias("gone")), "gone")
    drop(lines, places, array)
    return out


def once(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text_id, text), with those that repeat doc_id and text_id once. Only texts of these are shuffled."""
    again = docs.groupBy(F.col("doc_id").alias("d"), F.col("text_id").alias("t")).count().where("count > 1").drop("count")
    if again.isEmpty():
        return docs
    on = docs["doc_id"].eqNullSafe(again["d"]) & (docs["text_id"] == again["t"])
    return docs.join(again, on, "left_anti").unionByName(docs.join(again, on, "left_semi").dropDuplicates(["doc_id", "text_id"]))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, counted: str = "n_removed") -> DataFrame:
    """docs (doc_id, text, ...) without later copies of repeated runs of lines, and with a column, named by counted: the lines that went.

    Lines are compared with runs of white space as one space; blank lines are neither compared nor removed. The earliest
    copy, in order of doc_id (null first), text and line, stays; of copies that overlap the later lines go. Runs of under
    min_words words stay, and every first occurrence of a line does. Null and empty texts stay as they are. Rows that
    repeat both doc_id and text are one document and have one result. Texts are whole, of any length. No rows give no
    rows. Other columns stay as they are, but for one that is named as counted says.
    """
    # the columns of docs travel as one, so that none clashes with those made here
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").cast("long").alias("own_id"), F.unhex(F.md5("text")).alias("own_text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_id", F.unhex(F.md5("text")))
    # by a shuffle at every size: what goes may be any share of the lines
    gone = repeated_lines(once(plain), min_words).select("doc_id", "text_id", "gone").hint("merge")
    out = keyed.join(gone, keyed["own_id"].eqNullSafe(gone["doc_id"]) & (keyed["own_text"] == gone["text_id"]), "left")
    kept = F.array_join(F.filter(F.split("d.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(kept)
    n = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return out.select(*[text.alias(c) if c == "text" else F.col("d")[c].alias(c) for c in docs.columns if c != counted], n.alias(counted))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "text")


OP10_SQL = r"""
WITH raws AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
named AS (SELECT doc_id, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM raws),
lines AS (
  SELECT *, row_number() OVER w AS seq, sum(length(line) - length(replace(line, ' ', '')) + 1) OVER w AS cum, length(line) - length(replace(line, ' ', '')) + 1 AS n
  FROM named WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
whole AS (SELECT doc_id, list(line ORDER BY seq) AS all_lines, list(line_no ORDER BY seq) AS numbers FROM lines GROUP BY doc_id),
ahead AS (SELECT s.doc_id, s.seq AS first, min(e.seq) AS last FROM lines s JOIN lines e ON e.doc_id = s.doc_id AND e.seq >= s.seq AND e.cum >= s.cum - s.n + 50 GROUP BY 1, 2),
back AS (SELECT e.doc_id, max(s.seq) AS first, e.seq AS last FROM lines e JOIN lines s ON e.doc_id = s.doc_id AND s.seq <= e.seq AND e.cum - s.cum + s.n >= 50 GROUP BY e.doc_id, e.seq),
windows AS (SELECT doc_id, first, last, md5(array_to_string(all_lines[first:last], chr(10))) AS k FROM (FROM ahead UNION FROM back) JOIN whole USING (doc_id)),
copies AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, first) AS nth FROM windows),
gone AS (SELECT DISTINCT c.doc_id, numbers[i] AS line_no FROM (SELECT doc_id, unnest(range(first, last + 1)) AS i FROM copies WHERE nth > 1) c JOIN whole USING (doc_id)),
left_over AS (SELECT doc_id, count(g.line_no) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (g.line_no IS NULL), '') AS text
  FROM raws LEFT JOIN gone g USING (doc_id, line_no) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, l.text FROM documents d LEFT JOIN left_over l USING (doc_id)"""
