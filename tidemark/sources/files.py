"""CSV files, one for each key: scans with the key from the file's name, exports, checks of columns."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import and_, itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources import shared

#: What a file of bars must have, and what it becomes.
MARKET_COLUMNS = ["date", "ticker", "open", "high", "low", "close", "volume", "norm_bias_score"]
MARKET_NAMES = {"norm_bias_score": "bias_index"}
PRICE_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Volume"]
#: An export's files lie in so many folders, by a hash of their name: some for each, where there are very many, and few to list.
FOLDERS = 256
#: What a file's name has as %XX, as Spark writes it in a partition's folder, and the name of a key without text, as there.
ESCAPED, NO_KEY = re.compile(r"""[\x00-\x1f"#%'*+/:=?\\\x7f{\[\]^]"""), "__HIVE_DEFAULT_PARTITION__"


def lacking(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def unique_columns(df: DataFrame) -> DataFrame:
    """df without columns that repeat a name: the first of each stays."""
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    first = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    return numbered.select(*[F.col(f"c{i}").alias(c) for c, i in sorted(first.items(), key=lambda x: x[1])])


def decoded(x: Column) -> Column:
    """x without its %XX; a plus stays one."""
    return F.when(F.contains(x, F.lit("%")), F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))).otherwise(x)


def key_of(path: Column, key: str) -> Column:
    """The key in a file's path: of its folder or name key=value, where it is escaped, or else its name without .csv."""
    end = r"(?:\.csv)?(?:\.gz)?$"
    escaped, name = F.regexp_extract(path, rf"/{key}=([^/]+(?=/[^/]*$)|[^/]+?(?={end}))", 1), F.regexp_extract(path, rf"([^/]*?){end}", 1)
    # a list of one, so that the path is looked at once for each row
    return F.transform(F.array(escaped), lambda x: F.when(x != "", decoded(decoded(x))).otherwise(decoded(name)))[0]


def scan(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """All CSV files below folder as one table, with the file's name (without .csv) as the column key.

    A file of an export is named key=value, or by its folder, as partitioned writes name it.
    """
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").csv(folder)
    return rows.withColumn(key, key_of(F.col("_metadata.file_path"), key))


def complete_keys(spark: SparkSession, folder: str, columns: list[str], key: str) -> DataFrame:
    """key of those CSV files below folder, laid out as for scan(), whose first line names all columns; of a key with several files, all must."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth")).where("start = 0")
    names = F.transform(F.split("value", ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    whole = F.forall(F.array(*map(F.lit, columns)), lambda c: F.array_contains(names, c))
    likely = reduce(and_, [F.contains("value", F.lit(c)) for c in columns])  # so that few lines are split
    heads = lines.groupBy("path").agg(F.min("nth").alias("first"), F.min(F.when(likely & whole, F.col("nth"))).alias("named"))
    return heads.groupBy(key_of(F.col("path"), key).alias(key)).agg(F.every(F.coalesce(F.col("first") == F.col("named"), F.lit(False))).alias("whole")).where("whole").select(key)


def _files_of(at: str, key: str, head: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes head and lines of rows (value, line), which come in order of value, as at/folder/key=value.csv, and tells how many files.

    A file gets its name when it is whole, and a repeated try puts the same file in its place. One file is open at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, n = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), 0
        for value, own in groupby(lines, itemgetter(0)):
            name = f"{key}={ESCAPED.sub(lambda x: f'%{ord(x[0]):02X}', value)}.csv"
            folder = f"{at}/{zlib.crc32(name.encode()) % FOLDERS:03d}"
            os.makedirs(folder, exist_ok=True)
            half = f"{folder}/.{uuid.uuid4().hex}"
            with open(half, "wb") as f:
                f.write(head)
                f.writelines(line + b"\n" for _, line in own)
            os.replace(half, f"{folder}/{name}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return run


def export_by_key(rows: DataFrame, key: str, folder: str) -> None:
    """A CSV file for each key, named key=value. Rows meet by key first, so that a key is one file; slashes in keys become underscores.

    On a file system that is mounted the tasks write the files themselves: Spark's writer starts a process for each, and
    leaves a folder for each, which takes as long again to list. Lines are made by Spark either way. On any other file
    system it is a partitioned write, of a folder for each key.
    """
    spark, columns = rows.sparkSession, [c for c in rows.columns if c != key]
    safe = rows.withColumn(key, X.file_name(F.col(key).cast("string")))
    where, fs = shared._at(spark, folder)
    if fs.getUri().getScheme() != "file":
        safe.repartition(key).write.mode("overwrite").option("header", True).partitionBy(key).csv(folder)
        return
    fs.delete(where, True)
    fs.mkdirs(where)
    line = lambda own: F.to_csv(F.struct(*own)).cast("binary")
    head = spark.range(1).select(line([F.lit(c).alias(c) for c in columns])).first()[0]
    dealt = safe.withColumn(key, F.when(F.col(key) != "", F.col(key)).otherwise(NO_KEY)).repartition(key).sortWithinPartitions(key)
    named = dealt.select(key, line([F.col(c) for c in columns]).alias("line"))
    named.mapInArrow(_files_of(fs.makeQualified(where).toUri().getPath(), key, bytes(head) + b"\n"), "n long").agg(F.sum("n")).collect()


def export(rows: DataFrame, folder: str) -> None:
    """rows as CSV, for results that are small: one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def market_rows(rows: DataFrame) -> DataFrame | None:
    """Bars with their index under its short name, in the order of columns that exports have; None where a column lacks."""
    if lacking(rows, MARKET_COLUMNS):
        return None
    return rows.select(*[F.col(c).alias(MARKET_NAMES.get(c, c)) for c in MARKET_COLUMNS])


def price_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Downloaded prices: keys and the columns that count, each once, under short names, the date without time; rows without date go."""
    rows = unique_columns(rows)
    missing = lacking(rows, [*keys, *PRICE_COLUMNS])
    if missing:
        raise ValueError(f"prices lack {', '.join(missing)}")
    return rows.select(*keys, *[(F.to_date(c) if c == "Date" else F.col(c)).alias(c.lower()) for c in PRICE_COLUMNS]).where("date is not null")
