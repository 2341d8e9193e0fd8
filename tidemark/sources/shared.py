"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the checkpoint folder set on its context; a temporary folder only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    """path, its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table, read again: what follows sees the same values however often it reads them, and a lost executor costs a re-read.

    by: a column by which rows are bucketed, and others in whose order they stand in a bucket. Windows, aggregations and
    joins by the first column then need no exchange. A bucket is one file; there are as many as shuffle partitions. A frame
    with an attribute placed, as placed() gives it, has its rows in as many tasks as that says, a bucket each, and isn't shuffled.
    """
    spark, key = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}-{key}"
    if by:
        n, table = getattr(df, "placed", None), f"{name.replace('-', '_')}_{key}"
        if n is None:
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.repartition(n, by[0])
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, by[0]).sortBy(*by).format("parquet").saveAsTable(table)
        out = spark.table(table)
        out.table_name, out.buckets = table, n
    else:
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def stable(df: DataFrame, name: str) -> DataFrame:
    """df where written() gave it, otherwise as a table: for what reads it several times."""
    return df if hasattr(df, "written_to") else written(df, name)


def placed(df: DataFrame, n: int | None) -> DataFrame:
    """df, whose rows were dealt to n tasks by the column by which written() will bucket them, and weren't moved since; n None: they weren't dealt."""
    if n is not None:
        df.placed = n
    return df


def drop(*tables: DataFrame) -> None:
    """Deletes what written() made of tables, which no frame may read any more. Other frames are left alone."""
    for x in tables:
        path = getattr(x, "written_to", None)
        if path:
            if hasattr(x, "table_name"):
                x.sparkSession.sql(f"DROP TABLE IF EXISTS {x.table_name}")
            where, fs = _at(x.sparkSession, path)
            fs.delete(where, True)


#: Derived tables of a session: by application, data and name, the state of their sources and the table.
_KEPT: dict[tuple[str, str, str], tuple[list, DataFrame]] = {}
#: Seconds that each derived table took when it was last made, with those that it needed.
MADE: dict[str, float] = {}


def _state(spark: SparkSession, paths: list[str]) -> list:
    """Name, bytes and time of change of every file of each source: a file, or a folder of files."""
    found = []
    for x in paths:
        where, fs = _at(spark, x)
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def kept(spark: SparkSession, sf_dir: str, name: str, sources: list[str], make, by: tuple[str, ...] = ()) -> DataFrame:
    """make(), written once in a session for all queries that read it, and again when its sources (tables in sf_dir) have changed; the older one is deleted then. by: as for written()."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state(spark, [f"{sf_dir}/{x}.parquet" for x in sources])
    known, table = _KEPT.get(key, (None, None))
    if table is not None and known == state and exists(spark, table.written_to):
        return table
    began = time.monotonic()
    _KEPT[key] = state, written(make(), name, by)
    MADE[name] = time.monotonic() - began
    if table is not None:
        drop(table)
    return _KEPT[key][1]
