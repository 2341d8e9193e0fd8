"""Tables with a key that change in place: rows stand in folders by a hash of their key, and a change rewrites only the folders that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark.sources.shared import drop, exists, written

#: The column that names a row's folder.
BUCKET = "key_bucket"


class KeyedTable:
    """Rows of schema below path, with keys as their key, in as many folders as buckets says (so many at least that one is a few files).

    One writer at a time; readers may go on with what they have listed. A change is first computed and written aside, then
    its folders replace the old ones. Should that break off midway some folders are changed and others aren't: changes that
    give the same when they are made again (all of operators.merge) are simply made again. A change may add and alter rows;
    a folder of which it leaves no row keeps its old rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, IntegerType())).parquet(self.path)

    def read(self) -> DataFrame:
        """All rows; none before the first change."""
        return self._stored().drop(BUCKET) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)

    def change(self, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Makes merged(rows, changes) of the rows whose folders the keys of changes name. Rows elsewhere aren't read."""
        changes = written(changes, "changes")
        if exists(self.spark, self.path):
            touched = [r[0] for r in changes.select(self._bucket()).distinct().collect()]  # at most as many as buckets
            old = self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        else:
            old = self.spark.createDataFrame([], self.schema)
        new = written(merged(old, changes).select(*self.schema.names).withColumn(BUCKET, self._bucket()), "changed")
        new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(BUCKET).parquet(self.path)
        drop(new, changes)
