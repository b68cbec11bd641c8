"""Keyed tables on storage that are changed in place, bucket by bucket.

A table is a Parquet folder with a partition per bucket of the key's hash.
A change reads and rewrites the buckets it touches and no others, by dynamic
partition overwrite: the new files are written apart and take the place of
the old ones when the job commits, so a job that fails before leaves the table as it
was. Reading the table is reading one snapshot, however many changes made it.
Every bucket is rewritten as a whole, so many small changes leave no small files.

All changes set rows to values, or delete them; none adds to a value. So a
change that is applied again, as a stream does after a failure, changes
nothing. One writer at a time: two concurrent changes of one bucket would lose one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import materialize

BUCKET = "bucket"


class StoredTable:
    """The table at ``path`` with one row per value of ``key`` (one or several columns, null being a value)."""

    def __init__(self, spark: SparkSession, path: str, key: str | list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.key = [key] if isinstance(key, str) else key
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names
        known = self._number_of_buckets()
        if known is None:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{self.path}/_about")
        elif known != buckets:
            raise ValueError(f"the table has {known} buckets, not {buckets}")

    def _files(self):
        """Spark's view of the folder's file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def _number_of_buckets(self) -> int | None:
        return self.spark.read.schema("buckets int").json(f"{self.path}/_about").first().buckets if self._exists("_about") else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        """All rows with their bucket."""
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/rows")
        return read.parquet(f"{self.path}/rows") if self._exists("rows") else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def _touched(self, buckets: DataFrame) -> list[int]:
        return sorted(r[0] for r in buckets.distinct().collect())  # at most as many as there are buckets

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        """Write ``rows`` (with bucket) as the whole content of the touched buckets."""
        out = rows.select(*self.columns, BUCKET).repartition(BUCKET)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        left = set(self._touched(self._stored().filter(F.col(BUCKET).isin(touched)).select(BUCKET))) if touched else set()
        filled = set(self._touched(rows.select(BUCKET))) if touched else set()
        for b in sorted(left - filled):  # an overwrite leaves a bucket alone that has no rows any more
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/{BUCKET}={b}"), True)

    def _key_equals(self, a: DataFrame, b: DataFrame) -> Column:
        same = F.lit(True)
        for k in self.key:
            same = same & a[k].eqNullSafe(b[k])
        return same

    def upsert(self, changes: DataFrame) -> None:
        """Rows of ``changes`` (the table's columns, one row per key) take the place of those with their key."""
        new = materialize(changes.select(*self.columns).withColumn(BUCKET, self.bucket()), "changes")
        touched = self._touched(new.select(BUCKET))
        if touched:
            old = self._stored().filter(F.col(BUCKET).isin(touched))
            kept = old.join(new, self._key_equals(old, new) & (old[BUCKET] == new[BUCKET]), "left_anti")
            self._replace(materialize(kept.unionByName(new), "merged"), touched)

    def update(self, changes: DataFrame, merge) -> None:
        """``merge(rows, changes)`` gives the new rows of the buckets whose keys ``changes`` holds; keys may repeat in ``changes``."""
        new = materialize(changes.withColumn(BUCKET, self.bucket()), "changes")
        touched = self._touched(new.select(BUCKET))
        if touched:
            old = self._stored().filter(F.col(BUCKET).isin(touched))
            out = merge(old.select(*self.columns), new.drop(BUCKET)).select(*self.columns).withColumn(BUCKET, self.bucket())
            self._replace(materialize(out, "merged"), touched)

    def delete(self, condition: Column | None = None, keys: DataFrame | None = None) -> None:
        """Delete the rows that fulfil ``condition`` or whose key is in ``keys``; buckets without such rows are not written."""
        stored = self._stored()
        gone = stored.filter(condition) if condition is not None else stored.join(keys.select(*self.key).distinct(), self.key, "left_semi")
        gone = materialize(gone.select(*self.key, BUCKET), "gone")
        touched = self._touched(gone.select(BUCKET))
        if touched:
            old = stored.filter(F.col(BUCKET).isin(touched))
            kept = old.join(gone, self._key_equals(old, gone) & (old[BUCKET] == gone[BUCKET]), "left_anti")
            self._replace(materialize(kept, "kept"), touched)
