"""Sinks, object manifests and work folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "scraped_sites"
_LOCAL: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Only a local master, where driver and executors are one process, may leave
    it unset (as in tests); it then gets a folder of its own. On a cluster a
    missing setting is an error: executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="pageprism-")
    return _LOCAL[context.applicationId]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_base(spark)}/pageprism/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once, and go on from the written table."""
    path = work_dir(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled, so any text survives."""
    (
        df.write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
        .option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    )


def write_bundle(df: DataFrame, path: str) -> None:
    """Artifact rows, one partition folder per artifact.

    One object per page and artifact would mean billions of tiny objects; the
    key column still names the object each row stands for.
    """
    df.write.mode("errorifexists").partitionBy("artifact").parquet(path)


# ---- key manifests ------------------------------------------------------------
def _dir_of(keys: DataFrame) -> DataFrame:
    parts = F.split("key", "/")
    return keys.filter(F.size(parts) >= 3).select("key", parts[1].alias("dir"))


def site_dirs(keys: DataFrame) -> DataFrame:
    return _dir_of(keys).select("dir").distinct().orderBy(F.desc("dir"))


def files_per_dir(keys: DataFrame, bucket: str) -> DataFrame:
    return (
        _dir_of(keys)
        .groupBy("dir")
        .agg(F.count(F.lit(1)).alias("file_count"))
        .select(
            F.col("dir").alias("name"),
            F.concat(F.lit(f"s3://{bucket}/{PREFIX}/"), "dir").alias("path"),
            F.lit("scraped").alias("type"),
            F.lit("s3").alias("storage"),
            "file_count",
        )
    )


def object_exists(lookups: DataFrame, keys: DataFrame) -> DataFrame:
    known = keys.select("key").distinct().withColumn("hit", F.lit(True))
    return lookups.join(known, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"))


def below_prefix(keys: DataFrame, prefix: str) -> DataFrame:
    return keys.filter(F.col("key").startswith(prefix))


def delete_prefix(keys: DataFrame, prefix: str) -> DataFrame:
    """The manifest without the keys below one prefix."""
    return keys.filter(~F.col("key").startswith(prefix))


def delete_dirs(keys: DataFrame, dirs: DataFrame) -> DataFrame:
    """The manifest without the keys in any of the given folders."""
    folder = F.split("key", "/")[1]
    return keys.withColumn("dir", folder).join(dirs.select("dir").distinct(), "dir", "left_anti").drop("dir")
