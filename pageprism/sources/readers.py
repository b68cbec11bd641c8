"""Readers: tables, text and JSON documents, object listings, tracker files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCRAPE_STATS = T.StructType(
    [
        T.StructField(k, T.LongType())
        for k in (
            "links_count",
            "inline_styles_count",
            "internal_stylesheets_count",
            "external_stylesheets_count",
            "inline_scripts_count",
            "external_scripts_count",
        )
    ]
)

SITE = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("first_scraped", T.StringType()),
        T.StructField(
            "scrapes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("url", T.StringType()),
                        T.StructField("scraped_at", T.StringType()),
                        T.StructField("saved_directory", T.StringType()),
                        T.StructField("user_email", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("stats", SCRAPE_STATS),
                    ]
                )
            ),
        ),
        T.StructField(
            "optimizations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("original_url", T.StringType()),
                        T.StructField("user_profile", T.StringType()),
                        T.StructField("optimized_at", T.StringType()),
                        T.StructField("optimized_directory", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

TRACKER = T.StructType([T.StructField("sites", T.MapType(T.StringType(), SITE))])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: number of partitions to which page tables are dealt before parsing.
PARSE_PARTITIONS = "pageprism.parse.partitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows to as many partitions as the session asks for, else leave them where they are.

    Page tables with row groups of a few MB need no shuffle: their splits
    follow ``spark.sql.files.maxPartitionBytes``. The setting is for a table
    written as one row group, which no split setting can divide.
    """
    parts = df.sparkSession.conf.get(PARSE_PARTITIONS, None)
    return df.repartition(int(parts), key) if parts else df


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """Whole text objects with their keys."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("key"), F.col("value").alias("body")
    )


def read_json_docs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON objects, one per file; malformed ones give a NULL document."""
    docs = read_text_docs(spark, path)
    return docs.select("key", parse_json_doc(F.col("body"), schema).alias("doc"))


def parse_json_doc(text, schema: T.StructType):
    """JSON text to struct; malformed text or no object at all gives NULL."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Keys, sizes and times below a path; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("key"), F.col("length").alias("size"), "modificationTime")
    )


def read_tracker(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tracker documents to flat ``scrapes`` and ``site_optimizations``.

    A malformed or empty document yields no sites, like a new tracker.
    """
    docs = spark.read.schema(TRACKER).json(path, multiLine=True, mode="PERMISSIVE")
    return tracker_scrapes(docs), tracker_optimizations(docs)


def _sites(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("sites").alias("site_key", "site"))


def tracker_scrapes(docs: DataFrame) -> DataFrame:
    s = _sites(docs).select("site_key", F.explode("site.scrapes").alias("s"))
    return s.select(
        "site_key",
        F.col("s.url").alias("url"),
        F.col("s.scraped_at").try_cast("timestamp_ntz").alias("scraped_at"),
        F.col("s.saved_directory").alias("saved_directory"),
        F.col("s.user_email").alias("user_email"),
        F.col("s.title").alias("title"),
        *[F.col(f"s.stats.{f.name}").alias(f.name) for f in SCRAPE_STATS],
    )


def tracker_optimizations(docs: DataFrame) -> DataFrame:
    s = _sites(docs).select("site_key", F.explode("site.optimizations").alias("o"))
    return s.select(
        "site_key",
        F.col("o.original_url").alias("original_url"),
        F.col("o.user_profile").alias("user_profile"),
        F.col("o.optimized_at").try_cast("timestamp_ntz").alias("optimized_at"),
        F.col("o.optimized_directory").alias("optimized_directory"),
    )
