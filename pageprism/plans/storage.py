"""Queries for sources, sinks, object keys and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import site_key
from ..operators import reports as R
from ..sources import logs, readers, sinks
from ..sources.fixtures import view
from ..sources.stored import StoredTable
from ..streaming import incremental as I
from ..streaming import sketches
from .extraction import parsed
from .reporting import logged
from .tracking import BUCKET, log


def keys(s: SparkSession, sf: str) -> DataFrame:
    return view(s, sf, "object_keys")


def scan_tracker_json(s: SparkSession, sf: str) -> DataFrame:
    """Write tracker documents, with the scrapes and optimizations of a site, and scan them.

    A site's records are dealt to five documents; those of the fourth are cut
    short and give nothing.
    """
    key = lambda url: site_key(F.col(url)).alias("site_key")
    record = F.struct("url", R.iso("scraped_at").alias("scraped_at"), "saved_directory", "user_email")
    scrapes = log(s, sf).select(key("url"), (F.col("page_id") % 5).alias("part"), record.alias("r"))
    scrapes = scrapes.groupBy("site_key", "part").agg(F.collect_list("r").alias("scrapes"))
    record = F.struct("original_url", "user_profile", R.iso("optimized_at").alias("optimized_at"), "optimized_directory")
    opts = view(s, sf, "site_optimizations").select(key("original_url"), (F.col("opt_id") % 5).alias("part"), record.alias("r"))
    opts = opts.groupBy("site_key", "part").agg(F.collect_list("r").alias("optimizations"))
    site = F.struct(F.col("site_key").alias("domain"), "scrapes", "optimizations")
    text = F.to_json(F.struct(F.create_map("site_key", site).alias("sites")))
    docs = scrapes.join(opts, ["site_key", "part"], "full").select(
        F.when(F.col("part") == 3, F.left(text, F.length(text) - 5)).otherwise(text).alias("value")
    )
    path = sinks.work_dir(s, "tracker")
    docs.write.text(path)
    read = s.read.schema(readers.TRACKER).json(path)
    found = readers.tracker_scrapes(read).select(
        F.lit("scrape").alias("kind"), "site_key", "url", F.col("scraped_at").alias("at"), F.col("saved_directory").alias("directory"),
        F.col("user_email").alias("who"),
    )
    return found.unionByName(
        readers.tracker_optimizations(read).select(
            F.lit("optimization").alias("kind"), "site_key", F.col("original_url").alias("url"), F.col("optimized_at").alias("at"),
            F.col("optimized_directory").alias("directory"), F.col("user_profile").alias("who"),
        )
    )


def read_text_doc(s: SparkSession, sf: str) -> DataFrame:
    """Log lines written as text objects and read back as whole documents."""
    path = sinks.work_dir(s, "text")
    view(s, sf, "access_lines").select("line").write.option("maxRecordsPerFile", 100000).text(path)
    docs = readers.read_text_docs(s, path)
    return docs.select(F.explode(F.split("body", "\n")).alias("line")).filter("line <> ''")


#: Lines after which a log file is rotated.
LINES_PER_FILE = 250_000


def _followed_logs(s: SparkSession, sf: str) -> str:
    """The log lines in rotated files, some of which come after the first were taken. More lines are more files, not longer ones."""
    path, out = sinks.work_dir(s, "logs"), sinks.work_dir(s, "log-tables")
    lines = view(s, sf, "access_lines")
    for n in range(2):
        part = lines.filter(F.col("event_id") % 2 == n).select("line")
        part.write.option("maxRecordsPerFile", LINES_PER_FILE).text(f"{path}/access.log.{n}", compression=("none", "gzip")[n])
        logs.follow_logs(s, f"{path}/access.log.*", out, files="part-*")
    return out


def access_log_files(s: SparkSession, sf: str) -> DataFrame:
    return s.read.parquet(f"{_followed_logs(s, sf)}/parsed").drop("batch", "file")


def access_log_malformed(s: SparkSession, sf: str) -> DataFrame:
    return s.read.parquet(f"{_followed_logs(s, sf)}/malformed").select("line")


def list_objects(s: SparkSession, sf: str) -> DataFrame:
    """Which artifact folders a written bundle has files in, and how many pages these hold."""
    path = sinks.work_dir(s, "bundle")
    sinks.write_bundle(R.write_bundle(logged(s, sf), BUCKET), path)
    listed = readers.list_objects(s, path)
    folder = F.regexp_extract("key", "artifact=([^/]+)/[^/]+[.]parquet$", 1)
    files = listed.filter(folder != "").groupBy(folder.alias("artifact")).agg(F.bool_and(F.col("size") > 0).alias("filled"))
    pages = s.read.parquet(path).groupBy("artifact").agg(F.countDistinct("page_id").alias("pages"))
    return files.join(pages, "artifact")


def write_json(s: SparkSession, sf: str) -> DataFrame:
    path = sinks.work_dir(s, "json")
    report = R.report_analysis(logged(s, sf))
    sinks.write_json(report, path)
    return s.read.schema(report.schema).json(path)


def write_seo_csv(s: SparkSession, sf: str) -> DataFrame:
    path = sinks.work_dir(s, "csv")
    sinks.write_csv(R.seo_csv(logged(s, sf)), path)
    return sinks.read_csv(s, path, "page_id bigint, row_ord bigint, metric string, value string, category string")


def object_exists(s: SparkSession, sf: str) -> DataFrame:
    names = F.explode(F.array(F.lit("index.html"), F.lit("scripts.js"))).alias("f")
    wanted = log(s, sf).select("saved_directory", names).select(F.concat_ws("/", "saved_directory", "f").alias("key"))
    return sinks.object_exists(wanted, keys(s, sf))


def delete_prefix(s: SparkSession, sf: str) -> DataFrame:
    """The stored manifest after the bundles of pages without a web address, and all stray keys, are deleted from it."""
    table = StoredTable(s, sinks.work_dir(s, "manifest"), "key", "key string, size bigint", buckets=8)
    table.upsert(keys(s, sf).select("key", F.col("size").cast("bigint").alias("size")))
    gone = view(s, sf, "fetched_pages").filter(F.col("url").startswith("ftp")).select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("dir")
    )
    folder = F.split("key", "/")[1].alias("dir")
    table.delete(keys=table.read().select("key", folder).join(gone.distinct(), "dir", "left_semi"))
    table.delete(F.col("key").startswith("scraped_sites/stray_"))
    return table.read()


QUERIES = {
    "scan_tracker_json": scan_tracker_json,
    "read_text_doc": read_text_doc,
    "access_log_files": access_log_files,
    "access_log_malformed": access_log_malformed,
    "list_objects": list_objects,
    "site_dirs": lambda s, sf: sinks.site_dirs(keys(s, sf)),
    "files_per_dir": lambda s, sf: sinks.files_per_dir(keys(s, sf), BUCKET),
    "object_exists": object_exists,
    "delete_prefix": delete_prefix,
    "write_json": write_json,
    "write_seo_csv": write_seo_csv,
    "stream_site_upsert": I.stream_site_upsert,
    "stream_latest_health": I.stream_latest_health,
    "stream_health_history": I.stream_health_history,
    "stream_request_counts": I.stream_request_counts,
    "stream_late_requests": I.stream_late_requests,
    "stream_latency_quantiles": sketches.stream_latency_quantiles,
    "tracker_adoption_days": lambda s, sf: sketches.tracker_adoption_days(s, parsed(s, sf), "2025-01-02", "2025-03-31"),
}
