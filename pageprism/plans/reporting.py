"""Queries for bundles, reports, traffic windows and corpus comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators.burst import burst_limit
from ..operators import reports as R
from ..operators import windows as W
from ..sources.fixtures import view
from .extraction import on_pages, parsed
from .tracking import BUCKET

PROFILES = ["developer", "marketer", "shopper"]
HOUR_LIMIT, DAY_LIMIT, SECOND_LIMIT, LOGIN_SECOND_LIMIT = 100, 1000, 10, 2


def logged(s: SparkSession, sf: str) -> DataFrame:
    return R.prepared(parsed(s, sf))


def bundle(s: SparkSession, sf: str, only: str | None = None) -> DataFrame:
    return R.write_bundle(logged(s, sf), BUCKET, only)


def requests(s: SparkSession, sf: str) -> DataFrame:
    return view(s, sf, "requests")


def _artifact(name: str, column: str):
    return lambda s, sf: bundle(s, sf, name).select("page_id", F.col("body").alias(column))


def write_bundle(s: SparkSession, sf: str) -> DataFrame:
    """All six artifacts; of the metadata document its counts are shown."""
    shown = F.when(F.col("artifact") == "metadata.json", F.get_json_object("body", "$.stats")).otherwise(F.col("body"))
    return bundle(s, sf).select("page_id", "artifact", "key", shown.alias("body"))


def bundle_metadata(s: SparkSession, sf: str) -> DataFrame:
    """Fields read back from the metadata document of every page."""
    field = lambda path: F.get_json_object("body", path)
    size = lambda path: F.json_array_length(field(path)).cast("bigint")
    return bundle(s, sf, "metadata.json").select(
        "page_id",
        field("$.original_url").alias("original_url"),
        field("$.scraped_at").alias("scraped_at"),
        field("$.title").alias("title"),
        field("$.s3_location").alias("s3_location"),
        field("$.stats.links_count").cast("bigint").alias("links_count"),
        field("$.seo_metadata.word_count").cast("bigint").alias("word_count"),
        field("$.seo_metadata.canonical_url").alias("canonical_url"),
        field("$.seo_metadata.meta_tags.description").alias("description"),
        size("$.seo_metadata.images").alias("images"),
        size("$.seo_metadata.internal_links").alias("internal_links"),
        size("$.seo_metadata.external_links").alias("external_links"),
        size("$.seo_metadata.headings.h2").alias("h2"),
        F.size(F.from_json(field("$.seo_metadata.keyword_density"), "map<string,bigint>")).cast("bigint").alias("keywords"),
        field("$.seo_metadata.detailed_analytics.analytics_summary.total_tracking_tools").cast("bigint").alias("tools"),
        field("$.seo_metadata.page_speed_indicators.inline_styles").cast("bigint").alias("styled"),
        F.try_parse_json(field("$.seo_metadata.structured_data")).isNotNull().alias("structured"),
    )


def _limits(unit: str, limit: int, busy: bool = True):
    return lambda s, sf: W.over_limit(view(s, sf, "busy_requests" if busy else "requests"), unit, limit)


QUERIES = {
    "write_bundle": write_bundle,
    "bundle_css": _artifact("styles.css", "css"),
    "bundle_js": _artifact("scripts.js", "js"),
    "bundle_links": _artifact("links.txt", "links"),
    "bundle_metadata": bundle_metadata,
    "bundle_seo_report": _artifact("seo_report.txt", "report"),
    "seo_csv": lambda s, sf: R.seo_csv(logged(s, sf)),
    "project_seo_csv": lambda s, sf: R.project_seo_csv(view(s, sf, "projects"), logged(s, sf)),
    "report_analysis": lambda s, sf: R.report_analysis(logged(s, sf)),
    "report_analytics": on_pages(R.report_analytics),
    "report_metadata": lambda s, sf: R.metadata_rows(bundle(s, sf, "metadata.json")),
    "report_seo_text": _artifact("seo_report.txt", "text"),
    "opt_snapshot": on_pages(lambda p: R.opt_snapshot(p, PROFILES)),
    "request_rate_5m": lambda s, sf: W.request_rate(requests(s, sf)),
    "latency_p95_5m": lambda s, sf: W.latency_quantile(requests(s, sf)),
    "latest_gauge": lambda s, sf: W.latest_gauge(requests(s, sf)),
    # The stock limits on traffic that is above them, and low ones on the given traffic.
    "rate_limit_hour": _limits("hour", HOUR_LIMIT),
    "rate_limit_day": _limits("day", DAY_LIMIT),
    "rate_limit_second": _limits("second", SECOND_LIMIT),
    "rate_limit_hour_low": _limits("hour", 1, busy=False),
    "rate_limit_day_low": _limits("day", 3, busy=False),
    "rate_limit_second_low": _limits("second", 0, busy=False),
    "rate_limit_second_login": _limits("second", LOGIN_SECOND_LIMIT),
    # fixed values: rate and burst of the interface and of scraping
    "rate_limit_burst": lambda s, sf: burst_limit(view(s, sf, "busy_requests"), rate=10, burst=20),
    "rate_limit_burst_scrape": lambda s, sf: burst_limit(view(s, sf, "busy_requests"), rate=2, burst=5, block="1 minute"),
    "access_log_parse": lambda s, sf: W.parse_access_log(view(s, sf, "access_lines")),
    "log_slices": lambda s, sf: W.log_slices(requests(s, sf), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")),
    "missing_meta_audit": on_pages(C.missing_meta_audit),
    "seo_change_over_time": lambda s, sf: C.seo_change(view(s, sf, "site_health")),
    "competitor_compare": on_pages(C.competitor_compare),
    "content_compare": on_pages(C.content_compare),
    "shared_keywords": on_pages(C.shared_keywords),
    "site_similarity": on_pages(C.site_similarity),
    "link_opportunities": on_pages(C.site_links),
    "link_degrees": on_pages(C.link_degrees),
    "tracker_adoption": on_pages(C.tracker_adoption),
    "tool_pairs": on_pages(C.tool_pairs),
    "perf_trend": on_pages(C.perf_trend),
}
