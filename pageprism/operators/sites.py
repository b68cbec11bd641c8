"""Site tracking: aggregates over scrape and optimization records.

Everything per site is an aggregate with map-side combine, so a site holding
a third of all records costs one partial result per task, never one big group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import site_key
from . import extract as E
from ..functions.cols import n


def scrape_stats(parsed: DataFrame) -> DataFrame:
    """Scrape records with title and the six counts of each page."""
    return parsed.select(
        "page_id",
        "url",
        "scraped_at",
        "user_email",
        "saved_directory",
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        n(F.col("anchors")).alias("links_count"),
        n(F.col("inline_styles")).alias("inline_styles_count"),
        n(E.internal_css()).alias("internal_stylesheets_count"),
        n(E.external_css()).alias("external_stylesheets_count"),
        n(E.inline_scripts()).alias("inline_scripts_count"),
        n(E.external_scripts()).alias("external_scripts_count"),
    )


def with_site(df: DataFrame, url: str) -> DataFrame:
    return df.withColumn("site_key", site_key(F.col(url)))


def site_upsert(scrapes: DataFrame) -> DataFrame:
    return with_site(scrapes, "url").groupBy("site_key").agg(
        F.min("scraped_at").alias("first_scraped"),
        F.max("scraped_at").alias("last_scraped"),
        F.count(F.lit(1)).alias("total_scrapes"),
    )


def site_opt_upsert(scrapes: DataFrame, optimizations: DataFrame) -> DataFrame:
    """Site rows after both kinds of records; an optimization may open a site."""
    opts = with_site(optimizations, "original_url").groupBy("site_key").agg(
        F.min("optimized_at").alias("first_optimized"),
        F.max("optimized_at").alias("last_optimized"),
        F.count(F.lit(1)).alias("opts"),
    )
    return site_upsert(scrapes).join(opts, "site_key", "full_outer").select(
        "site_key",
        F.least("first_scraped", "first_optimized").alias("first_seen"),
        "last_scraped",
        "last_optimized",
        F.coalesce("total_scrapes", F.lit(0)).alias("total_scrapes"),
        F.coalesce("opts", F.lit(0)).alias("total_optimizations"),
    )


def is_scraped(lookups: DataFrame, scrapes: DataFrame) -> DataFrame:
    """Flag per looked-up URL; ``lookups`` has (lookup_id, url)."""
    known = with_site(scrapes, "url").select("site_key").distinct().withColumn("hit", F.lit(True))
    return (
        with_site(lookups, "url")
        .join(known, "site_key", "left")
        .select("lookup_id", "site_key", F.coalesce("hit", F.lit(False)).alias("is_scraped"))
    )


def site_info(lookups: DataFrame, sites: DataFrame) -> DataFrame:
    return with_site(lookups, "url").join(sites, "site_key").select("lookup_id", *sites.columns)


def activities(scrapes: DataFrame, optimizations: DataFrame) -> DataFrame:
    s = with_site(scrapes, "url").select(
        F.lit("scrape").alias("type"),
        F.col("site_key").alias("site"),
        F.col("scraped_at").alias("happened_at"),
        "url",
        F.col("page_id").alias("record"),
    )
    o = with_site(optimizations, "original_url").select(
        F.lit("optimization").alias("type"),
        F.col("site_key").alias("site"),
        F.col("optimized_at").alias("happened_at"),
        "user_profile",
        F.col("opt_id").alias("record"),
    )
    return s.unionByName(o, allowMissingColumns=True)


def site_totals(scrapes: DataFrame, optimizations: DataFrame) -> DataFrame:
    per_site = (
        activities(scrapes, optimizations)
        .groupBy("site")
        .agg(
            F.count_if(F.col("type") == "scrape").alias("s"),
            F.count_if(F.col("type") == "optimization").alias("o"),
        )
    )
    return per_site.agg(
        F.count(F.lit(1)).alias("total_sites"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("total_scrapes"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("total_optimizations"),
    )


def recent_activity(scrapes: DataFrame, optimizations: DataFrame, k: int = 10) -> DataFrame:
    newest_first = [F.desc("happened_at"), F.asc("type"), F.asc("record")]
    return activities(scrapes, optimizations).orderBy(*newest_first).limit(k)


def site_search(scrapes: DataFrame, query: str) -> DataFrame:
    """Sites whose key or any title contains the text, each once."""
    q = F.lit(query.lower())
    hit = F.contains("site_key", q) | F.coalesce(F.contains(F.lower("title"), q), F.lit(False))
    return with_site(scrapes, "url").groupBy("site_key").agg(F.bool_or(hit).alias("hit")).filter("hit").select("site_key")


def sites_by_user(scrapes: DataFrame) -> DataFrame:
    """Latest scrape per user and site, for all users at once."""
    latest = F.max_by(
        F.struct("url", "title", "scraped_at", "saved_directory"), F.struct("scraped_at", "page_id")
    ).alias("x")
    return (
        with_site(scrapes.filter(F.col("user_email").isNotNull()), "url")
        .groupBy("user_email", "site_key")
        .agg(latest)
        .select(
            "user_email",
            F.col("x.url").alias("url"),
            F.col("site_key").alias("domain"),
            F.col("x.title").alias("title"),
            F.col("x.scraped_at").alias("timestamp"),
            F.col("x.saved_directory").alias("saved_directory"),
            F.lit("Website").alias("category"),
            F.lit("completed").alias("status"),
            F.lit(1).cast("bigint").alias("pages_scraped"),
        )
    )


def sites_by_profile(optimizations: DataFrame) -> DataFrame:
    return with_site(optimizations, "original_url").select("user_profile", "site_key").distinct()


def site_summary(scrapes: DataFrame, optimizations: DataFrame, latest: int = 5) -> DataFrame:
    """Per site the counts and the last record of each kind (``kind`` site), and the ``latest`` events of all sites (scrape, optimization)."""
    s = with_site(scrapes, "url").groupBy("site_key").agg(
        F.count(F.lit(1)).alias("scrapes"),
        F.min("scraped_at").alias("first_scraped"),
        F.max_by(F.struct("scraped_at", "title"), F.struct("scraped_at", "page_id")).alias("last"),
    )
    o = with_site(optimizations, "original_url").groupBy("site_key").agg(
        F.count(F.lit(1)).alias("optimizations"),
        F.max_by(F.struct("optimized_at", "user_profile"), F.struct("optimized_at", "opt_id")).alias("last_opt"),
    )
    sites = s.join(o, "site_key", "full_outer").select(
        F.lit("site").alias("kind"),
        "site_key",
        "first_scraped",
        F.coalesce("scrapes", F.lit(0)).alias("scrapes"),
        F.coalesce("optimizations", F.lit(0)).alias("optimizations"),
        F.col("last.scraped_at").alias("latest_scrape"),
        F.col("last.title").alias("title"),
        F.col("last_opt.optimized_at").alias("latest_optimization"),
        F.col("last_opt.user_profile").alias("latest_profile"),
    )
    events = recent_activity(scrapes, optimizations, latest)
    return sites.unionByName(
        events.select(
            F.col("type").alias("kind"),
            F.col("site").alias("site_key"),
            F.when(F.col("type") == "scrape", F.col("happened_at")).alias("latest_scrape"),
            F.when(F.col("type") != "scrape", F.col("happened_at")).alias("latest_optimization"),
            F.col("user_profile").alias("latest_profile"),
        ),
        allowMissingColumns=True,
    )
