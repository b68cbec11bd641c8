"""Queries for URL scalars and site tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names as N
from ..operators import sites as S
from ..sources.fixtures import view
from ..sources.readers import read_table
from .extraction import parsed

BUCKET = "site-audits"
SEARCH = "Blog"


def log(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "scrape_log")


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """Scrape records with the page title."""
    return parsed(spark, sf, "title").select("page_id", "url", "title", "scraped_at", "user_email", "saved_directory")


def opts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "site_optimizations")


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    """URLs to look up, some of sites never seen."""
    url = F.when(F.col("user_profile") == "system", F.concat(F.lit("https://unseen."), F.lit("example.com/")))
    return opts(spark, sf).select(F.col("opt_id").alias("lookup_id"), F.coalesce(url, "original_url").alias("url"))


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    return N.address_forms(read_table(spark, sf, "pages"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    host = F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string"))
    forms = F.array(
        F.col("c_name"),
        F.concat(host, F.lit(".example.com")),
        F.concat(F.lit("-"), host, F.lit(".com")),
        F.concat(F.repeat(host, 5), F.lit(".com")),
        F.repeat(F.concat(host, F.lit(".")), 20),
        F.concat(F.repeat(F.concat(host, F.lit(".")), 15), F.lit("com")),
    )
    return c.select("c_custkey", F.explode(forms).alias("domain"))


QUERIES = {
    "site_key": lambda s, sf: N.site_keys(read_table(s, sf, "pages")),
    "domain_normalize": lambda s, sf: N.domain_normalize(_forms(s, sf)),
    "domain_valid": lambda s, sf: N.domain_valid(_candidates(s, sf)),
    "url_scheme_valid": lambda s, sf: N.url_scheme_valid(view(s, sf, "fetched_pages")),
    "ensure_scheme": lambda s, sf: N.ensure_scheme(_forms(s, sf)),
    "safe_name": lambda s, sf: N.safe_names(_forms(s, sf), log(s, sf)),
    "display_name": lambda s, sf: N.display_names(view(s, sf, "users")),
    "token_name": lambda s, sf: N.token_names(view(s, sf, "users")),
    "safe_label": lambda s, sf: N.safe_labels(view(s, sf, "projects")),
    "log_preview": lambda s, sf: N.log_previews(read_table(s, sf, "documents")),
    "path_migrate": lambda s, sf: N.path_migrate(view(s, sf, "projects"), BUCKET),
    "scrape_stats": lambda s, sf: S.scrape_stats(parsed(s, sf)),
    "site_upsert": lambda s, sf: S.site_upsert(log(s, sf)),
    "site_opt_upsert": lambda s, sf: S.site_opt_upsert(log(s, sf), opts(s, sf)),
    "is_scraped": lambda s, sf: S.is_scraped(lookups(s, sf), log(s, sf)),
    "site_info": lambda s, sf: S.site_info(lookups(s, sf), S.site_opt_upsert(log(s, sf), opts(s, sf))),
    "all_sites": lambda s, sf: S.activities(log(s, sf), opts(s, sf)),
    "site_totals": lambda s, sf: S.site_totals(log(s, sf), opts(s, sf)),
    "recent_activity": lambda s, sf: S.recent_activity(log(s, sf), opts(s, sf)),
    "site_search": lambda s, sf: S.site_search(titled(s, sf), SEARCH),
    "sites_by_user": lambda s, sf: S.sites_by_user(titled(s, sf)),
    "sites_by_profile": lambda s, sf: S.sites_by_profile(opts(s, sf)),
    "site_summary": lambda s, sf: S.site_summary(titled(s, sf), opts(s, sf)),
}
