"""URL, name and key scalars applied to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import preview


def site_keys(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", U.site_key(F.col("url")).alias("site_key"))


def address_forms(pages: DataFrame) -> DataFrame:
    """The ways a user may write a page's site: full URL, bare host, with slashes."""
    host = U.netloc(F.col("url"))
    forms = F.array(F.col("url"), host, F.concat(F.lit("www."), host, F.lit("//")))
    return pages.select("page_id", F.posexplode(forms).alias("form", "raw")).withColumn("form", F.col("form").cast("bigint"))


def domain_normalize(forms: DataFrame) -> DataFrame:
    return forms.select("page_id", "form", "raw", U.normalize_domain(F.col("raw")).alias("domain"))


def domain_valid(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("valid", U.domain_valid(F.col("domain")))


def url_scheme_valid(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", U.has_web_scheme(F.col("url")).alias("valid"))


def ensure_scheme(forms: DataFrame) -> DataFrame:
    return forms.select("page_id", "form", U.ensure_scheme(F.col("raw")).alias("address"))


def safe_names(forms: DataFrame, stamps: DataFrame) -> DataFrame:
    return forms.join(stamps.select("page_id", "scraped_at"), "page_id").select(
        "page_id", "form", U.safe_name(F.col("raw"), F.col("scraped_at")).alias("name")
    )


def display_names(users: DataFrame) -> DataFrame:
    return users.select("user_id", U.display_name(F.col("given_name"), F.col("family_name"), F.col("email")).alias("name"))


def token_names(users: DataFrame) -> DataFrame:
    return users.select("user_id", U.token_name(F.col("given_name"), F.col("family_name"), F.col("email")).alias("name"))


def safe_labels(projects: DataFrame) -> DataFrame:
    return projects.select("project_id", U.safe_label(F.col("name")).alias("label"))


def log_previews(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", preview(F.col("text")).alias("preview"))


def path_migrate(projects: DataFrame, bucket: str) -> DataFrame:
    """Projects whose stored path changes or already is a bucket path; empty ones are left out."""
    return projects.filter(F.col("scraped_files_path") != "").select(
        "project_id", U.stored_path(F.col("scraped_files_path"), bucket).alias("scraped_files_path")
    )
