"""Tracking-tag detection over the scripts and meta tags of parsed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import count_if_in, let, n, one_of, per_jvm, rows
from ..functions.html import preview

# Tools in the order they are tried, and id patterns.
TOOLS = ["google_analytics", "google_tag_manager", "facebook_pixel", "hotjar", "mixpanel", "other_tracking"]
OTHER_TOOLS = ["clarity", "crazyegg", "optimizely", "vwo", "abtasty"]
GA4_ID = r"G-[A-Z0-9]{10}"
UNIVERSAL_ID = r"UA-[0-9]+-[0-9]+"
ID_PATTERNS = {
    "google_tag_manager": (r"GTM-[A-Z0-9]{7}", 0),
    "facebook_pixel": (r"""fbq\(['"]init['"],\s*['"]([0-9]{9,15})['"]""", 1),
    "hotjar": (r"hjid:\s*([0-9]+)", 1),
    "mixpanel": (r"""mixpanel\.init\(['"]([a-zA-Z0-9]{32})['"]""", 1),
}


def _find(body: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(body, pattern, group), F.lit(""))


def _tool(body: Column, src: Column) -> Column:
    both = lambda w: F.contains(body, F.lit(w)) | F.contains(src, F.lit(w))
    return (
        F.when(one_of(body, ["gtag", "ga("]) | F.contains(src, F.lit("google-analytics")), F.lit("google_analytics"))
        .when(both("googletagmanager"), F.lit("google_tag_manager"))
        .when(F.contains(body, F.lit("fbq")) | F.contains(src, F.lit("facebook")), F.lit("facebook_pixel"))
        .when(both("hotjar"), F.lit("hotjar"))
        .when(both("mixpanel"), F.lit("mixpanel"))
        .when(one_of(F.lower(body), OTHER_TOOLS), F.lit("other_tracking"))
    )


@per_jvm
def classified() -> Column:
    """One struct per script: its tool (NULL if none) and the ids found."""

    def one(s: Column, i: Column) -> Column:
        body, src = s["body"], F.coalesce(s["src"], F.lit(""))

        def build(tool: Column) -> Column:
            ga4 = F.when(tool == "google_analytics", _find(body, GA4_ID))
            universal = F.when(tool == "google_analytics", _find(body, UNIVERSAL_ID))
            other = F.lit(None).cast("string")
            for name, (pattern, group) in ID_PATTERNS.items():
                other = F.when(tool == name, _find(body, pattern, group)).otherwise(other)
            return F.struct(
                (i + 1).cast("bigint").alias("script"),
                tool.alias("tool"),
                F.when(universal.isNotNull(), F.lit("Universal Analytics"))
                .when(ga4.isNotNull(), F.lit("GA4"))
                .alias("version"),
                ga4.alias("measurement_id"),
                universal.alias("tracking_id"),
                F.coalesce(universal, ga4, other).alias("tool_id"),
                src.alias("src"),
                preview(body).alias("preview"),
            )

        return let(_tool(body, src), build)

    return F.transform(F.col("scripts"), one)


def is_kept(x: Column) -> Column:
    """A script of a known tool counts only if its id was found."""
    return F.coalesce((x["tool"] == "other_tracking") | x["tool_id"].isNotNull(), F.lit(False))


def _rows(parsed: DataFrame) -> DataFrame:
    return rows(parsed, F.filter(classified(), lambda x: x["tool"].isNotNull())).select("page_id", "e.*")


def tracker_class(parsed: DataFrame) -> DataFrame:
    kept = (F.col("tool") == "other_tracking") | F.col("tool_id").isNotNull()
    return _rows(parsed).select("page_id", "script", "tool", kept.alias("kept"))


def tracker_ga(parsed: DataFrame) -> DataFrame:
    return (
        _rows(parsed)
        .filter((F.col("tool") == "google_analytics") & F.col("tool_id").isNotNull())
        .select("page_id", "script", "version", "measurement_id", "tracking_id", "src", "preview")
    )


def tracker_ids(parsed: DataFrame, tool: str, id_name: str) -> DataFrame:
    return (
        _rows(parsed)
        .filter((F.col("tool") == tool) & F.col("tool_id").isNotNull())
        .select("page_id", "script", F.col("tool_id").alias(id_name), "src", "preview")
    )


def tracker_other(parsed: DataFrame) -> DataFrame:
    return _rows(parsed).filter(F.col("tool") == "other_tracking").select("page_id", "script", "src", "preview")


@per_jvm
def social_metas() -> Column:
    """Meta tags (every occurrence) that belong to a social network."""
    tagged = F.transform(
        F.col("metas"),
        lambda m: m.withField(
            "type",
            F.when(one_of(F.lower(m["name"]), ["facebook", "fb:"]), F.lit("facebook_meta")).when(
                F.contains(F.lower(m["name"]), F.lit("twitter")), F.lit("twitter_meta")
            ),
        ),
    )
    return F.filter(tagged, lambda m: m["type"].isNotNull())


def social_meta(parsed: DataFrame) -> DataFrame:
    return rows(parsed, social_metas()).select("page_id", "pos", "e.type", "e.name", "e.content")


def intensity(total: Column) -> Column:
    return (
        F.when(total == 0, F.lit("None"))
        .when(total == 1, F.lit("Light"))
        .when(total <= 3, F.lit("Moderate"))
        .when(total <= 5, F.lit("Heavy"))
        .otherwise(F.lit("Very Heavy"))
    )


def tool_counts(parsed: DataFrame, *keep: str) -> DataFrame:
    """Scripts kept per tool, one row per page."""
    kept = parsed.select(
        "page_id", *keep, F.filter(classified(), is_kept).alias("kept"), n(social_metas()).alias("social_metas")
    )
    per_tool = lambda t: count_if_in(F.col("kept"), lambda x: x["tool"] == t).alias(t)
    cols = [per_tool(t) for t in TOOLS]
    return kept.select("page_id", *keep, *cols, "social_metas", n(F.col("kept")).alias("total_tracking_tools"))


def tracker_summary(parsed: DataFrame) -> DataFrame:
    flags = {
        "has_google_analytics": "google_analytics",
        "has_facebook_pixel": "facebook_pixel",
        "has_gtm": "google_tag_manager",
        "has_hotjar": "hotjar",
        "has_mixpanel": "mixpanel",
        "has_social_tracking": "social_metas",
    }
    return tool_counts(parsed).select(
        "page_id", "total_tracking_tools", *[(F.col(c) > 0).alias(k) for k, c in flags.items()]
    )


def tracking_intensity(parsed: DataFrame) -> DataFrame:
    total = F.col("total_tracking_tools")
    return tool_counts(parsed).select("page_id", total, intensity(total).alias("intensity"))


def privacy_flag(parsed: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("intensity").isin("Heavy", "Very Heavy"), F.lit("high"))
        .when(F.col("intensity") == "Moderate", F.lit("moderate"))
        .when(F.col("intensity") == "Light", F.lit("light"))
        .otherwise(F.lit("none"))
    )
    return tracking_intensity(parsed).select(
        "page_id", level.alias("privacy"), (F.col("total_tracking_tools") > 3).alias("consolidate")
    )
