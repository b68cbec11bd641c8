"""Page scoring and classification on per-page measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.cols import count_if_in, let, n, one_of, per_jvm, present, rows
from . import extract as E
from . import trackers as T

# Link classes by text and by address.
NAVIGATION = ["home", "menu", "about", "contact", "services"]
CALLS_TO_ACTION = ["read more", "learn more", "click here", "view"]
SOCIAL_WORDS = ["facebook", "twitter", "instagram", "linkedin", "youtube"]

# Messages in the order they are given.
OPPORTUNITIES = {
    "scripts": "Consider reducing the number of scripts",
    "styles": "Move inline styles to external stylesheets",
    "alt": "Add alt text to all images for better SEO",
    "content": "Consider adding more content for better SEO",
    "canonical": "Add canonical URL to prevent duplicate content issues",
    "sitemap": "Consider adding a sitemap for better search engine indexing",
}
RECOMMENDATIONS = {
    "content": "📝 Add more content - aim for at least 300 words for better SEO",
    "canonical": "🔗 Add canonical URL to prevent duplicate content issues",
    "alt": "🖼️ Improve image alt text coverage - aim for 100%",
    "favicon": "🎨 Add a favicon for better brand recognition",
    "scripts": "⚡ Reduce number of scripts to improve page load speed",
    "styles": "🎨 Move inline styles to external stylesheets",
    "hierarchy": "📋 Optimize heading hierarchy - use one H1 and proper H2-H6 structure",
    "balance": "🔗 Balance internal vs external links - prioritize internal linking",
    "depth": "📚 Enhance content depth with more detailed information",
    "social": "📱 Add social media links for better engagement",
}


@per_jvm
def _measure_columns() -> list[Column]:
    level = lambda k: count_if_in(F.col("headings"), lambda h: h["level"] == k).alias(f"h{k}")
    return [
        F.length("html").cast("bigint").alias("total_characters"),
        n(F.regexp_extract_all("html", F.lit(f"[^{H.SPACE[1:-1]}]++"), F.lit(0))).alias("total_words"),
        F.octet_length("html").cast("bigint").alias("octets"),
        n(E.meta_names()).alias("meta_tags_count"),
        n(E.meta_names("og:")).alias("open_graph_tags"),
        n(E.meta_names("twitter:")).alias("twitter_cards"),
        n(E.json_ld()).alias("structured_data_blocks"),
        E.first_link("canonical").alias("canonical_url"),
        E.first_link("icon").alias("favicon"),
        E.first_link("sitemap").alias("sitemap"),
        E.last_meta("robots").alias("robots"),
        E.last_meta("description").alias("meta_description"),
        *[E.last_meta(k).alias(k) for k in ("language", "charset", "viewport")],
        n(F.col("words")).alias("word_count"),
        n(F.col("inline_styles")).alias("inline_styles"),
        n(E.internal_css()).alias("internal_css"),
        n(E.external_css()).alias("external_css"),
        n(E.inline_scripts()).alias("inline_scripts"),
        n(E.external_scripts()).alias("external_scripts"),
        n(F.col("scripts")).alias("script_tags"),
        n(E.stylesheets()).alias("total_stylesheets"),
        n(E.script_hits()).alias("script_hits"),
        n(E.feeds()).alias("feeds"),
        n(F.col("headings")).alias("total_headings"),
        *[level(k) for k in range(1, 7)],
        n(F.col("anchors")).alias("total_links"),
        count_if_in(F.col("anchors"), lambda a: a["internal"]).alias("internal_links"),
        count_if_in(F.col("anchors"), lambda a: ~a["internal"]).alias("external_links"),
        count_if_in(F.col("anchors"), lambda a: a["social"]).alias("social_links"),
        n(F.col("images")).alias("total_images"),
        count_if_in(F.col("images"), lambda i: i["alt"] == "").alias("images_without_alt"),
        count_if_in(F.col("images"), lambda i: i["loading"] == "lazy").alias("lazy_loading_images"),
        count_if_in(F.col("images"), lambda i: present(i["width"]) & present(i["height"])).alias("responsive_images"),
    ]


def measures(parsed: DataFrame, *keep: str) -> DataFrame:
    """All numbers the scores are made of, one row per page."""
    return parsed.select("page_id", "url", "title", *keep, *_measure_columns())


def _c(name: str) -> Column:
    return F.col(name)


@per_jvm
def richness() -> Column:
    w = _c("word_count")
    return F.when(w > 1000, F.lit("High")).when(w > 300, F.lit("Medium")).otherwise(F.lit("Low"))


@per_jvm
def content_type() -> Column:
    total = _c("total_headings")
    return (
        F.when(total == 0, F.lit("Simple Page"))
        .when((_c("h1") == 1) & (total <= 5), F.lit("Landing Page"))
        .when(total > 10, F.lit("Content-Rich Page"))
        .when(_c("h2") > 3, F.lit("Article/Blog Post"))
        .when(_c("h3") > 5, F.lit("Product/Service Page"))
        .otherwise(F.lit("Unknown"))
    )


@per_jvm
def depth() -> Column:
    total = _c("total_headings")
    return F.when(total > 15, F.lit("Deep")).when(total > 5, F.lit("Medium")).otherwise(F.lit("Shallow"))


@per_jvm
def hierarchy_optimal() -> Column:
    return (_c("h1") == 1) & (_c("h2") > 0)


@per_jvm
def ratio(part: str) -> Column:
    return _c(part) / F.greatest(_c("total_links"), F.lit(1))


@per_jvm
def link_quality() -> Column:
    return F.when(_c("internal_links") > _c("external_links"), F.lit("Good")).otherwise(F.lit("Needs Improvement"))


@per_jvm
def with_alt() -> Column:
    return _c("total_images") - _c("images_without_alt")


@per_jvm
def alt_share() -> Column:
    return F.when(_c("total_images") == 0, F.lit(0.0)).otherwise(with_alt() / F.greatest(_c("total_images"), F.lit(1)))


@per_jvm
def alt_coverage() -> Column:
    return alt_share() * 100


@per_jvm
def media_richness() -> Column:
    i = _c("total_images")
    return F.when(i > 10, F.lit("High")).when(i > 3, F.lit("Medium")).otherwise(F.lit("Low"))


@per_jvm
def performance() -> Column:
    scripts, styles = _c("script_tags"), _c("inline_styles")
    lost = (
        F.when(scripts > 20, 20).when(scripts > 10, 10).otherwise(0)
        + F.when(styles > 50, 15).when(styles > 20, 7).otherwise(0)
        + F.when(_c("images_without_alt") > 0, 10).otherwise(0)
    )
    return F.greatest(100 - lost, F.lit(0)).cast("bigint")


@per_jvm
def health() -> Column:
    words = _c("word_count")
    lost = (
        F.when(present(_c("title")), 0).otherwise(15)
        + F.when(present(_c("meta_description")), 0).otherwise(10)
        + F.when(present(_c("canonical_url")), 0).otherwise(5)
        + F.least(F.lit(10), _c("images_without_alt") * 2)
        + F.when(words < 300, 10).when(words < 500, 5).otherwise(0)
        + F.when(_c("script_hits") > 5, 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("bigint")


def _messages(table: dict[str, str], tests: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(tests[k], F.lit(text)) for k, text in table.items()]))


@per_jvm
def opportunities() -> Column:
    return _messages(
        OPPORTUNITIES,
        {
            "scripts": _c("script_tags") > 15,
            "styles": _c("inline_styles") > 30,
            "alt": _c("images_without_alt") > 0,
            "content": _c("word_count") < 300,
            "canonical": ~present(_c("canonical_url")),
            "sitemap": ~present(_c("sitemap")),
        },
    )


@per_jvm
def recommendations() -> Column:
    return _messages(
        RECOMMENDATIONS,
        {
            "content": _c("word_count") < 300,
            "canonical": ~present(_c("canonical_url")),
            "alt": alt_coverage() < 80,
            "favicon": ~present(_c("favicon")),
            "scripts": _c("script_tags") > 15,
            "styles": _c("inline_styles") > 30,
            "hierarchy": ~hierarchy_optimal(),
            "balance": ratio("external_links") > 0.5,
            "depth": richness() == "Low",
            "social": _c("social_links") == 0,
        },
    )


# ---- column groups of the analysis ---------------------------------------
OVERVIEW = lambda: {
    "total_characters": _c("total_characters"),
    "total_words": _c("total_words"),
    "content_size_mb": _c("octets") / F.lit(1048576),
    "title": _c("title"),
    "has_title": present(_c("title")),
    "title_length": F.length(F.coalesce("title", F.lit(""))).cast("bigint"),
    "title_optimal": F.length(F.coalesce("title", F.lit(""))).between(50, 60),
}
SEO = lambda: {
    "meta_tags_count": _c("meta_tags_count"),
    "open_graph_tags": _c("open_graph_tags"),
    "twitter_cards": _c("twitter_cards"),
    "structured_data_blocks": _c("structured_data_blocks"),
    "has_canonical": present(_c("canonical_url")),
    "has_robots": present(_c("robots")),
    "has_favicon": present(_c("favicon")),
    "has_sitemap": present(_c("sitemap")),
    "word_count": _c("word_count"),
}
TECHNICAL = lambda: {
    "inline_styles": _c("inline_styles"),
    "internal_stylesheets": _c("internal_css"),
    "external_stylesheets": _c("external_css"),
    "inline_scripts": _c("inline_scripts"),
    "external_scripts": _c("external_scripts"),
    "script_parts": _c("inline_scripts") + _c("external_scripts"),
    "total_styles": _c("inline_styles") + _c("internal_css") + _c("external_css"),
    "uses_external_resources": _c("external_css") + _c("external_scripts") > 0,
    "has_inline_code": _c("inline_styles") + _c("inline_scripts") > 0,
}
DEPTH = lambda: {
    "total_headings": _c("total_headings"),
    "has_h1": _c("h1") > 0,
    "has_h2": _c("h2") > 0,
    "has_h3": _c("h3") > 0,
    "heading_hierarchy_optimal": hierarchy_optimal(),
    "content_depth": depth(),
}
LINKS = lambda: {
    "total_links": _c("total_links"),
    "internal_links": _c("internal_links"),
    "external_links": _c("external_links"),
    "social_links": _c("social_links"),
    "internal_ratio": ratio("internal_links"),
    "external_ratio": ratio("external_links"),
    "social_ratio": ratio("social_links"),
    "has_social_presence": _c("social_links") > 0,
    "link_quality": link_quality(),
}
MEDIA = lambda: {
    "total_images": _c("total_images"),
    "images_with_alt": with_alt(),
    "images_without_alt": _c("images_without_alt"),
    "alt_text_coverage": alt_coverage(),
    "lazy_loading_images": _c("lazy_loading_images"),
    "responsive_images": _c("responsive_images"),
    "media_richness": media_richness(),
    "seo_optimized_images": alt_share(),
}
INSIGHTS = lambda: {
    "total_scripts": _c("script_tags"),
    "total_stylesheets": _c("total_stylesheets"),
    "inline_styles": _c("inline_styles"),
    "total_images": _c("total_images"),
    "images_without_alt": _c("images_without_alt"),
    "performance_score": performance(),
    "opportunities": n(opportunities()),
}


def _group(parsed: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return measures(parsed).select("page_id", *[c.alias(k) for k, c in cols.items()])


def content_overview(parsed: DataFrame) -> DataFrame:
    return _group(parsed, OVERVIEW())


def seo_presence(parsed: DataFrame) -> DataFrame:
    return _group(parsed, SEO())


def content_richness(parsed: DataFrame) -> DataFrame:
    return _group(parsed, {"word_count": _c("word_count"), "content_richness": richness()})


def technical_counts(parsed: DataFrame) -> DataFrame:
    return _group(parsed, TECHNICAL())


def heading_structure(parsed: DataFrame) -> DataFrame:
    counts = F.array(*[F.struct(F.lit(f"H{k}").alias("level"), _c(f"h{k}").alias("cnt")) for k in range(1, 7)])
    return rows(measures(parsed), F.filter(counts, lambda x: x["cnt"] > 0)).select("page_id", "e.level", "e.cnt")


def content_types(parsed: DataFrame) -> DataFrame:
    return _group(parsed, {"content_type": content_type()})


def content_depth(parsed: DataFrame) -> DataFrame:
    return _group(parsed, DEPTH())


def _category(a: Column) -> Column:
    return let(
        F.struct(F.lower(a["text"]).alias("text"), F.lower(a["href"]).alias("href")),
        lambda low: F.when(one_of(low["text"], NAVIGATION), F.lit("navigation"))
        .when(one_of(low["text"], CALLS_TO_ACTION), F.lit("calls_to_action"))
        .when(one_of(low["href"], SOCIAL_WORDS), F.lit("social"))
        .when(~a["internal"], F.lit("external_references"))
        .otherwise(F.lit("content")),
    )


def link_category(parsed: DataFrame) -> DataFrame:
    return rows(parsed, F.transform("anchors", lambda a: F.struct(a["href"].alias("href"), _category(a).alias("category")))).select(
        "page_id", "pos", "e.*"
    )


def link_stats(parsed: DataFrame) -> DataFrame:
    return _group(parsed, LINKS())


def media_stats(parsed: DataFrame) -> DataFrame:
    return _group(parsed, MEDIA())


def performance_score(parsed: DataFrame) -> DataFrame:
    return _group(parsed, {"performance_score": performance()})


def performance_insights(parsed: DataFrame) -> DataFrame:
    return _group(parsed, INSIGHTS())


def optimization_opps(parsed: DataFrame) -> DataFrame:
    return rows(measures(parsed), opportunities(), elem="message")


def recommendation_rows(parsed: DataFrame) -> DataFrame:
    return rows(measures(parsed), recommendations(), elem="message")


def health_score(parsed: DataFrame) -> DataFrame:
    return measures(parsed).select("page_id", "url", "title", "word_count", health().alias("health_score"))


def page_analysis(parsed: DataFrame) -> DataFrame:
    """Every group of the analysis in one wide row per page."""
    cols: dict[str, Column] = {}
    for group in (OVERVIEW, SEO, TECHNICAL, DEPTH, LINKS, MEDIA, INSIGHTS):
        cols.update(group())
    cols["content_richness"] = richness()
    cols["content_type"] = content_type()
    cols["heading_structure"] = F.concat_ws(
        ",", *[F.when(_c(f"h{k}") > 0, F.concat(F.lit(f"H{k}:"), _c(f"h{k}").cast("string"))) for k in range(1, 7)]
    )
    cols["recommendations"] = n(recommendations())
    return _group(parsed, cols)


def quick_summary(parsed: DataFrame) -> DataFrame:
    kept = parsed.withColumn("kept", F.filter(T.classified(), T.is_kept))
    has = lambda t: F.exists("kept", lambda x: x["tool"] == t)
    wide = measures(kept, "kept").withColumn("tools", n(F.col("kept")))
    return wide.select(
        "page_id",
        content_type().alias("content_type"),
        "word_count",
        performance().alias("performance_score"),
        n(recommendations()).alias("seo_issues"),
        alt_coverage().alias("alt_text_coverage"),
        link_quality().alias("link_quality"),
        F.col("tools").alias("total_tracking_tools"),
        T.intensity(F.col("tools")).alias("tracking_intensity"),
        has("google_analytics").alias("has_google_analytics"),
        has("facebook_pixel").alias("has_facebook_pixel"),
    )
