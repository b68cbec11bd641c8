"""Bundles and reports: texts and long tables made from parsed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import let, n, per_jvm, rows
from . import extract as E
from . import scoring as S
from . import trackers as T

OPTIMIZATION_TYPE = "general_enhancement"


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _numbered(arr: Column, before: str, after: str, tail: Column | None = None) -> Column:
    """All elements as text, each behind its 1-based number."""

    def one(x: Column, i: Column) -> Column:
        return _text(before, (i + 1).cast("string"), after, x, "\n" if tail is None else tail)

    return F.array_join(F.transform(arr, one), "")


@per_jvm
def bundle_css() -> Column:
    return _text(
        "/* === INLINE STYLES === */\n",
        _numbered(F.col("inline_styles"), "\n/* --- Inline Style ", " --- */\n"),
        "\n\n/* === INTERNAL STYLESHEETS === */\n",
        _numbered(E.internal_css(), "\n/* --- Internal Stylesheet ", " --- */\n"),
        "\n\n/* === EXTERNAL STYLESHEETS === */\n",
        _numbered(E.external_css(), "/* ", ". ", F.lit(" */\n")),
    )


@per_jvm
def bundle_js() -> Column:
    return _text(
        "// === INLINE SCRIPTS ===\n",
        _numbered(E.inline_scripts(), "\n// --- Inline Script ", " ---\n"),
        "\n\n// === EXTERNAL SCRIPTS ===\n",
        _numbered(E.external_scripts(), "// ", ". "),
    )


def _stamp() -> Column:
    return F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss")


def iso(ts: str) -> Column:
    """ISO form; a fraction of a second is written only where there is one."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(r"\.000000$"), F.lit(""))


@per_jvm
def bundle_links() -> Column:
    return _text(
        "Links found on: ", F.col("url"), "\nScraped on: ", _stamp(), "\n" + "=" * 50 + "\n\n",
        _numbered(F.transform("anchors", lambda a: a["href"]), "", ". "),
    )


@per_jvm
def bundle_seo_report() -> Column:
    def section(prefix: str) -> Column:
        used = F.filter("meta_dict", lambda m: m["name"].startswith(prefix))
        return F.array_join(F.transform(used, lambda m: _text("  ", m["name"], ": ", m["content"], "\n")), "")

    return _text(
        "SEO Analysis Report for: ", F.col("url"), "\nGenerated on: ", _stamp(), "\n" + "=" * 80 + "\n\nMETA TAGS:\n",
        section(""), "\nOPEN GRAPH TAGS:\n", section("og:"), "\nTWITTER CARD TAGS:\n", section("twitter:"),
    )


def _map_of(arr: Column) -> Column:
    return F.map_from_entries(arr)


# Record fields of each tool in the metadata document, and the flags of its summary.
TOOL_FIELDS = {
    "google_analytics": ["version", "tracking_id", "measurement_id"],
    "facebook_pixel": ["pixel_id"],
    "google_tag_manager": ["container_id"],
    "hotjar": ["site_id"],
    "mixpanel": ["project_token"],
    "other_tracking": [],
}
SUMMARY_FLAGS = {
    "has_google_analytics": "google_analytics",
    "has_facebook_pixel": "facebook_pixel",
    "has_gtm": "google_tag_manager",
    "has_hotjar": "hotjar",
    "has_mixpanel": "mixpanel",
}
EMPTY_LISTS = ["ecommerce_tracking", "conversion_tracking", "heatmap_tracking", "session_recording"]


def tracker_document() -> Column:
    """Records of each tool, social metas, lists that are declared but never filled, and the summary."""

    def of(kept: Column) -> Column:
        def record(x: Column, tool: str) -> Column:
            known = lambda f: x[f] if f in ("version", "tracking_id", "measurement_id") else x["tool_id"]
            return F.struct(
                F.lit(tool).alias("type"), *[known(f).alias(f) for f in TOOL_FIELDS[tool]],
                x["preview"].alias("content_preview"), x["src"].alias("src"),
            )

        def records(tool: str) -> Column:
            return F.transform(F.filter(kept, lambda x: x["tool"] == tool), lambda x: record(x, tool))

        lists = {t: records(t) for t in TOOL_FIELDS}
        social = F.transform(T.social_metas(), lambda m: F.struct(m["type"].alias("type"), m["name"].alias("name"), m["content"].alias("content")))
        total = F.size(kept)
        summary = F.struct(
            total.cast("bigint").alias("total_tracking_tools"),
            *[(F.size(lists[t]) > 0).alias(k) for k, t in SUMMARY_FLAGS.items()],
            (F.size(social) > 0).alias("has_social_tracking"),
            T.intensity(total).alias("tracking_intensity"),
        )
        return F.struct(
            *[c.alias(t) for t, c in lists.items()], social.alias("social_media_tracking"),
            *[F.array().cast("array<string>").alias(k) for k in EMPTY_LISTS], summary.alias("analytics_summary"),
        )

    return let(F.filter(T.classified(), T.is_kept), of)


def bundle_metadata(location: Column) -> Column:
    """The nested metadata document."""
    tokens = lambda rel: F.filter(F.split(F.coalesce(rel, F.lit("")), r"\s+"), lambda t: t != "")
    meta = lambda prefix: _map_of(F.filter("meta_dict", lambda m: m["name"].startswith(prefix)))
    texts = lambda k: F.transform(F.filter("headings", lambda h: h["level"] == k), lambda h: h["text"])
    link = lambda keep: F.transform(F.filter("anchors", keep), lambda a: a.dropFields("netloc", "internal", "social").withField("rel", tokens(a["rel"])))
    seo = F.struct(
        meta("").alias("meta_tags"),
        meta("og:").alias("open_graph"),
        meta("twitter:").alias("twitter_cards"),
        F.transform(E.json_ld(), lambda b: F.parse_json(b)).alias("structured_data"),
        F.struct(*[texts(k).alias(f"h{k}") for k in range(1, 7)]).alias("headings"),
        F.col("images"),
        link(lambda a: a["internal"]).alias("internal_links"),
        link(lambda a: ~a["internal"]).alias("external_links"),
        link(lambda a: a["social"]).alias("social_links"),
        E.first_link("canonical").alias("canonical_url"),
        E.last_meta("robots").alias("robots_directive"),
        E.last_meta("language").alias("language"),
        E.last_meta("charset").alias("charset"),
        E.last_meta("viewport").alias("viewport"),
        E.first_link("icon").alias("favicon"),
        E.first_link("sitemap").alias("sitemap"),
        F.transform(E.feeds(), lambda x: x.dropFields("rel")).alias("rss_feeds"),
        F.transform(
            E.script_hits(), lambda x: F.struct(x["type"].alias("type"), x["src"].alias("src"), x["preview"].alias("content_preview"))
        ).alias("analytics"),
        n(F.col("words")).alias("word_count"),
        _map_of(F.transform("keywords", lambda k: k.dropFields("rank"))).alias("keyword_density"),
        F.struct(*[c.alias(k.replace("styled_elements", "inline_styles")) for k, c in E.speed_columns().items()]).alias("page_speed_indicators"),
        tracker_document().alias("detailed_analytics"),
    )
    stats = F.struct(
        n(F.col("anchors")).alias("links_count"),
        n(F.col("inline_styles")).alias("inline_styles_count"),
        n(E.internal_css()).alias("internal_stylesheets_count"),
        n(E.external_css()).alias("external_stylesheets_count"),
        n(E.inline_scripts()).alias("inline_scripts_count"),
        n(E.external_scripts()).alias("external_scripts_count"),
    )
    return F.to_json(
        F.struct(
            F.col("url").alias("original_url"),
            iso("scraped_at").alias("scraped_at"),
            "title",
            location.alias("s3_location"),
            stats.alias("stats"),
            seo.alias("seo_metadata"),
        ),
        {"ignoreNullFields": "false"},
    )


_FIELDS = {
    "images": ["src", "alt", "title", "width", "height", "loading", "decoding"],
    "internal_links": ["href", "full_url", "text", "title", "rel", "target"],
    "external_links": ["href", "full_url", "text", "title", "rel", "target"],
    "social_links": ["href", "full_url", "text", "title", "rel", "target"],
    "rss_feeds": ["href", "title", "type"],
    "analytics": ["type", "src", "content_preview"],
}
_MAPS = ["meta_tags", "open_graph", "twitter_cards", "keyword_density", "page_speed_indicators"]
_TEXTS = ["canonical_url", "robots_directive", "language", "charset", "viewport", "favicon", "sitemap", "word_count"]


def metadata_schema() -> str:
    """Of the metadata document, as DDL."""
    lists = [f"{k}: array<struct<{', '.join(f'{f}: ' + ('array<string>' if f == 'rel' else 'string') for f in v)}>>" for k, v in _FIELDS.items()]
    parts = [
        *[f"{k}: map<string,string>" for k in _MAPS], *lists, *[f"{k}: string" for k in _TEXTS], "headings: map<string,array<string>>",
        "detailed_analytics: struct<analytics_summary: map<string,string>>",
    ]
    return f"original_url string, scraped_at string, title string, s3_location string, stats map<string,string>, seo_metadata struct<{', '.join(parts)}>"


def metadata_rows(bundles: DataFrame) -> DataFrame:
    """The whole metadata document (``page_id``, ``body``) as rows: ``section``, ``pos`` (from 1; 0 for single values), ``name``, ``value``.

    Lists give a row per element and field, maps a row per entry, in their order. Nulls are left out.
    """
    doc = bundles.select("page_id", F.from_json("body", metadata_schema()).alias("d"))
    seo = lambda k: F.col(f"d.seo_metadata.{k}")
    row = lambda section, pos, name, value: F.struct(
        F.lit(section).alias("section"), pos.cast("bigint").alias("pos"), name.alias("name"), value.cast("string").alias("value")
    )
    of_map = lambda k, m: F.transform(F.map_entries(m), lambda e, i: row(k, i + 1, e["key"], e["value"]))
    text = lambda x, f: F.array_join(x[f], " ") if f == "rel" else x[f]

    def of_list(k: str, fields: list[str]) -> Column:
        return F.flatten(F.transform(seo(k), lambda x, i: F.array(*[row(k, i + 1, F.lit(f), text(x, f)) for f in fields])))

    single = [row("page", F.lit(0), F.lit(k), F.col(f"d.{k}")) for k in ("original_url", "scraped_at", "title", "s3_location")]
    single += [row("page", F.lit(0), F.lit(k), seo(k)) for k in _TEXTS]
    heads = F.flatten(F.transform(F.map_entries(seo("headings")), lambda e: F.transform(e["value"], lambda t, i: row("headings", i + 1, e["key"], t))))
    parts = [
        F.array(*single), of_map("stats", F.col("d.stats")), *[of_map(k, seo(k)) for k in _MAPS], heads, *[of_list(k, f) for k, f in _FIELDS.items()],
        of_map("analytics_summary", seo("detailed_analytics.analytics_summary")),
    ]
    return doc.select("page_id", F.explode(F.concat(*parts)).alias("r")).select("page_id", "r.*").filter("value IS NOT NULL")


def prepared(parsed: DataFrame) -> DataFrame:
    """Parsed pages with the columns that several reports read."""
    return parsed.withColumns({"meta_dict": E.meta_dict(), "keywords": E.keywords()})


def write_bundle(pages: DataFrame, bucket: str, only: str | None = None) -> DataFrame:
    """One row per page and artifact (or of one artifact), with its object key."""
    prefix = F.col("saved_directory")
    parts = {
        "index.html": lambda: F.col("html"),
        "styles.css": bundle_css,
        "scripts.js": bundle_js,
        "links.txt": bundle_links,
        "metadata.json": lambda: bundle_metadata(_text(f"s3://{bucket}/", prefix)),
        "seo_report.txt": bundle_seo_report,
    }
    made = {k: make() for k, make in parts.items() if only in (None, k)}
    arr = F.array(*[F.struct(F.lit(k).alias("artifact"), c.alias("body")) for k, c in made.items()])
    out = rows(pages, arr, keep=["page_id", "saved_directory"])
    return out.select("page_id", "e.artifact", _text(prefix, "/", F.col("e.artifact")).alias("key"), "e.body")


# ---- long report ------------------------------------------------------------
def _row(metric, value: Column, category: str) -> Column:
    return F.struct(
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
        F.coalesce(value.cast("string"), F.lit("")).alias("value"),
        F.lit(category).alias("category"),
    )


def _tags(prefix: str, label: str, category: str) -> Column:
    used = F.filter("meta_dict", lambda m: m["name"].startswith(prefix))
    return F.transform(used, lambda m: _row(_text(label, m["name"]), m["content"], category))


@per_jvm
def _report_rows() -> Column:
    c = F.col
    head = [
        _row("URL", c("url"), "Basic Info"),
        _row("Title", c("title"), "Basic Info"),
        _row("Scraped At", iso("scraped_at"), "Basic Info"),
        _row("Word Count", c("word_count"), "Content"),
        _row("Meta Description", c("meta_description"), "Meta Tags"),
        _row("Canonical URL", c("canonical_url"), "Meta Tags"),
        _row("Robots Directive", c("robots"), "Meta Tags"),
        _row("Language", c("language"), "Meta Tags"),
        _row("Charset", c("charset"), "Meta Tags"),
        _row("Viewport", c("viewport"), "Meta Tags"),
        _row("Favicon", c("favicon"), "Meta Tags"),
        _row("Sitemap", c("sitemap"), "Meta Tags"),
        *[_row(f"H{k} Count", c(f"h{k}"), "Headings") for k in range(1, 7)],
        _row("Total Images", c("total_images"), "Images"),
        _row("Images with Alt Text", S.with_alt(), "Images"),
        _row("Images without Alt Text", c("images_without_alt"), "Images"),
        _row(
            "Alt Text Coverage %",
            F.when(c("total_images") == 0, F.lit("0")).otherwise(F.bround(S.alt_coverage(), 2).cast("string")),
            "Images",
        ),
        _row("Internal Links", c("internal_links"), "Links"),
        _row("External Links", c("external_links"), "Links"),
        _row("Social Links", c("social_links"), "Links"),
        _row("Total Links", c("total_links"), "Links"),
    ]
    speed = {
        "total_images": "total_images", "images_without_alt": "images_without_alt", "total_scripts": "script_tags",
        "total_stylesheets": "total_stylesheets", "inline_styles": "inline_styles", "total_links": "total_links",
    }
    tail = [
        _row("Structured Data Blocks", c("structured_data_blocks"), "Structured Data"),
        _row("Analytics Tools", c("script_hits"), "Analytics"),
        _row("RSS Feeds", c("feeds"), "Feeds"),
        *[_row(f"Speed: {k}", c(v), "Performance") for k, v in speed.items()],
    ]
    words = F.transform(
        F.slice("keywords", 1, 10),
        lambda k: _row(
            _text("Keyword ", k["rank"].cast("string")), _text(k["word"], " (", k["cnt"].cast("string"), ")"), "Keywords"
        ),
    )
    return F.concat(
        F.array(*head),
        _tags("og:", "OG: ", "Open Graph"),
        _tags("twitter:", "Twitter: ", "Twitter Cards"),
        F.array(*tail),
        words,
    )


def seo_csv(pages: DataFrame, *keep: str) -> DataFrame:
    """(row_ord, metric, value, category) per page, in the order of the download."""
    m = S.measures(pages, "scraped_at", "meta_dict", "keywords", *keep)
    return rows(m, _report_rows(), pos="row_ord", keep=["page_id", *keep]).select("page_id", *keep, "row_ord", "e.*")


def project_seo_csv(projects: DataFrame, pages: DataFrame) -> DataFrame:
    """The same report per project, behind three rows about the project."""
    owned = projects.select("project_id", "name", "domain", F.col("scraped_files_path").alias("saved_directory")).filter(
        "saved_directory <> ''"
    )
    report = seo_csv(pages, "saved_directory")
    body = report.join(owned, "saved_directory").select(
        "project_id", (F.col("row_ord") + 3).alias("row_ord"), "metric", "value", "category"
    )
    info = [_row("Project ID", F.col("project_id"), "Project Info"), _row("Project Name", F.col("name"), "Project Info"),
            _row("Domain", F.col("domain"), "Project Info")]
    with_page = owned.join(pages.select("saved_directory"), "saved_directory", "left_semi")
    head = rows(with_page, F.array(*info), pos="row_ord", keep=["project_id"]).select("project_id", "row_ord", "e.*")
    return head.unionByName(body)


def report_analysis(pages: DataFrame) -> DataFrame:
    top = F.array_join(F.transform("keywords", lambda k: _text(k["word"], ":", k["cnt"].cast("string"))), ",")
    return pages.select(
        F.col("url").alias("original_url"),
        iso("scraped_at").alias("scraped_at"),
        "title",
        n(F.col("words")).alias("word_count"),
        top.alias("top_keywords"),
        *[c.alias(k) for k, c in E.speed_columns().items()],
    )


def report_analytics(parsed: DataFrame) -> DataFrame:
    """Tracker details and script hits, one row per finding."""
    found = F.transform(
        F.filter(T.classified(), T.is_kept),
        lambda x: F.struct(F.lit("tracker").alias("kind"), x["tool"].alias("type"), x["tool_id"].alias("id"), x["src"].alias("src")),
    )
    hits = F.transform(
        E.script_hits(),
        lambda x: F.struct(F.lit("script").alias("kind"), x["type"].alias("type"), F.lit(None).cast("string").alias("id"), x["src"].alias("src")),
    )
    return rows(parsed, F.concat(found, hits)).select("page_id", "pos", "e.*")


def opt_snapshot(parsed: DataFrame, profiles: list[str]) -> DataFrame:
    """Per page and profile the numbers and the preview an optimized page shows."""
    profile = F.explode(F.array(*[F.lit(p) for p in profiles])).alias("user_profile")
    base = parsed.select(
        "page_id",
        F.col("url").alias("original_url"),
        "title",
        n(F.col("anchors")).alias("links"),
        n(F.col("inline_styles")).alias("inline_styles"),
        n(E.internal_css()).alias("internal_css"),
        n(E.inline_scripts()).alias("inline_scripts"),
        _text(F.left("html", F.lit(2000)), "...").alias("content_preview"),
        F.lit(OPTIMIZATION_TYPE).alias("optimization_type"),
    )
    return base.select("*", profile)
