"""Queries over page content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as E
from ..sources.fixtures import view
from ..sources.readers import spread


def parsed(spark: SparkSession, sf: str, *want: str) -> DataFrame:
    return E.parse_pages(spread(view(spark, sf, "web_pages"), "page_id"), *want)


def on_pages(op, *want: str):
    """Query that applies a page operator to the parsed pages."""
    return lambda spark, sf: op(parsed(spark, sf, *want))


def _texts(make, name, want):
    return on_pages(lambda p: E.text_rows(p, make(), name), want)


QUERIES = {
    "scan_pages": on_pages(E.scan_pages),
    "scan_quarantine": lambda spark, sf: E.scan_quarantine(view(spark, sf, "fetched_pages")),
    "page_title": on_pages(E.page_title, "title"),
    "meta_tags": on_pages(E.meta_tags, "metas"),
    "open_graph": on_pages(E.open_graph, "metas"),
    "twitter_cards": on_pages(E.twitter_cards, "metas"),
    "page_directives": on_pages(E.page_directives, "metas"),
    "canonical_url": on_pages(E.canonical_url, "link_tags"),
    "favicon_url": on_pages(E.favicon_url, "link_tags"),
    "sitemap_url": on_pages(E.sitemap_url, "link_tags"),
    "rss_feeds": on_pages(E.rss_feeds, "link_tags"),
    "structured_data": on_pages(E.structured_data, "scripts"),
    "structured_values": on_pages(E.structured_values, "scripts"),
    "headings": on_pages(E.headings, "headings"),
    "images": on_pages(E.images, "images"),
    "links_flat": on_pages(E.links_flat, "anchors"),
    "link_resolve": on_pages(E.link_resolve, "anchors"),
    "link_scope": on_pages(E.link_scope, "anchors"),
    "social_links": on_pages(E.social_links, "anchors"),
    "script_hits": on_pages(E.script_hit_rows, "scripts"),
    "word_count": on_pages(E.word_count, "words"),
    "top_keywords": on_pages(E.top_keyword_rows, "words"),
    "speed_indicators": on_pages(E.speed_indicators),
    "inline_styles": _texts(lambda: F.col("inline_styles"), "style", "inline_styles"),
    "internal_css": _texts(E.internal_css, "css", "styles"),
    "external_css": _texts(E.external_css, "href", "link_tags"),
    "inline_scripts": _texts(E.inline_scripts, "script", "scripts"),
    "external_scripts": _texts(E.external_scripts, "src", "scripts"),
}
