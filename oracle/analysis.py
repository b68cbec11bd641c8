"""Checks of tracking tags, scores and classification."""

from .common import CTES, WS, preview, sql

_GA = "(contains(body, 'gtag') OR contains(body, 'ga(') OR contains(s, 'google-analytics'))"
CTES["trk0"] = (
    "SELECT page_id, pos AS script, body, s, CASE"
    f" WHEN {_GA} THEN 'google_analytics'"
    " WHEN contains(body, 'googletagmanager') OR contains(s, 'googletagmanager') THEN 'google_tag_manager'"
    " WHEN contains(body, 'fbq') OR contains(s, 'facebook') THEN 'facebook_pixel'"
    " WHEN contains(body, 'hotjar') OR contains(s, 'hotjar') THEN 'hotjar'"
    " WHEN contains(body, 'mixpanel') OR contains(s, 'mixpanel') THEN 'mixpanel'"
    " WHEN regexp_matches(lower(body), 'clarity|crazyegg|optimizely|vwo|abtasty') THEN 'other_tracking' END AS tool"
    " FROM (SELECT *, coalesce(src, '') AS s FROM script)"
)
CTES["trk"] = (
    "SELECT page_id, script, tool, s AS src, " + preview("body") + " AS preview,"
    " nullif(regexp_extract(body, 'G-[A-Z0-9]{10}'), '') AS g, nullif(regexp_extract(body, 'UA-[0-9]+-[0-9]+'), '') AS ua,"
    " nullif(CASE tool WHEN 'google_analytics' THEN regexp_extract(body, 'UA-[0-9]+-[0-9]+|G-[A-Z0-9]{10}')"
    " WHEN 'google_tag_manager' THEN regexp_extract(body, 'GTM-[A-Z0-9]{7}')"
    " WHEN 'facebook_pixel' THEN regexp_extract(body, 'fbq\\([''\"]init[''\"],\\s*[''\"]([0-9]{9,15})[''\"]', 1)"
    " WHEN 'hotjar' THEN regexp_extract(body, 'hjid:\\s*([0-9]+)', 1)"
    " WHEN 'mixpanel' THEN regexp_extract(body, 'mixpanel\\.init\\([''\"]([a-zA-Z0-9]{32})[''\"]', 1) END, '') AS id"
    " FROM trk0 WHERE tool IS NOT NULL"
)
CTES["tools"] = (
    "SELECT g.page_id, count(t.tool) AS total, count(*) FILTER (WHERE t.tool = 'google_analytics') AS ga, count(*) FILTER (WHERE t.tool = 'facebook_pixel') AS fb,"
    " count(*) FILTER (WHERE t.tool = 'google_tag_manager') AS gtm, count(*) FILTER (WHERE t.tool = 'hotjar') AS hj, count(*) FILTER (WHERE t.tool = 'mixpanel') AS mp,"
    " count(*) FILTER (WHERE t.tool = 'other_tracking') AS other"
    " FROM pg g LEFT JOIN (SELECT * FROM trk WHERE tool = 'other_tracking' OR id IS NOT NULL) t ON t.page_id = g.page_id GROUP BY g.page_id"
)
CTES["socmeta"] = (
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, type, name, content FROM ("
    "SELECT page_id, pos, name, content, CASE WHEN regexp_matches(lower(name), 'facebook|fb:') THEN 'facebook_meta'"
    " WHEN contains(lower(name), 'twitter') THEN 'twitter_meta' END AS type FROM meta0) WHERE type IS NOT NULL"
)
CTES["lvl"] = (
    "SELECT page_id, total, CASE WHEN total = 0 THEN 'None' WHEN total = 1 THEN 'Light' WHEN total <= 3 THEN 'Moderate'"
    " WHEN total <= 5 THEN 'Heavy' ELSE 'Very Heavy' END AS intensity FROM tools"
)
CTES["m"] = (
    "SELECT g.url, g.html, cnt.*, ttl.title, wc.word_count, firsts.canonical_url, firsts.favicon, firsts.sitemap,"
    " direct.robots, direct.description, greatest(links, 1) AS nl,"
    " CASE WHEN total_images = 0 THEN 0.0::DOUBLE ELSE (total_images - images_without_alt) / total_images END AS alt_share"
    " FROM pg g JOIN cnt ON cnt.page_id = g.page_id JOIN ttl ON ttl.page_id = g.page_id JOIN wc ON wc.page_id = g.page_id"
    " JOIN firsts ON firsts.page_id = g.page_id JOIN direct ON direct.page_id = g.page_id"
)
_yes = lambda c: f"coalesce({c} <> '', false)"
OVERVIEW = (
    f"CAST(length(html) AS BIGINT) AS total_characters, CAST(len(regexp_extract_all(html, '[^{WS[1:-1]}]+')) AS BIGINT) AS total_words,"
    " strlen(html) / 1048576 AS content_size_mb, title, " + _yes("title") + " AS has_title,"
    " CAST(length(coalesce(title, '')) AS BIGINT) AS title_length, length(coalesce(title, '')) BETWEEN 50 AND 60 AS title_optimal"
)
SEO = (
    "metas AS meta_tags_count, og AS open_graph_tags, tw AS twitter_cards, json_ld AS structured_data_blocks, "
    + ", ".join(f"{_yes(c)} AS {n}" for c, n in (("canonical_url", "has_canonical"), ("robots", "has_robots"), ("favicon", "has_favicon"), ("sitemap", "has_sitemap")))
    + ", word_count"
)
RICH = "CASE WHEN word_count > 1000 THEN 'High' WHEN word_count > 300 THEN 'Medium' ELSE 'Low' END"
TECH = (
    "styled_elements AS inline_styles, internal_css AS internal_stylesheets, external_css AS external_stylesheets, inline_scripts,"
    " external_scripts, inline_scripts + external_scripts AS script_parts, styled_elements + internal_css + external_css AS total_styles,"
    " external_css + external_scripts > 0 AS uses_external_resources, styled_elements + inline_scripts > 0 AS has_inline_code"
)
TYPE = (
    "CASE WHEN headings = 0 THEN 'Simple Page' WHEN h1 = 1 AND headings <= 5 THEN 'Landing Page' WHEN headings > 10 THEN 'Content-Rich Page'"
    " WHEN h2 > 3 THEN 'Article/Blog Post' WHEN h3 > 5 THEN 'Product/Service Page' ELSE 'Unknown' END"
)
DEPTH = (
    "headings AS total_headings, h1 > 0 AS has_h1, h2 > 0 AS has_h2, h3 > 0 AS has_h3, h1 = 1 AND h2 > 0 AS heading_hierarchy_optimal,"
    " CASE WHEN headings > 15 THEN 'Deep' WHEN headings > 5 THEN 'Medium' ELSE 'Shallow' END AS content_depth"
)
QUALITY = "CASE WHEN internal_links > external_links THEN 'Good' ELSE 'Needs Improvement' END"
LINKS = (
    "links AS total_links, internal_links, external_links, social_links, internal_links / nl AS internal_ratio,"
    f" external_links / nl AS external_ratio, social_links / nl AS social_ratio, social_links > 0 AS has_social_presence, {QUALITY} AS link_quality"
)
MEDIA = (
    "total_images, total_images - images_without_alt AS images_with_alt, images_without_alt, alt_share * 100 AS alt_text_coverage,"
    " lazy_images AS lazy_loading_images, sized_images AS responsive_images,"
    " CASE WHEN total_images > 10 THEN 'High' WHEN total_images > 3 THEN 'Medium' ELSE 'Low' END AS media_richness, alt_share AS seo_optimized_images"
)
PERF = (
    "CAST(greatest(100 - CASE WHEN total_scripts > 20 THEN 20 WHEN total_scripts > 10 THEN 10 ELSE 0 END"
    " - CASE WHEN styled_elements > 50 THEN 15 WHEN styled_elements > 20 THEN 7 ELSE 0 END"
    " - CASE WHEN images_without_alt > 0 THEN 10 ELSE 0 END, 0) AS BIGINT)"
)
_no = lambda c: f"coalesce({c}, '') = ''"
OPPS = [
    ("total_scripts > 15", "Consider reducing the number of scripts"),
    ("styled_elements > 30", "Move inline styles to external stylesheets"),
    ("images_without_alt > 0", "Add alt text to all images for better SEO"),
    ("word_count < 300", "Consider adding more content for better SEO"),
    (_no("canonical_url"), "Add canonical URL to prevent duplicate content issues"),
    (_no("sitemap"), "Consider adding a sitemap for better search engine indexing"),
]
RECS = [
    ("word_count < 300", "📝 Add more content - aim for at least 300 words for better SEO"),
    (_no("canonical_url"), "🔗 Add canonical URL to prevent duplicate content issues"),
    ("alt_share * 100 < 80", "🖼️ Improve image alt text coverage - aim for 100%"),
    (_no("favicon"), "🎨 Add a favicon for better brand recognition"),
    ("total_scripts > 15", "⚡ Reduce number of scripts to improve page load speed"),
    ("styled_elements > 30", "🎨 Move inline styles to external stylesheets"),
    ("NOT (h1 = 1 AND h2 > 0)", "📋 Optimize heading hierarchy - use one H1 and proper H2-H6 structure"),
    ("external_links / nl > 0.5", "🔗 Balance internal vs external links - prioritize internal linking"),
    ("word_count <= 300", "📚 Enhance content depth with more detailed information"),
    ("social_links = 0", "📱 Add social media links for better engagement"),
]


def _number(rules):
    return "CAST(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in rules) + " AS BIGINT)"


def _message_rows(rules):
    union = " UNION ALL ".join(f"SELECT page_id, {i} AS o, '{t}' AS message FROM m WHERE {c}" for i, (c, t) in enumerate(rules))
    return f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) AS pos, message FROM ({union})"


INSIGHTS = (
    f"total_scripts, total_stylesheets, styled_elements AS inline_styles, total_images, images_without_alt, {PERF} AS performance_score,"
    f" {_number(OPPS)} AS opportunities"
)
HEALTH = (
    "CAST(greatest(0, least(100, 100 - CASE WHEN " + _yes("title") + " THEN 0 ELSE 15 END - CASE WHEN " + _yes("description")
    + " THEN 0 ELSE 10 END - CASE WHEN " + _yes("canonical_url") + " THEN 0 ELSE 5 END - least(10, images_without_alt * 2)"
    " - CASE WHEN word_count < 300 THEN 10 WHEN word_count < 500 THEN 5 ELSE 0 END - CASE WHEN script_hits > 5 THEN 5 ELSE 0 END)) AS BIGINT)"
)
CTES["hs"] = f"SELECT page_id, url, title, word_count, {HEALTH} AS health_score FROM m"


def _drop(cols: str, *names: str) -> str:
    """Leave out columns another group already has."""
    out, level, cur = [], 0, ""
    for ch in cols:
        level += (ch == "(") - (ch == ")")
        if ch == "," and level == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    out.append(cur)
    return ", ".join(c for c in out if c.strip().split(" AS ")[-1].strip() not in names)


_ids = lambda tool, name: f"SELECT page_id, script, id AS {name}, src, preview FROM trk WHERE tool = '{tool}' AND id IS NOT NULL"
_cat = (
    "CASE WHEN regexp_matches(lower(text), 'home|menu|about|contact|services') THEN 'navigation'"
    " WHEN regexp_matches(lower(text), 'read more|learn more|click here|view') THEN 'calls_to_action'"
    " WHEN regexp_matches(lower(href), 'facebook|twitter|instagram|linkedin|youtube') THEN 'social'"
    " WHEN NOT internal THEN 'external_references' ELSE 'content' END"
)
_levels = " || ".join(f"CASE WHEN h{i} > 0 THEN ',H{i}:' || h{i} ELSE '' END" for i in range(1, 7))

SQL = {
    "tracker_class": "SELECT page_id, script, tool, tool = 'other_tracking' OR id IS NOT NULL AS kept FROM trk",
    "tracker_ga": "SELECT page_id, script, CASE WHEN ua IS NOT NULL THEN 'Universal Analytics' ELSE 'GA4' END AS version, g AS measurement_id,"
    " ua AS tracking_id, src, preview FROM trk WHERE tool = 'google_analytics' AND id IS NOT NULL",
    "tracker_gtm": _ids("google_tag_manager", "container_id"),
    "tracker_fb": _ids("facebook_pixel", "pixel_id"),
    "tracker_hotjar": _ids("hotjar", "site_id"),
    "tracker_mixpanel": _ids("mixpanel", "project_token"),
    "tracker_other": "SELECT page_id, script, src, preview FROM trk WHERE tool = 'other_tracking'",
    "social_meta": "SELECT page_id, pos, type, name, content FROM socmeta",
    "tracker_summary": "SELECT page_id, total AS total_tracking_tools, ga > 0 AS has_google_analytics, fb > 0 AS has_facebook_pixel,"
    " gtm > 0 AS has_gtm, hj > 0 AS has_hotjar, mp > 0 AS has_mixpanel, page_id IN (SELECT page_id FROM socmeta) AS has_social_tracking FROM tools",
    "tracking_intensity": "SELECT page_id, total AS total_tracking_tools, intensity FROM lvl",
    "privacy_flag": "SELECT page_id, CASE intensity WHEN 'Heavy' THEN 'high' WHEN 'Very Heavy' THEN 'high' WHEN 'Moderate' THEN 'moderate'"
    " WHEN 'Light' THEN 'light' ELSE 'none' END AS privacy, total > 3 AS consolidate FROM lvl",
    "content_overview": f"SELECT page_id, {OVERVIEW} FROM m",
    "seo_presence": f"SELECT page_id, {SEO} FROM m",
    "content_richness": f"SELECT page_id, word_count, {RICH} AS content_richness FROM m",
    "technical_counts": f"SELECT page_id, {TECH} FROM m",
    "heading_structure": "SELECT page_id, 'H' || level AS level, count(*) AS cnt FROM head GROUP BY page_id, head.level",
    "content_type": f"SELECT page_id, {TYPE} AS content_type FROM m",
    "content_depth": f"SELECT page_id, {DEPTH} FROM m",
    "link_category": f"SELECT page_id, pos, href, {_cat} AS category FROM a",
    "link_stats": f"SELECT page_id, {LINKS} FROM m",
    "media_stats": f"SELECT page_id, {MEDIA} FROM m",
    "performance_score": f"SELECT page_id, {PERF} AS performance_score FROM m",
    "performance_insights": f"SELECT page_id, {INSIGHTS} FROM m",
    "optimization_opps": _message_rows(OPPS),
    "recommendations_gen": _message_rows(RECS),
    "health_score": "SELECT page_id, url, title, word_count, health_score FROM hs",
    "page_analysis": f"SELECT page_id, {OVERVIEW}, {SEO}, {TECH}, {DEPTH}, {LINKS}, {MEDIA}, "
    + _drop(INSIGHTS, "inline_styles", "total_images", "images_without_alt")
    + f", {RICH} AS content_richness, {TYPE} AS content_type, ({_levels})[2:] AS heading_structure, {_number(RECS)} AS recommendations FROM m",
    "quick_summary": f"SELECT m.page_id, {TYPE} AS content_type, word_count, {PERF} AS performance_score, {_number(RECS)} AS seo_issues,"
    f" alt_share * 100 AS alt_text_coverage, {QUALITY} AS link_quality, lvl.total AS total_tracking_tools, intensity AS tracking_intensity,"
    " ga > 0 AS has_google_analytics, fb > 0 AS has_facebook_pixel"
    " FROM m JOIN lvl ON lvl.page_id = m.page_id JOIN tools ON tools.page_id = m.page_id",
}
SQL = {k: sql(v) for k, v in SQL.items()}
