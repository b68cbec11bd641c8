"""Checks of bundles, reports, traffic windows and corpus comparisons."""

from . import analysis as A
from .common import CTES, sql
from .tracking import key

NL = "chr(10)"


def _list(src: str, expr: str) -> str:
    """Numbered elements of a page as one text."""
    return (
        f"coalesce((SELECT string_agg({expr}, '' ORDER BY pos) FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i"
        f" FROM {src}) z WHERE z.page_id = g.page_id), '')"
    )


_CSS = (
    f"'/* === INLINE STYLES === */' || {NL} || "
    + _list("inline_style", f"{NL} || '/* --- Inline Style ' || i || ' --- */' || {NL} || v || {NL}")
    + f" || {NL} || {NL} || '/* === INTERNAL STYLESHEETS === */' || {NL} || "
    + _list("(SELECT * FROM css WHERE body <> '')", f"{NL} || '/* --- Internal Stylesheet ' || i || ' --- */' || {NL} || body || {NL}")
    + f" || {NL} || {NL} || '/* === EXTERNAL STYLESHEETS === */' || {NL} || "
    + _list("(SELECT * FROM sheet WHERE href <> '')", f"'/* ' || i || '. ' || href || ' */' || {NL}")
)
_JS = (
    f"'// === INLINE SCRIPTS ===' || {NL} || "
    + _list("(SELECT * FROM script WHERE body <> '')", f"{NL} || '// --- Inline Script ' || i || ' ---' || {NL} || body || {NL}")
    + f" || {NL} || {NL} || '// === EXTERNAL SCRIPTS ===' || {NL} || "
    + _list("(SELECT * FROM script WHERE src IS NOT NULL)", f"'// ' || i || '. ' || src || {NL}")
)
_ST = "strftime(l.scraped_at, '%Y-%m-%d %H:%M:%S')"
_LINKS = f"'Links found on: ' || g.url || {NL} || 'Scraped on: ' || {_ST} || {NL} || repeat('=', 50) || {NL} || {NL} || " + _list(
    "a", f"i || '. ' || href || {NL}"
)
_sec = lambda p: _list(f"(SELECT * FROM meta WHERE starts_with(name, '{p}'))", f"'  ' || name || ': ' || content || {NL}")
_SEO = (
    f"'SEO Analysis Report for: ' || g.url || {NL} || 'Generated on: ' || {_ST} || {NL} || repeat('=', 80) || {NL} || {NL} || 'META TAGS:' || {NL} || "
    + _sec("") + f" || {NL} || 'OPEN GRAPH TAGS:' || {NL} || " + _sec("og:") + f" || {NL} || 'TWITTER CARD TAGS:' || {NL} || " + _sec("twitter:")
)
_STATS = (
    "'{\"links_count\":' || c.links || ',\"inline_styles_count\":' || c.styled_elements || ',\"internal_stylesheets_count\":' || c.internal_css"
    " || ',\"external_stylesheets_count\":' || c.external_css || ',\"inline_scripts_count\":' || c.inline_scripts || ',\"external_scripts_count\":'"
    " || c.external_scripts || '}'"
)
_FROM = "FROM pg g JOIN scrape_log l ON l.page_id = g.page_id JOIN cnt c ON c.page_id = g.page_id"
_ISO = "strftime(l.scraped_at, '%Y-%m-%dT%H:%M:%S')"
CTES["arts"] = " UNION ALL ".join(
    f"SELECT g.page_id, '{n}' AS artifact, {e} AS body {_FROM}"
    for n, e in (("index.html", "g.html"), ("styles.css", _CSS), ("scripts.js", _JS), ("links.txt", _LINKS), ("metadata.json", _STATS), ("seo_report.txt", _SEO))
)
CTES["mdoc"] = (
    f"SELECT m.page_id, m.url AS original_url, {_ISO} AS scraped_at, title, 's3://site-audits/scraped_sites/page_' || m.page_id AS s3_location,"
    " links AS links_count, word_count, canonical_url, description, total_images AS images, internal_links, external_links, h2,"
    " (SELECT count(*) FROM kw WHERE kw.page_id = m.page_id) AS keywords, tools.total AS tools, styled_elements AS styled, true AS structured"
    " FROM m JOIN scrape_log l ON l.page_id = m.page_id JOIN tools ON tools.page_id = m.page_id"
)
_fixed = [
    ("URL", "m.url", "Basic Info"), ("Title", "title", "Basic Info"), ("Scraped At", _ISO, "Basic Info"), ("Word Count", "word_count", "Content"),
    ("Meta Description", "m.description", "Meta Tags"), ("Canonical URL", "canonical_url", "Meta Tags"), ("Robots Directive", "m.robots", "Meta Tags"),
    ("Language", "d.language", "Meta Tags"), ("Charset", "d.charset", "Meta Tags"), ("Viewport", "d.viewport", "Meta Tags"),
    ("Favicon", "favicon", "Meta Tags"), ("Sitemap", "sitemap", "Meta Tags"),
    *[(f"H{i} Count", f"h{i}", "Headings") for i in range(1, 7)],
    ("Total Images", "total_images", "Images"), ("Images with Alt Text", "total_images - images_without_alt", "Images"),
    ("Images without Alt Text", "images_without_alt", "Images"),
    ("Alt Text Coverage %", "CASE WHEN total_images = 0 THEN '0' ELSE CAST(round_even(alt_share * 100, 2) AS VARCHAR) END", "Images"),
    ("Internal Links", "internal_links", "Links"), ("External Links", "external_links", "Links"), ("Social Links", "social_links", "Links"),
    ("Total Links", "links", "Links"),
]
_tail = [
    ("Structured Data Blocks", "json_ld", "Structured Data"), ("Analytics Tools", "script_hits", "Analytics"), ("RSS Feeds", "feeds", "Feeds"),
    ("Speed: total_images", "total_images", "Performance"), ("Speed: images_without_alt", "images_without_alt", "Performance"),
    ("Speed: total_scripts", "total_scripts", "Performance"), ("Speed: total_stylesheets", "total_stylesheets", "Performance"),
    ("Speed: inline_styles", "styled_elements", "Performance"), ("Speed: total_links", "links", "Performance"),
]
_src = "FROM m JOIN direct d ON d.page_id = m.page_id JOIN scrape_log l ON l.page_id = m.page_id"
_rows = [f"SELECT m.page_id, {i} AS o, 0 AS p, '{n}' AS metric, coalesce(CAST({e} AS VARCHAR), '') AS value, '{c}' AS category {_src}" for i, (n, e, c) in enumerate(_fixed)]
_rows += [
    "SELECT page_id, 100, pos, 'OG: ' || name, content, 'Open Graph' FROM meta WHERE starts_with(name, 'og:')",
    "SELECT page_id, 101, pos, 'Twitter: ' || name, content, 'Twitter Cards' FROM meta WHERE starts_with(name, 'twitter:')",
]
_rows += [f"SELECT m.page_id, {200 + i}, 0, '{n}', CAST({e} AS VARCHAR), '{c}' {_src}" for i, (n, e, c) in enumerate(_tail)]
_rows += ["SELECT page_id, 300, rank, 'Keyword ' || rank, word || ' (' || cnt || ')', 'Keywords' FROM kw WHERE rank <= 10"]
CTES["csv"] = (
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o, p) AS row_ord, metric, value, category FROM (" + " UNION ALL ".join(_rows) + ")"
)
CTES["own"] = (
    "SELECT p.project_id, p.name, p.domain, g.page_id FROM projects p JOIN pg g ON 'scraped_sites/page_' || g.page_id = p.scraped_files_path"
)
_PAIRS = [(a, b) for i, a in enumerate(("ga", "gtm", "fb", "hj", "mp", "other")) for b in ("ga", "gtm", "fb", "hj", "mp", "other")[i + 1 :]]
_NAME = {"ga": "google_analytics", "gtm": "google_tag_manager", "fb": "facebook_pixel", "hj": "hotjar", "mp": "mixpanel", "other": "other_tracking"}
CTES["ts_tools"] = f"SELECT tools.*, {key('g.url')} AS site FROM tools JOIN pg g ON g.page_id = tools.page_id"
CTES["edge"] = (
    f"SELECT {key('g.url')} AS src_site, replace(lower(netloc), 'www.', '') AS dst_site, count(*) AS links FROM a JOIN pg g ON g.page_id = a.page_id"
    " WHERE NOT internal AND netloc <> '' GROUP BY ALL"
)
CTES["hosts"] = (
    f"SELECT {key('hs.url')} AS site_key, count(*) AS pages, round(sum(health_score) / count(*), 2) AS mean_score, sum(hs.word_count)::BIGINT AS words,"
    " sum(links)::BIGINT AS links FROM hs JOIN cnt ON cnt.page_id = hs.page_id GROUP BY 1"
)
CTES["miss"] = (
    f"SELECT {key('url')} AS site_key, coalesce(title, '') IN ('', 'No title found') AS no_title, {A._no('description')} AS no_description,"
    f" {A._no('canonical_url')} AS no_canonical, {A._no('robots')} AS no_robots, {A._no('favicon')} AS no_favicon, {A._no('sitemap')} AS no_sitemap, h1 = 0 AS no_h1 FROM m"
)
_misses = ["no_title", "no_description", "no_canonical", "no_robots", "no_favicon", "no_sitemap", "no_h1"]
_limit = lambda unit, k, src="busy_requests": f"SELECT client, date_trunc('{unit}', ts) AS window_start, count(*) AS requests FROM {src} GROUP BY ALL HAVING count(*) > {k}"
_F = ["remote_addr", "remote_user", "time_local", "request", "status", "body_bytes_sent", "http_referer", "http_user_agent", "http_x_forwarded_for"]
_P = r'^(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+) "([^"]*)" "([^"]*)" "([^"]*)"$'
_art = lambda name, col: f"SELECT page_id, body AS {col} FROM arts WHERE artifact = '{name}'"
_T = "TIMESTAMP '2024-01-30 12:00:00'"



def _list_rows(section: str, src: str, fields: dict[str, str], where: str = "true") -> str:
    """A row per element of ``src`` and field."""
    numbered = f"(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM {src} WHERE {where})"
    return " UNION ALL ".join(f"SELECT page_id, '{section}' AS section, i AS pos, '{n}' AS name, CAST({e} AS VARCHAR) AS value FROM {numbered}" for n, e in fields.items())


_link = {"href": "href", "full_url": "full_url", "text": "text", "title": "title", "rel": "array_to_string(regexp_extract_all(coalesce(rel, ''), '\\S+'), ' ')", "target": "target"}
_once = {"original_url": "original_url", "scraped_at": "scraped_at", "title": "title", "s3_location": "s3_location", "canonical_url": "canonical_url", "word_count": "word_count"}
_stat = {
    "links_count": "links", "inline_styles_count": "styled_elements", "internal_stylesheets_count": "internal_css", "external_stylesheets_count": "external_css",
    "inline_scripts_count": "inline_scripts", "external_scripts_count": "external_scripts",
}
_speed = {
    "total_images": "total_images", "images_without_alt": "images_without_alt", "total_scripts": "total_scripts", "total_stylesheets": "total_stylesheets",
    "inline_styles": "styled_elements", "total_links": "links",
}
_flags = {"google_analytics": "ga", "facebook_pixel": "fb", "gtm": "gtm", "hotjar": "hj", "mixpanel": "mp"}
_summary = [
    ("total_tracking_tools", "total"), *[(f"has_{k}", f"{c} > 0") for k, c in _flags.items()],
    ("has_social_tracking", "page_id IN (SELECT page_id FROM meta WHERE contains(lower(name), 'facebook') OR contains(lower(name), 'fb:') OR contains(lower(name), 'twitter'))"),
    ("tracking_intensity", "CASE WHEN total = 0 THEN 'None' WHEN total = 1 THEN 'Light' WHEN total <= 3 THEN 'Moderate' WHEN total <= 5 THEN 'Heavy' ELSE 'Very Heavy' END"),
]
METADATA_ROWS = " UNION ALL ".join(
    [
        *[f"SELECT page_id, 'page' AS section, 0::BIGINT AS pos, '{n}' AS name, CAST({e} AS VARCHAR) AS value FROM mdoc" for n, e in _once.items()],
        *[f"SELECT page_id, 'page', 0, '{n}', {c} FROM direct" for n, c in (("robots_directive", "robots"), ("language", "language"), ("charset", "charset"), ("viewport", "viewport"))],
        *[f"SELECT page_id, 'page', 0, '{n}', {n} FROM firsts" for n in ("favicon", "sitemap")],
        *[f"SELECT page_id, 'stats', {i}, '{n}', CAST({e} AS VARCHAR) FROM cnt" for i, (n, e) in enumerate(_stat.items(), 1)],
        *[f"SELECT page_id, 'page_speed_indicators', {i}, '{n}', CAST({e} AS VARCHAR) FROM cnt" for i, (n, e) in enumerate(_speed.items(), 1)],
        *[
            f"SELECT page_id, '{n}', row_number() OVER (PARTITION BY page_id ORDER BY pos), name, content FROM meta WHERE starts_with(name, '{p}')"
            for n, p in (("meta_tags", ""), ("open_graph", "og:"), ("twitter_cards", "twitter:"))
        ],
        "SELECT page_id, 'keyword_density', rank, word, CAST(cnt AS VARCHAR) FROM kw",
        "SELECT page_id, 'headings', row_number() OVER (PARTITION BY page_id, level ORDER BY pos), 'h' || level, text FROM head",
        _list_rows("images", "img", {k: k for k in ("src", "alt", "title", "width", "height", "loading", "decoding")}),
        _list_rows("internal_links", "a", _link, "internal"),
        _list_rows("external_links", "a", _link, "NOT internal"),
        _list_rows("social_links", "a", _link, "social"),
        _list_rows("rss_feeds", "feed", {k: k for k in ("href", "title", "type")}),
        _list_rows("analytics", "hit", {"type": "type", "src": "src", "content_preview": "preview"}),
        *[f"SELECT page_id, 'analytics_summary', {i}, '{n}', CAST({e} AS VARCHAR) FROM tools" for i, (n, e) in enumerate(_summary, 1)],
    ]
)


def _burst(rate: int, burst: int) -> str:
    """Every client's requests one after the other: a recursion with a step for the k-th request of each client."""
    full = burst * 1000
    level = f"greatest(s.level - {rate} * (r.ms - s.ms), -1000)"
    return (
        "WITH RECURSIVE r AS MATERIALIZED (SELECT event_id, CAST(client AS VARCHAR) AS client, ts, epoch_ms(ts) AS ms,"
        " row_number() OVER (PARTITION BY client ORDER BY epoch_ms(ts), event_id) AS k FROM busy_requests),"
        " s AS (SELECT event_id, client, ts, ms, k, 0::BIGINT AS excess, 0::BIGINT AS level FROM r WHERE k = 1"
        f" UNION ALL SELECT r.event_id, r.client, r.ts, r.ms, r.k, {level} + 1000, CASE WHEN {level} + 1000 > {full} THEN {level} ELSE {level} + 1000 END"
        " FROM s JOIN r ON r.client = s.client AND r.k = s.k + 1)"
        f" SELECT event_id, client, ts, excess, CASE WHEN excess > {full} THEN 'rejected' WHEN excess > 0 THEN 'delayed' ELSE 'allowed' END AS decision FROM s"
    )


CTES["sw"] = f"SELECT DISTINCT {key('url')} AS site, word FROM kw JOIN pg ON pg.page_id = kw.page_id"

SQL = {
    "write_bundle": "SELECT page_id, artifact, 'scraped_sites/page_' || page_id || '/' || artifact AS key, body FROM arts",
    "bundle_css": _art("styles.css", "css"),
    "bundle_js": _art("scripts.js", "js"),
    "bundle_links": _art("links.txt", "links"),
    "bundle_metadata": "SELECT * FROM mdoc",
    "bundle_seo_report": _art("seo_report.txt", "report"),
    "seo_csv": "SELECT page_id, row_ord, metric, value, category FROM csv",
    "project_seo_csv": "SELECT project_id, row_ord + 3 AS row_ord, metric, value, category FROM own JOIN csv ON csv.page_id = own.page_id"
    " UNION ALL SELECT project_id, 1, 'Project ID', project_id, 'Project Info' FROM own UNION ALL SELECT project_id, 2, 'Project Name', name, 'Project Info' FROM own"
    " UNION ALL SELECT project_id, 3, 'Domain', domain, 'Project Info' FROM own",
    "report_analysis": f"SELECT m.url AS original_url, {_ISO} AS scraped_at, title, word_count,"
    " coalesce((SELECT string_agg(word || ':' || cnt, ',' ORDER BY rank) FROM kw WHERE kw.page_id = m.page_id), '') AS top_keywords,"
    " total_images, images_without_alt, total_scripts, total_stylesheets, styled_elements, links AS total_links"
    " FROM m JOIN scrape_log l ON l.page_id = m.page_id",
    "report_analytics": "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o, p) AS pos, kind, type, id, src FROM ("
    "SELECT page_id, 0 AS o, script AS p, 'tracker' AS kind, tool AS type, id, src FROM trk WHERE tool = 'other_tracking' OR id IS NOT NULL"
    " UNION ALL SELECT page_id, 1, pos, 'script', type, NULL, src FROM hit)",
    "report_metadata": f"SELECT * FROM ({METADATA_ROWS}) WHERE value IS NOT NULL",
    "report_seo_text": _art("seo_report.txt", "text"),
    "opt_snapshot": "SELECT m.page_id, url AS original_url, title, links, styled_elements AS inline_styles, internal_css, inline_scripts,"
    " html[1:2000] || '...' AS content_preview, 'general_enhancement' AS optimization_type, unnest(['developer', 'marketer', 'shopper']) AS user_profile FROM m",
    "request_rate_5m": "SELECT method, endpoint, window_start, count(*) AS requests, count(*) / 300 AS rate FROM ("
    "SELECT method, endpoint, date_trunc('minute', ts) - unnest([0, 1, 2, 3, 4]) * INTERVAL 1 MINUTE AS window_start FROM requests) GROUP BY ALL",
    "latency_p95_5m": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, round(quantile_cont(latency, 0.95), 6) AS p95, count(*) AS requests FROM requests GROUP BY 1",
    "latest_gauge": "SELECT method, arg_max(latency, (ts, event_id)) AS value, arg_max(latency, (ts, event_id)) / 1048576 AS value_mb FROM requests GROUP BY method",
    "rate_limit_hour": _limit("hour", 100),
    "rate_limit_day": _limit("day", 1000),
    "rate_limit_second": _limit("second", 10),
    "rate_limit_hour_low": _limit("hour", 1, "requests"),
    "rate_limit_day_low": _limit("day", 3, "requests"),
    "rate_limit_second_low": _limit("second", 0, "requests"),
    "rate_limit_second_login": _limit("second", 2),
    "access_log_parse": f"SELECT event_id, regexp_matches(line, '{_P}') AS ok, "
    + ", ".join(
        f"{'CAST(' if f in ('status', 'body_bytes_sent') else ''}nullif(regexp_extract(line, '{_P}', {i + 1}), ''){' AS BIGINT)' if f in ('status', 'body_bytes_sent') else ''} AS {f}"
        for i, f in enumerate(_F)
    )
    + " FROM access_lines",
    "rate_limit_burst": f"SELECT * FROM ({_burst(10, 20)})",
    "rate_limit_burst_scrape": f"SELECT * FROM ({_burst(2, 5)})",
    "access_log_files": "SELECT "
    + ", ".join(f"{'CAST(' if f in ('status', 'body_bytes_sent') else ''}regexp_extract(line, '{_P}', {i + 1}){' AS BIGINT)' if f in ('status', 'body_bytes_sent') else ''} AS {f}" for i, f in enumerate(_F))
    + f" FROM access_lines WHERE regexp_matches(line, '{_P}')",
    "access_log_malformed": f"SELECT line FROM access_lines WHERE NOT regexp_matches(line, '{_P}')",
    "log_slices": f"SELECT count(*) FILTER (WHERE ts <= {_T} AND ts > {_T} - INTERVAL 24 HOUR) AS last_24h, count(*) FILTER (WHERE ts <= {_T} AND ts > {_T} - INTERVAL 1 HOUR) AS last_1h,"
    f" count(*) FILTER (WHERE ts <= {_T} AND CAST(ts AS DATE) = CAST({_T} AS DATE)) AS today, count(*) FILTER (WHERE ts <= {_T}) AS all_lines FROM requests",
    "missing_meta_audit": "SELECT site_key, count(*) AS pages, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in _misses)
    + ", count(*) FILTER (WHERE no_description) / count(*) AS share_no_description FROM miss GROUP BY ROLLUP (site_key)",
    "seo_change_over_time": "SELECT *, overall_score - previous AS delta FROM (SELECT project_id, health_id, ts, overall_score::BIGINT AS overall_score,"
    " lag(overall_score::BIGINT) OVER (PARTITION BY project_id ORDER BY ts, health_id) AS previous FROM site_health)",
    "competitor_compare": "SELECT *, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank FROM hosts WINDOW w AS (ORDER BY mean_score DESC)",
    "content_compare": f"SELECT content_type, content_depth, count(*) AS pages, CAST(grouping(content_type, content_depth) AS BIGINT) AS level FROM (SELECT {A.TYPE} AS content_type,"
    " CASE WHEN headings > 15 THEN 'Deep' WHEN headings > 5 THEN 'Medium' ELSE 'Shallow' END AS content_depth FROM m) GROUP BY CUBE (content_type, content_depth)",
    "shared_keywords": f"SELECT word, count(DISTINCT {key('url')}) AS sites, count(*) AS pages, sum(cnt)::BIGINT AS uses FROM kw JOIN pg ON pg.page_id = kw.page_id"
    f" GROUP BY word HAVING count(DISTINCT {key('url')}) > 1",
    "site_similarity": "SELECT site_a, site_b, shared, shared / (na + nb - shared) AS jaccard FROM (SELECT x.site AS site_a, y.site AS site_b, count(*) AS shared,"
    " (SELECT count(*) FROM sw WHERE site = x.site) AS na, (SELECT count(*) FROM sw WHERE site = y.site) AS nb"
    " FROM sw x JOIN sw y ON x.word = y.word AND x.site < y.site GROUP BY x.site, y.site) WHERE 10 * shared >= 3 * (na + nb - shared)",
    "link_opportunities": "SELECT src_site, dst_site, links FROM edge",
    "link_degrees": "SELECT site_key, count(*) FILTER (WHERE o) AS out_sites, count(*) FILTER (WHERE NOT o) AS in_sites,"
    " coalesce(sum(links) FILTER (WHERE o), 0)::BIGINT AS out_links, coalesce(sum(links) FILTER (WHERE NOT o), 0)::BIGINT AS in_links"
    " FROM (SELECT src_site AS site_key, true AS o, links FROM edge UNION ALL SELECT dst_site, false, links FROM edge) GROUP BY site_key",
    "tracker_adoption": " UNION ALL ".join(
        f"SELECT '{n}' AS tool, count(*) FILTER (WHERE {c} > 0) AS pages, count(DISTINCT site) FILTER (WHERE {c} > 0) AS sites,"
        f" count(*) FILTER (WHERE {c} > 0) / count(*) AS page_share, count(DISTINCT site) FILTER (WHERE {c} > 0) / count(DISTINCT site) AS site_share FROM ts_tools"
        for c, n in _NAME.items()
    ),
    "tool_pairs": " UNION ALL ".join(
        f"SELECT '{_NAME[a]}' AS tool_a, '{_NAME[b]}' AS tool_b, count(*) FILTER (WHERE {a} > 0 AND {b} > 0) AS pages FROM tools" for a, b in _PAIRS
    ),
    "perf_trend": "SELECT site_key, CAST(day AS VARCHAR) AS day, pages, s / pages AS mean_score, sum(s) OVER w / sum(pages) OVER w AS week_score FROM ("
    f"SELECT {key('m.url')} AS site_key, CAST(l.scraped_at AS DATE) AS day, count(*) AS pages, sum({A.PERF})::BIGINT AS s"
    " FROM m JOIN scrape_log l ON l.page_id = m.page_id GROUP BY ALL) WINDOW w AS (PARTITION BY site_key ORDER BY day ROWS 6 PRECEDING)",
}
SQL = {k: sql(v) for k, v in SQL.items()}
