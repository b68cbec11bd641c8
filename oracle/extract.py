"""Checks of the page extraction."""

from .common import sql

SQL = {
    "scan_pages": "SELECT g.page_id, g.url, title, CAST(length(html) AS BIGINT) AS html_length, links, styled_elements AS inline_styles,"
    " internal_css, external_css, inline_scripts, external_scripts, word_count FROM pg g JOIN ttl ON ttl.page_id = g.page_id"
    " JOIN cnt ON cnt.page_id = g.page_id JOIN wc ON wc.page_id = g.page_id",
    "scan_quarantine": "SELECT page_id, url, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_scheme' WHEN html IS NULL THEN 'fetch_failed'"
    " WHEN html = '' THEN 'empty' ELSE 'ok' END AS state, CAST(coalesce(length(html), 0) AS BIGINT) AS html_length FROM fetched_pages",
    "page_title": "SELECT page_id, title FROM ttl",
    "meta_tags": "SELECT page_id, pos, name, content FROM meta",
    "open_graph": "SELECT page_id, name, content FROM meta WHERE name LIKE 'og:%'",
    "twitter_cards": "SELECT page_id, name, content FROM meta WHERE name LIKE 'twitter:%'",
    "page_directives": "SELECT page_id, robots, viewport, charset, language FROM direct",
    "canonical_url": "SELECT page_id, canonical_url FROM firsts",
    "favicon_url": "SELECT page_id, favicon FROM firsts",
    "sitemap_url": "SELECT page_id, sitemap FROM firsts",
    "rss_feeds": "SELECT page_id, pos, href, title, type FROM feed",
    "structured_data": "SELECT g.page_id, count(body) AS blocks, json_extract_string(arg_min(body, pos), '$.name') AS first_name"
    " FROM pg g LEFT JOIN ld ON ld.page_id = g.page_id GROUP BY g.page_id",
    # the given blocks are flat objects; nested ones are tested by hand
    "structured_values": "SELECT l.page_id, block, '/' || e.key AS path, CASE WHEN e.type = 'VARCHAR' THEN 'string' ELSE 'number' END AS type, e.atom ->> '$' AS value"
    " FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS block, body FROM ld) l, json_each(l.body) e",
    "headings": "SELECT page_id, pos, level, text FROM head",
    "images": "SELECT page_id, pos, src, alt, title, width, height, loading, decoding FROM img",
    "links_flat": "SELECT page_id, pos, href FROM a",
    "link_resolve": "SELECT page_id, pos, href, full_url, text, title, array_to_string(regexp_extract_all(rel, '\\S+'), ' ') AS rel, target FROM a",
    "link_scope": "SELECT page_id, pos, full_url, netloc, internal FROM a",
    "social_links": "SELECT page_id, pos, full_url FROM a WHERE social",
    "script_hits": "SELECT page_id, pos, type, src, preview FROM hit",
    "word_count": "SELECT page_id, word_count FROM wc",
    "top_keywords": "SELECT page_id, word, cnt, rank FROM kw",
    "speed_indicators": "SELECT page_id, total_images, images_without_alt, total_scripts, total_stylesheets, styled_elements, links AS total_links FROM cnt",
    "inline_styles": "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, v AS style FROM inline_style",
    "internal_css": "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, body AS css FROM css WHERE body <> ''",
    "external_css": "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, href FROM sheet WHERE href <> ''",
    "inline_scripts": "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, body AS script FROM script WHERE body <> ''",
    "external_scripts": "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, src FROM script WHERE src IS NOT NULL",
}
SQL = {k: sql(v) for k, v in SQL.items()}
