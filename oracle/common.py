"""Building blocks of the checking SQL.

The checks work on long tables (one row per token, attribute or text node)
joined and aggregated per page, where the Spark side works on arrays inside
the page row; the two share the derived input views only.
"""

from __future__ import annotations

import re

from pageprism.sources.fixtures import VIEWS, view_sql

REST = r"""[^=>]*(?:=(?:\s*"[^"]*"|\s*''[^'']*'')?[^=>]*)*"""
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<script(?:[\s/]{REST})?>.*?(?:</script\s*>|\z)"
    rf"|<style(?:[\s/]{REST})?>.*?(?:</style\s*>|\z)"
    r"|<[!?][^>]*>"
    rf"|</?[a-z]{REST}>|[^<]+|<"
)
ATTR = r"""([^\s/>=][^\s/>=]*)(?:\s*=+\s*("[^"]*"|''[^'']*''|[^\s>]*))?"""
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NAMES = (
    "MAP {'amp':'&','lt':'<','gt':'>','quot':'\"','copy':'©','middot':'·','nbsp':chr(160),'eacute':'é','iuml':'ï','euro':'€'}"
)


def decode(x: str, attribute: bool = False) -> str:
    unknown = "p" if attribute else "'&' || regexp_extract(p, '^&([a-zA-Z0-9]+)', 1)"
    return (
        f"list_aggregate(list_transform(regexp_extract_all({x}, '&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?|[^&]+|&'),"
        " lambda p: CASE WHEN p = '&' OR NOT starts_with(p, '&') THEN p"
        " WHEN regexp_matches(p, '^&#[xX]') THEN chr(CAST('0x' || regexp_extract(p, '[xX]([0-9a-fA-F]+)', 1) AS INT))"
        " WHEN starts_with(p, '&#') THEN chr(CAST(regexp_extract(p, '[0-9]+') AS INT))"
        f" ELSE coalesce({NAMES}[regexp_extract(p, '^&([a-zA-Z0-9]+)', 1)], {unknown}) END), 'string_agg', '')"
    )


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def fold(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '/(\\./)+', '/', 'g'), '/\\.$', '/')"
    for _ in range(5):
        s = f"regexp_replace(regexp_replace({s}, '^(?:/\\.\\.)+(?:/|$)', '/'), '/[^/]+/\\.\\.(?:/|$)', '/')"
    return s


def netloc(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"


def preview(x: str) -> str:
    return f"CASE WHEN length({x}) > 200 THEN {x}[1:200] || '...' ELSE {x} END"


STOP = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could "
    "should may might must can this that these those i you he she it we they me him her us them my your his its our "
    "their mine yours hers ours theirs"
).split()
PATTERNS = "google-analytics gtag ga( googletagmanager facebook fbq pixel hotjar mixpanel".split()
SOCIAL = "facebook.com twitter.com instagram.com linkedin.com youtube.com tiktok.com pinterest.com reddit.com".split()


def lit(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def any_in(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


CTES: dict[str, str] = {name: view_sql(name) for name in VIEWS}

CTES["pg"] = "SELECT * FROM web_pages"
CTES["tok"] = (
    f"SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos"
    f" FROM (SELECT page_id, regexp_extract_all(html, '{TOKEN}') AS l FROM pg)"
)
CTES["tk"] = (
    "SELECT page_id, pos, raw, CASE WHEN regexp_matches(raw, '^<[!?]') THEN '!'"
    " WHEN regexp_matches(raw, '(?i)^</?[a-z]') THEN lower(regexp_extract(raw, '^</?([a-zA-Z][^\\s/>]*)', 1)) ELSE '' END AS tag,"
    " starts_with(raw, '</') AS closing FROM tok"
)
CTES["op"] = (
    f"SELECT page_id, pos, tag, raw, regexp_extract(raw, '(?is)^<[a-z]{REST}>', 0) AS open_tag"
    " FROM tk WHERE tag NOT IN ('', '!') AND NOT closing"
)
CTES["at0"] = (
    f"SELECT page_id, pos, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM"
    f" (SELECT page_id, pos, regexp_extract_all(regexp_replace(open_tag, '^<[^\\s/>]*', ''), '{ATTR}') AS l FROM op)"
)
CTES["at1"] = (
    f"SELECT page_id, pos, i, lower(regexp_extract(a, '{ATTR}', 1)) AS k, regexp_extract(a, '{ATTR}', 2) AS r FROM at0"
)
CTES["attrs"] = (
    "SELECT page_id, pos, k, arg_max(v, i) AS v FROM (SELECT page_id, pos, i, k, "
    + "coalesce(" + decode("CASE WHEN regexp_matches(r, '^[\"'']') THEN r[2:-2] ELSE r END", True) + ", '') AS v FROM at1) GROUP BY ALL"
)


def _tag(name: str, keys: list[str]) -> str:
    cols = ", ".join(f"max(v) FILTER (WHERE k = '{k}') AS a_{k}" for k in keys)
    return (
        f"SELECT o.page_id, o.pos, any_value(o.raw) AS raw, any_value(o.open_tag) AS open_tag, {cols}"
        f" FROM op o LEFT JOIN attrs ON attrs.page_id = o.page_id AND attrs.pos = o.pos WHERE o.tag = '{name}' GROUP BY o.page_id, o.pos"
    )


CTES["meta0"] = (
    "SELECT page_id, pos, coalesce(a_name, a_property, '') AS name, coalesce(a_content, '') AS content FROM ("
    + _tag("meta", ["name", "property", "content"]) + ")"
)
CTES["meta"] = (
    "SELECT page_id, name, arg_max(content, pos) AS content, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS pos"
    " FROM meta0 WHERE name <> '' GROUP BY page_id, name"
)
CTES["link"] = "SELECT * FROM (" + _tag("link", ["rel", "href", "title", "type"]) + ")"
CTES["img"] = (
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, a_src AS src, coalesce(a_alt, '') AS alt,"
    " coalesce(a_title, '') AS title, a_width AS width, a_height AS height, coalesce(a_loading, '') AS loading,"
    " coalesce(a_decoding, '') AS decoding FROM ("
    + _tag("img", ["src", "alt", "title", "width", "height", "loading", "decoding"]) + ")"
)
CTES["script"] = (
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, a_type AS type, a_src AS src,"
    " regexp_replace(substr(raw, length(open_tag) + 1), '(?is)</script\\s*>\\z', '') AS body"
    " FROM (" + _tag("script", ["type", "src"]) + ")"
)
CTES["css"] = (
    "SELECT page_id, pos, regexp_replace(substr(raw, length(open_tag) + 1), '(?is)</style\\s*>\\z', '') AS body"
    " FROM op WHERE tag = 'style'"
)
CTES["inline_style"] = "SELECT page_id, pos, v FROM attrs WHERE k = 'style'"
CTES["sheet"] = "SELECT page_id, pos, a_href AS href FROM link WHERE list_contains(regexp_split_to_array(a_rel, '\\s+'), 'stylesheet')"
CTES["tn"] = (
    "SELECT page_id, min(pos) AS pos, " + decode("string_agg(raw, '' ORDER BY pos)") + " AS t FROM ("
    "SELECT page_id, pos, raw, pos - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS run FROM tk WHERE tag = '')"
    " GROUP BY page_id, run"
)


def _elements(tags: str) -> str:
    return (
        "SELECT page_id, pos, tag, epos FROM (SELECT page_id, pos, tag, closing,"
        " lead(pos, 1, 1000000000) OVER (PARTITION BY page_id ORDER BY pos) AS epos"
        f" FROM tk WHERE tag IN ({tags})) WHERE NOT closing"
    )


def _with_text(elements: str) -> str:
    return (
        "SELECT e.page_id, e.pos, any_value(e.tag) AS tag, coalesce(string_agg(" + trim("n.t") + ", '' ORDER BY n.pos), '') AS text"
        f" FROM ({elements}) e LEFT JOIN tn n ON n.page_id = e.page_id AND n.pos > e.pos AND n.pos < e.epos GROUP BY e.page_id, e.pos"
    )


CTES["head"] = (
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, CAST(substr(tag, 2, 1) AS BIGINT) AS level, text"
    " FROM (" + _with_text(_elements("'h1','h2','h3','h4','h5','h6'")) + ")"
)
CTES["ttl"] = (
    "SELECT g.page_id, CASE WHEN any_value(f.pos) IS NULL THEN 'No title found'"
    " WHEN count(k.pos) = 1 AND max(k.tag) = '' THEN max(" + decode("k.raw") + ") END AS title"
    " FROM pg g LEFT JOIN (SELECT page_id, min(pos) AS pos, arg_min(epos, pos) AS epos FROM (" + _elements("'title'") + ") GROUP BY page_id) f"
    " ON f.page_id = g.page_id LEFT JOIN tk k ON k.page_id = f.page_id AND k.pos > f.pos AND k.pos < f.epos GROUP BY g.page_id"
)
CTES["a0"] = (
    "SELECT e.page_id, e.pos, e.text, max(v) FILTER (WHERE k = 'href') AS href, coalesce(max(v) FILTER (WHERE k = 'title'), '') AS title,"
    " max(v) FILTER (WHERE k = 'rel') AS rel, coalesce(max(v) FILTER (WHERE k = 'target'), '') AS target"
    " FROM (" + _with_text(_elements("'a'")) + ") e JOIN attrs ON attrs.page_id = e.page_id AND attrs.pos = e.pos GROUP BY e.page_id, e.pos, e.text"
)
CTES["a1"] = (
    "SELECT a0.*, g.url, regexp_extract(g.url, '^([a-z]+):', 1) AS bs, " + netloc("g.url") + " AS bn,"
    " regexp_extract(g.url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS bp, regexp_extract(g.url, '\\?([^#]*)', 1) AS bq,"
    " regexp_extract(href, '^([^?#]*)', 1) AS rp, regexp_extract(href, '^[^?#]*\\?([^#]*)', 1) AS rq, regexp_extract(href, '#(.*)$', 1) AS rf"
    " FROM a0 JOIN pg g ON g.page_id = a0.page_id WHERE href IS NOT NULL"
)
_Q = "CASE WHEN rq <> '' THEN '?' || rq ELSE '' END || CASE WHEN rf <> '' THEN '#' || rf ELSE '' END"
CTES["a2"] = (
    "SELECT *, CASE WHEN starts_with(href, 'http') THEN href WHEN href = '' THEN url"
    " WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href"
    f" WHEN starts_with(href, '//') THEN bs || ':' || rp || {_Q}"
    " WHEN rp = '' THEN bs || '://' || bn || bp || CASE WHEN rq <> '' THEN '?' || rq WHEN bq <> '' THEN '?' || bq ELSE '' END"
    " || CASE WHEN rf <> '' THEN '#' || rf ELSE '' END"
    " ELSE bs || '://' || bn || "
    + fold("CASE WHEN starts_with(rp, '/') THEN rp ELSE regexp_replace(coalesce(nullif(regexp_extract(bp, '^(.*/)', 1), ''), '/') || rp, '/+', '/', 'g') END")
    + f" || {_Q} END AS full_url FROM a1"
)
CTES["a"] = (
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, href, text, title, rel, target, full_url, bn, "
    + netloc("full_url") + " AS netloc, " + netloc("full_url") + " = bn AS internal, "
    + netloc("full_url") + " <> bn AND " + any_in(netloc("full_url"), SOCIAL) + " AS social FROM a2"
)
CTES["doc"] = (
    "SELECT g.page_id, lower(coalesce(string_agg(t, '' ORDER BY pos), '')) AS t FROM pg g LEFT JOIN tn ON tn.page_id = g.page_id GROUP BY g.page_id"
)
CTES["wl"] = "SELECT page_id, regexp_extract_all(t, '[\\p{L}\\p{N}_]+') AS l FROM doc"
CTES["wc"] = "SELECT page_id, CAST(len(l) AS BIGINT) AS word_count FROM wl"
CTES["kw"] = (
    "SELECT page_id, word, cnt, rank FROM (SELECT page_id, word, count(*) AS cnt,"
    " row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(i)) AS rank"
    " FROM (SELECT page_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM wl)"
    f" WHERE length(word) > 2 AND NOT list_contains({lit(STOP)}, word) GROUP BY page_id, word) WHERE rank <= 20"
)
CTES["ld"] = (
    "SELECT page_id, pos, body FROM script WHERE type = 'application/ld+json' AND body <> '' AND json_valid(body)"
)
_hit = " ".join(
    f"WHEN contains(lower(body), '{p}') OR contains(lower(coalesce(src, '')), '{p}') THEN '{p}'" for p in PATTERNS
)
CTES["hit"] = (
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, type, src, preview FROM ("
    f"SELECT page_id, pos, CASE {_hit} END AS type, coalesce(src, '') AS src, {preview('body')} AS preview FROM script) WHERE type IS NOT NULL"
)
CTES["feed"] = (
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, a_href AS href, a_title AS title, a_type AS type"
    " FROM link WHERE list_contains(regexp_split_to_array(a_rel, '\\s+'), 'alternate')"
    " AND a_type IN ('application/rss+xml', 'application/atom+xml')"
)


def _first(token: str) -> str:
    return (
        "SELECT page_id, arg_min(coalesce(a_href, chr(1)), pos) AS href FROM link"
        f" WHERE list_contains(regexp_split_to_array(a_rel, '\\s+'), '{token}') GROUP BY page_id"
    )


CTES["firsts"] = (
    "SELECT g.page_id, nullif(c.href, chr(1)) AS canonical_url, nullif(i.href, chr(1)) AS favicon, nullif(s.href, chr(1)) AS sitemap"
    f" FROM pg g LEFT JOIN ({_first('canonical')}) c ON c.page_id = g.page_id LEFT JOIN ({_first('icon')}) i ON i.page_id = g.page_id"
    f" LEFT JOIN ({_first('sitemap')}) s ON s.page_id = g.page_id"
)
CTES["direct"] = (
    "SELECT g.page_id, " + ", ".join(f"max(content) FILTER (WHERE name = '{k}') AS {k}" for k in ("robots", "viewport", "charset", "language", "description"))
    + " FROM pg g LEFT JOIN meta ON meta.page_id = g.page_id GROUP BY g.page_id"
)


def per_page(parts: dict[str, str]) -> str:
    """Counts per page, zero where a page has no rows."""
    joins, cols = [], []
    for i, (name, (src, expr)) in enumerate(parts.items()):
        joins.append(f"LEFT JOIN (SELECT page_id, {expr} AS c FROM {src} GROUP BY page_id) t{i} ON t{i}.page_id = g.page_id")
        cols.append(f"CAST(coalesce(t{i}.c, 0) AS BIGINT) AS {name}")
    return "SELECT g.page_id, " + ", ".join(cols) + " FROM pg g " + " ".join(joins)


CTES["cnt"] = per_page(
    {
        "links": ("a", "count(*)"),
        "internal_links": ("a", "count_if(internal)"),
        "external_links": ("a", "count_if(NOT internal)"),
        "social_links": ("a", "count_if(social)"),
        "styled_elements": ("inline_style", "count(*)"),
        "internal_css": ("css", "count_if(body <> '')"),
        "external_css": ("sheet", "count_if(href <> '')"),
        "total_stylesheets": ("sheet", "count(*)"),
        "inline_scripts": ("script", "count_if(body <> '')"),
        "external_scripts": ("script", "count_if(src IS NOT NULL)"),
        "total_scripts": ("script", "count(*)"),
        "total_images": ("img", "count(*)"),
        "images_without_alt": ("img", "count_if(alt = '')"),
        "lazy_images": ("img", "count_if(loading = 'lazy')"),
        "sized_images": ("img", "count_if(width <> '' AND height <> '')"),
        "metas": ("meta", "count(*)"),
        "og": ("meta", "count_if(starts_with(name, 'og:'))"),
        "tw": ("meta", "count_if(starts_with(name, 'twitter:'))"),
        "json_ld": ("ld", "count(*)"),
        "script_hits": ("hit", "count(*)"),
        "feeds": ("feed", "count(*)"),
        "headings": ("head", "count(*)"),
        **{f"h{i}": ("head", f"count_if(level = {i})") for i in range(1, 7)},
    }
)


def sql(select: str) -> str:
    """``WITH`` clause of all blocks the text needs, then the text."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+\(*{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(select)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in need)
    return f"WITH {head}\n{select}" if need else select
