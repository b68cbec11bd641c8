"""Checks of URL scalars and site tracking."""

from .common import CTES, netloc, sql


def key(url: str) -> str:
    return f"replace(lower({netloc(url)}), 'www.', '')"


def title_case(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(r[1]) || lower(r[2:])), '')"
    )


FULL = "nullif(trim(coalesce(given_name, '') || ' ' || coalesce(family_name, '')), '')"
DISPLAY = f"coalesce({FULL}, {title_case('replace(split_part(email, ' + chr(39) + '@' + chr(39) + ', 1), ' + chr(39) + '.' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')})"
FORMS = " UNION ALL ".join(
    f"SELECT page_id, CAST({i} AS BIGINT) AS form, {x} AS raw FROM pages"
    for i, x in enumerate(("url", netloc("url"), f"'www.' || {netloc('url')} || '//'"))
)
_host = "lower(c_mktsegment) || '-' || c_custkey"
CTES["forms"] = FORMS
CTES["cand"] = (
    "SELECT c_custkey, unnest([c_name, h || '.example.com', '-' || h || '.com', repeat(h, 5) || '.com', repeat(h || '.', 20),"
    f" repeat(h || '.', 15) || 'com']) AS domain FROM (SELECT *, {_host} AS h FROM customer)"
)
CTES["scr"] = f"SELECT l.*, {key('l.url')} AS site FROM scrape_log l"
CTES["opt"] = f"SELECT o.*, {key('o.original_url')} AS site FROM site_optimizations o"
CTES["lk"] = (
    "SELECT opt_id AS lookup_id, CASE WHEN user_profile = 'system' THEN 'unseen.example.com' ELSE site END AS site_key FROM opt"
)
CTES["sites_all"] = (
    "SELECT site AS site_key, min(ev) AS first_seen, max(ev) FILTER (WHERE k = 's') AS last_scraped, max(ev) FILTER (WHERE k = 'o') AS last_optimized,"
    " count(*) FILTER (WHERE k = 's') AS total_scrapes, count(*) FILTER (WHERE k = 'o') AS total_optimizations"
    " FROM (SELECT site, 's' AS k, scraped_at AS ev FROM scr UNION ALL SELECT site, 'o', optimized_at FROM opt) GROUP BY site"
)
CTES["act"] = (
    "SELECT 'scrape' AS type, site, scraped_at AS happened_at, url, page_id AS record, NULL AS user_profile FROM scr"
    " UNION ALL SELECT 'optimization', site, optimized_at, NULL, opt_id, user_profile FROM opt"
)
CTES["tit"] = "SELECT scr.*, ttl.title FROM scr JOIN ttl ON ttl.page_id = scr.page_id"
_DOMAIN = "regexp_replace(CASE WHEN " + netloc("raw") + " <> '' THEN replace(" + netloc("raw") + ", 'www.', '') ELSE raw END, '/+$', '')"
_LABEL = "[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_STAMP = "strftime(scraped_at, '%Y%m%d_%H%M%S_%f')[:-4]"
_PATH = "translate(regexp_extract(raw, '^(?:[a-z]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/\\', '__')"

SQL = {
    "site_key": f"SELECT page_id, {key('url')} AS site_key FROM pages",
    "domain_normalize": f"SELECT page_id, form, raw, {_DOMAIN} AS domain FROM forms",
    "domain_valid": f"SELECT c_custkey, domain, regexp_matches(domain, '^{_LABEL}(\\.{_LABEL})*$') AND length(domain) <= 253 AS valid FROM cand",
    "url_scheme_valid": "SELECT page_id, url, regexp_matches(url, '^https?://') AS valid FROM fetched_pages",
    "ensure_scheme": "SELECT page_id, form, CASE WHEN regexp_matches(raw, '^https?://') THEN raw ELSE 'https://' || raw END AS address FROM forms",
    "safe_name": "SELECT page_id, form, replace(replace(" + netloc("raw") + ", 'www.', ''), '.', '_') || '_' || CASE WHEN p IN ('', '_') THEN 'home'"
    " ELSE ltrim(p, '_') END || '_' || st || '_' || sha256(raw || '|' || st)[:8] AS name FROM ("
    f"SELECT forms.*, {_PATH} AS p, {_STAMP} AS st FROM forms JOIN scrape_log l ON l.page_id = forms.page_id)",
    "display_name": f"SELECT user_id, {DISPLAY} AS name FROM users",
    "token_name": f"SELECT user_id, coalesce({FULL}, nullif(email, ''), 'Unknown User') AS name FROM users",
    "safe_label": "SELECT project_id, rtrim(regexp_replace(name, '[^\\p{L}\\p{N} _-]', '', 'g')) AS label FROM projects",
    "log_preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview FROM documents",
    "path_migrate": "SELECT project_id, CASE WHEN starts_with(scraped_files_path, 's3://') THEN scraped_files_path"
    " ELSE 's3://site-audits/scraped_sites/' || list_last(string_split(scraped_files_path, '/')) END AS scraped_files_path"
    " FROM projects WHERE scraped_files_path <> ''",
    "scrape_stats": "SELECT l.*, coalesce(title, 'Unknown') AS title, links AS links_count, styled_elements AS inline_styles_count,"
    " internal_css AS internal_stylesheets_count, external_css AS external_stylesheets_count, inline_scripts AS inline_scripts_count,"
    " external_scripts AS external_scripts_count FROM scrape_log l JOIN ttl ON ttl.page_id = l.page_id JOIN cnt ON cnt.page_id = l.page_id",
    "site_upsert": "SELECT site AS site_key, min(scraped_at) AS first_scraped, max(scraped_at) AS last_scraped, count(*) AS total_scrapes FROM scr GROUP BY site",
    "site_opt_upsert": "SELECT * FROM sites_all",
    "is_scraped": "SELECT lookup_id, site_key, site_key IN (SELECT site FROM scr) AS is_scraped FROM lk",
    "site_info": "SELECT lookup_id, s.* FROM lk JOIN sites_all s ON s.site_key = lk.site_key",
    "all_sites": "SELECT type, site, happened_at, url, record, user_profile FROM act",
    "site_totals": "SELECT count(DISTINCT site) AS total_sites, count_if(type = 'scrape')::BIGINT AS total_scrapes,"
    " count_if(type = 'optimization')::BIGINT AS total_optimizations FROM act",
    "recent_activity": "SELECT type, site, happened_at, url, record, user_profile FROM act ORDER BY happened_at DESC, type, record LIMIT 10",
    "site_search": "SELECT DISTINCT site AS site_key FROM tit WHERE contains(site, 'blog') OR contains(lower(title), 'blog')",
    "sites_by_user": "SELECT user_email, url, site AS domain, title, scraped_at AS timestamp, saved_directory, 'Website' AS category,"
    " 'completed' AS status, 1::BIGINT AS pages_scraped FROM (SELECT *, row_number() OVER (PARTITION BY user_email, site"
    " ORDER BY scraped_at DESC, page_id DESC) AS rn FROM tit WHERE user_email IS NOT NULL) WHERE rn = 1",
    "sites_by_profile": "SELECT DISTINCT user_profile, site AS site_key FROM opt",
    "site_summary": "SELECT 'site' AS kind, site_key, t.first AS first_scraped, coalesce(t.c, 0) AS scrapes, coalesce(o.c, 0) AS optimizations, t.last AS latest_scrape,"
    " t.title, o.last AS latest_optimization, o.prof AS latest_profile FROM sites_all LEFT JOIN (SELECT site, count(*) AS c, min(scraped_at) AS first,"
    " max(scraped_at) AS last, arg_max(coalesce(title, chr(1)), scraped_at) AS title FROM tit GROUP BY site) t ON t.site = site_key LEFT JOIN"
    " (SELECT site, count(*) AS c, max(optimized_at) AS last, arg_max(user_profile, optimized_at) AS prof FROM opt GROUP BY site) o ON o.site = site_key"
    " UNION ALL SELECT * FROM (SELECT type, site, NULL, NULL, NULL, CASE WHEN type = 'scrape' THEN happened_at END, NULL,"
    " CASE WHEN type <> 'scrape' THEN happened_at END, user_profile FROM act ORDER BY happened_at DESC, type, record LIMIT 5)",
}
SQL = {k: sql(v) for k, v in SQL.items()}
