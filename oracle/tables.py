"""Checks of the platform tables and rollups."""

from .common import CTES, sql
from .tracking import DISPLAY

TABLES = ["users", "projects", "site_health", "platform_pages", "recommendations", "alerts", "optimizations"]
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
USER = "user_id, email, name, role, created_at"
PROJECT = "project_id, user_id, domain, status, updated_at"


def _id(*keys: str) -> str:
    return "sha256(" + " || '|' || ".join(keys) + ")[:32]"


def _last(key: str) -> str:
    cols = ["new_name", "new_email", "new_role", "new_active", "new_status", "new_path", "new_preferences"]
    picks = ", ".join(f"arg_max({c}, changed_at) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in cols)
    return f"(SELECT {key}, max(changed_at) AS changed_at, {picks} FROM changes GROUP BY {key})"


def _newest(src: str, key: str, order: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rank FROM {src}) WHERE rank <= {k})"


CTES["stats"] = (
    "SELECT p.project_id, (SELECT count(*) FROM platform_pages g WHERE g.project_id = p.project_id) AS total_pages,"
    " (SELECT count(*) FROM recommendations r WHERE r.project_id = p.project_id AND r.status = 'pending') AS pending_recommendations,"
    " (SELECT count(*) FROM optimizations o WHERE o.project_id = p.project_id) AS total_optimizations,"
    " coalesce(h.overall_score, 0)::BIGINT AS latest_health_score, h.ts AS last_crawl FROM projects p LEFT JOIN "
    + _newest("site_health", "project_id", "ts DESC, health_id DESC", 1) + " h ON h.project_id = p.project_id"
)
_upd = lambda cols: (
    f"SELECT p.project_id, {cols}, coalesce(c.changed_at, p.updated_at) AS updated_at FROM projects p LEFT JOIN {_last('project_id')} c ON c.project_id = p.project_id"
)
_hist = "project_id, health_id, ts, overall_score::BIGINT AS overall_score"



def _resolved(requests: str) -> str:
    """Requests one after the other: a recursion with a step for each one that no old user fits."""
    known = (
        f"SELECT r.*, a.user_id AS ue, b.user_id AS ux, row_number() OVER (ORDER BY request_id, r.email, r.external_id NULLS FIRST) AS k"
        f" FROM (SELECT *, {DISPLAY} AS nm FROM {requests}) r"
        f" LEFT JOIN {_newest('users', 'email', 'created_at, user_id', 1)} a ON a.email = r.email"
        f" LEFT JOIN {_newest('users', 'external_id', 'created_at, user_id', 1)} b ON b.external_id = r.external_id"
    )
    hit = "(list_contains(es, o.email) OR coalesce(list_contains(xs, o.external_id), false))"
    add = lambda xs, x: f"CASE WHEN {hit} THEN {xs} ELSE list_append({xs}, {x}) END AS {xs}"
    return (
        f"(WITH RECURSIVE known AS MATERIALIZED ({known}),"
        " o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k) AS j FROM known WHERE ue IS NULL AND ux IS NULL AND email IS NOT NULL),"
        " s AS (SELECT 0::BIGINT AS j, []::BIGINT[] AS ks, []::VARCHAR[] AS es, []::VARCHAR[] AS xs"
        f" UNION ALL SELECT s.j + 1, {add('ks', 'o.k')}, {add('es', 'o.email')}, {add('xs', 'o.external_id')} FROM s JOIN o ON o.j = s.j + 1),"
        " made AS (SELECT * FROM o WHERE k IN (SELECT unnest(ks) FROM s WHERE j = (SELECT max(j) FROM s)))"
        " SELECT r.request_id, r.email,"
        " CASE WHEN r.email IS NOT NULL THEN coalesce(r.ue, sha256(e.email)[:32], r.ux, sha256(x.email)[:32]) END AS user_id,"
        " CASE WHEN r.email IS NULL THEN 'rejected' WHEN r.ue IS NOT NULL OR e.k < r.k THEN 'email' WHEN e.k = r.k THEN 'created' ELSE 'external_id' END AS how,"
        " CASE WHEN e.k = r.k THEN r.nm END AS new_name"
        " FROM known r LEFT JOIN made e ON e.email = r.email AND e.k <= r.k LEFT JOIN made x ON x.external_id = r.external_id AND x.k < r.k)"
    )


def _created(requests: str) -> str:
    return (
        f"SELECT user_id, email, arg_min(new_name, request_id) AS name, 'user' AS role, true AS is_active, {AS_OF} AS created_at, {AS_OF} AS updated_at"
        f" FROM {_resolved(requests)} WHERE how = 'created' GROUP BY user_id, email"
    )


SQL = {
    "created_users": _created("login_requests"),
    "signup_users": _created("signups"),
    "signup_resolve": f"SELECT * FROM {_resolved('signups')}",
    "scan_platform": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, filled, (SELECT count(*) FROM {t}) AS rows FROM"
        f" (UNPIVOT (SELECT count(COLUMNS('(.*)')) AS '\\1' FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE filled)"
        for t in TABLES
    ),
    "read_json_doc": "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 4 = 3 AS missing FROM events",
    "append_users": f"SELECT {_id('email', 'name')} AS user_id, email, name, CASE WHEN role = 'admin' THEN role ELSE 'user' END AS role,"
    " NOT ends_with(user_id, '7') AS is_active, nullif(given_name, '') AS given_name,"
    " CASE WHEN is_active THEN '{\"role\":\"' || role || '\",\"name\":\"' || name || '\"}' END AS preferences,"
    f" {AS_OF} AS created_at, {AS_OF} AS updated_at FROM users",
    "append_projects": f"SELECT {_id('user_id', 'domain', 'name')} AS project_id, user_id, domain, name, 'active' AS status, false AS auto_optimize,"
    " '{\"category\":\"' || status || '\",\"description\":\"' || domain || '\"}' AS settings,"
    f" {AS_OF} AS created_at, {AS_OF} AS updated_at FROM projects",
    "append_health": f"SELECT {_id('project_id', 'health_id')} AS health_id, project_id, health_id AS source, {AS_OF} AS timestamp, crawl_data,"
    " CASE WHEN overall_score > 20 THEN overall_score ELSE 0 END::BIGINT AS overall_score, CASE WHEN performance > 2 THEN performance ELSE 0 END::BIGINT AS performance, "
    + ", ".join(f"0::BIGINT AS {c}" for c in "technical_seo content_seo internal_linking visual_ux authority_backlinks total_impressions total_engagements total_conversions".split())
    + " FROM site_health",
    "append_pages": f"SELECT {_id('project_id', 'page_id')} AS page_id, project_id, page_url, page_id AS source, '' AS title, status, {AS_OF} AS last_crawled,"
    " CASE WHEN load_time > 0.02 THEN load_time ELSE 0 END::DOUBLE AS load_time, CASE WHEN word_count > 500 THEN word_count ELSE 0 END::BIGINT AS word_count,"
    " '' AS meta_description, 0::BIGINT AS images_count, 0::BIGINT AS links_count FROM platform_pages",
    "append_recommendations": f"SELECT {_id('project_id', 'recommendation_id')} AS recommendation_id, project_id, category, recommendation_id AS source, status,"
    " 'medium' AS priority, CASE WHEN impact_score > 30 THEN impact_score ELSE 50 END::BIGINT AS impact_score,"
    f" '[\"' || category || '\",\"' || priority || '\"]' AS guidelines, {AS_OF} AS created_at FROM recommendations",
    "append_alerts": f"SELECT {_id('user_id', 'alert_id')} AS alert_id, user_id, title, alert_id AS source, alert_type, priority, 'active' AS status, {AS_OF} AS created_at FROM alerts",
    "append_optimizations": f"SELECT {_id('project_id', 'optimization_id')} AS optimization_id, project_id, optimization_type, optimization_id AS source,"
    f" '{{\"kind\":\"' || optimization_type || '\"}}' AS changes_made, {AS_OF} AS created_at FROM optimizations",
    "lookup_user_id": f"SELECT {USER} FROM users WHERE user_id IN (SELECT user_id FROM alerts)",
    "lookup_project_id": f"SELECT {PROJECT} FROM projects WHERE project_id IN (SELECT project_id FROM site_health)",
    "lookup_user_email": f"SELECT {USER} FROM {_newest('users', 'email', 'created_at, user_id', 1)} WHERE email IN (SELECT email FROM login_requests)",
    "lookup_user_ext": f"SELECT external_id, {USER} FROM users WHERE external_id IN (SELECT external_id FROM login_requests)",
    "lookup_project_domain": f"SELECT {PROJECT}, created_at FROM {_newest('projects', 'user_id, domain', 'created_at, project_id', 1)}"
    " WHERE (user_id, domain) IN (SELECT (CASE WHEN status = 'paused' THEN 'u0' ELSE user_id END, domain) FROM projects)",
    "user_duplicates": f"SELECT {USER}, cnt FROM (SELECT *, count(*) OVER (PARTITION BY email) AS cnt FROM users) WHERE cnt > 1",
    "user_resolve": f"SELECT * FROM {_resolved('login_requests')}",
    "update_profile": "SELECT u.user_id, coalesce(new_name, name) AS name, coalesce(new_email, email) AS email, coalesce(new_role, role) AS role,"
    f" coalesce(new_active, is_active) AS is_active, coalesce(new_preferences, preferences) AS preferences, coalesce(changed_at, updated_at) AS updated_at FROM users u LEFT JOIN {_last('user_id')} c ON c.user_id = u.user_id",
    "touch_login": f"SELECT u.user_id, strftime(changed_at, '%Y-%m-%dT%H:%M:%S') AS last_login FROM users u LEFT JOIN {_last('user_id')} c ON c.user_id = u.user_id",
    "touch_crawl": _upd("c.changed_at AS last_crawl"),
    "set_files_path": _upd("coalesce(c.new_path, p.scraped_files_path) AS scraped_files_path"),
    "set_project_status": _upd("coalesce(c.new_status, p.status) AS status"),
    "set_rec_status": f"SELECT recommendation_id, CASE WHEN category = 'catA' THEN 'applied' ELSE status END AS status, CASE WHEN category = 'catA' THEN {AS_OF} END AS updated_at FROM recommendations",
    "dismiss_alert": f"SELECT alert_id, CASE WHEN title = 'signup' THEN 'dismissed' ELSE status END AS status, CASE WHEN title = 'signup' THEN {AS_OF} END AS dismissed_at FROM alerts",
    "delete_users": f"SELECT {USER} FROM users WHERE user_id NOT IN (SELECT user_id FROM alerts)",
    "delete_projects": f"SELECT {PROJECT} FROM projects WHERE project_id NOT IN (SELECT project_id FROM recommendations WHERE priority = 'high')",
    "user_projects": f"SELECT {PROJECT}, json_extract_string(settings, '$.category') AS category FROM projects WHERE user_id IN (SELECT user_id FROM alerts)",
    "latest_health": f"SELECT {_hist} FROM {_newest('site_health', 'project_id', 'ts DESC, health_id DESC', 1)}",
    "health_history": f"SELECT {_hist}, rank FROM {_newest('site_health', 'project_id', 'ts DESC, health_id', 30)}",
    "project_pages": "SELECT * FROM platform_pages WHERE project_id IN (SELECT project_id FROM projects WHERE auto_optimize)",
    "recs_by_status": "SELECT * REPLACE (impact_score::BIGINT AS impact_score) FROM recommendations WHERE status = 'pending' AND project_id IN (SELECT project_id FROM projects WHERE auto_optimize)",
    "alerts_by_status": "SELECT * FROM alerts WHERE status = 'active' AND user_id IN (SELECT user_id FROM users WHERE role = 'admin')",
    "opt_history": f"SELECT project_id, optimization_id, optimization_type, created_at, rank FROM {_newest('optimizations', 'project_id', 'created_at DESC, optimization_id', 50)}",
    "project_owned": f"SELECT {PROJECT} FROM projects WHERE status <> 'paused' OR user_id = 'u0'",
    "public_user": "SELECT * EXCLUDE (password_hash) FROM users",
    "json_roundtrip": "SELECT user_id, CASE WHEN ok THEN json_extract_string(preferences, '$.theme') END AS theme, CASE WHEN ok THEN CAST(json_extract(preferences, '$.size') AS BIGINT) END AS size,"
    " CASE WHEN ok THEN preferences END AS again FROM (SELECT *, coalesce(json_valid(preferences), false) AS ok FROM users)",
    "project_statistics": "SELECT * FROM stats",
    "dashboard_totals": "SELECT u.user_id, count(p.project_id) AS total_projects, count(*) FILTER (WHERE p.status = 'active') AS active_projects,"
    " coalesce(any_value(al.c), 0) AS total_alerts FROM users u LEFT JOIN projects p ON p.user_id = u.user_id LEFT JOIN"
    " (SELECT user_id, count(*) AS c FROM alerts WHERE status = 'active' GROUP BY user_id) al ON al.user_id = u.user_id GROUP BY u.user_id",
    "dashboard_projects": "SELECT user_id, domain, status, updated_at, rank, stats.* FROM "
    + _newest("projects", "user_id", "updated_at DESC, project_id", 10) + " t JOIN stats ON stats.project_id = t.project_id",
    "project_cards": "SELECT p.project_id AS id, domain AS url, 'fas fa-globe' AS icon, status, coalesce(h.overall_score, 0)::BIGINT AS \"healthScore\","
    " 0::BIGINT AS recommendations, auto_optimize AS \"autoOptimize\", coalesce(h.ts, updated_at) AS \"lastUpdated\" FROM projects p LEFT JOIN "
    + _newest("site_health", "project_id", "ts DESC, health_id DESC", 1) + " h ON h.project_id = p.project_id",
    "project_scraped_view": "SELECT p.project_id, scraped_files_path <> '' AS has_scraped_data, coalesce(title, '') AS title, coalesce(g.url, '') AS original_url,"
    " coalesce(word_count, 0)::BIGINT AS word_count, coalesce(description, '') AS meta_description, coalesce(total_images, 0)::BIGINT AS images_count,"
    " coalesce(links, 0)::BIGINT AS links_count, coalesce(h.t, '') AS h1_tags FROM projects p"
    " LEFT JOIN pg g ON 'scraped_sites/page_' || g.page_id = p.scraped_files_path LEFT JOIN ttl ON ttl.page_id = g.page_id LEFT JOIN wc ON wc.page_id = g.page_id"
    " LEFT JOIN cnt ON cnt.page_id = g.page_id LEFT JOIN direct ON direct.page_id = g.page_id"
    " LEFT JOIN (SELECT page_id, string_agg(text, ' | ' ORDER BY pos) AS t FROM head WHERE level = 1 GROUP BY page_id) h ON h.page_id = g.page_id",
}
SQL = {k: sql(v) for k, v in SQL.items()}
