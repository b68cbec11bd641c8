"""Checks of sources, sinks, object keys and streams."""

from .common import sql
from .reporting import SQL as REPORTS
from .tables import SQL as TABLES
from .tracking import SQL as TRACKING, key

_DIRS = "(SELECT key, split_part(key, '/', 2) AS dir FROM object_keys WHERE len(string_split(key, '/')) >= 3)"

SQL = {
    "scan_tracker_json": f"SELECT 'scrape' AS kind, {key('l.url')} AS site_key, url, scraped_at AS at, saved_directory AS directory, user_email AS who FROM scrape_log l WHERE page_id % 5 <> 3"
    f" UNION ALL SELECT 'optimization', {key('o.original_url')}, original_url, optimized_at, optimized_directory, user_profile FROM site_optimizations o WHERE opt_id % 5 <> 3",
    "read_text_doc": "SELECT line FROM access_lines",
    "list_objects": "SELECT artifact, true AS filled, count(DISTINCT page_id) AS pages FROM arts GROUP BY artifact",
    "site_dirs": f"SELECT DISTINCT dir FROM {_DIRS}",
    "files_per_dir": "SELECT dir AS name, 's3://site-audits/scraped_sites/' || dir AS path, 'scraped' AS type, 's3' AS storage, count(*) AS file_count"
    f" FROM {_DIRS} GROUP BY dir",
    "object_exists": "SELECT key, key IN (SELECT key FROM object_keys) AS found FROM (SELECT saved_directory || '/' || unnest(['index.html', 'scripts.js']) AS key FROM scrape_log)",
    "delete_prefix": "SELECT key, size::BIGINT AS size FROM object_keys WHERE NOT starts_with(key, 'scraped_sites/stray_')"
    " AND split_part(key, '/', 2) NOT IN (SELECT 'page_' || page_id FROM fetched_pages WHERE url LIKE 'ftp%')",
    "stream_request_counts": "SELECT method, window_start, count(*) AS requests FROM (SELECT method, time_bucket(INTERVAL '5 minutes', ts) AS window_start FROM requests)"
    " WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE GROUP BY ALL",
    # windows of fewer values than a sketch holds are exact
    "stream_latency_quantiles": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS requests, quantile_disc(latency, 0.95) AS quantile FROM requests"
    " GROUP BY 1 HAVING time_bucket(INTERVAL '5 minutes', any_value(ts)) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE",
    # the watermark before a batch is ten minutes before the highest time of the batches before it
    "stream_late_requests": "SELECT * FROM (WITH d AS (SELECT day, ntile(3) OVER (ORDER BY day) AS span FROM (SELECT DISTINCT ts::DATE AS day FROM requests)),"
    " r AS (SELECT requests.*, unnest(CASE WHEN event_id % 11 = 0 THEN [4] WHEN event_id % 7 = 0 THEN [span, 4] ELSE [span] END) AS arrival"
    " FROM requests JOIN d ON d.day = ts::DATE),"
    " m AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM r GROUP BY arrival)"
    " SELECT DISTINCT event_id, ts, method, client, endpoint FROM r JOIN m ON m.arrival = r.arrival WHERE ts < mark"
    " AND event_id NOT IN (SELECT event_id FROM r JOIN m ON m.arrival = r.arrival WHERE mark IS NULL OR ts >= mark))",
}
SQL = {k: sql(v) for k, v in SQL.items()}
SQL["write_json"] = REPORTS["report_analysis"]
SQL["write_seo_csv"] = REPORTS["seo_csv"]
SQL["stream_site_upsert"] = TRACKING["site_upsert"]
SQL["stream_health_history"] = TABLES["health_history"]
SQL["stream_latest_health"] = TABLES["latest_health"]
