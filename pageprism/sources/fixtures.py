"""Input views derived from the given tables.

The stock ``pages`` hold no images, trackers or external links, and the
platform tables do not exist at all, so each view below derives them from
the whole given table.  The texts stay within the SQL that Spark and the
checking engine share; ``$name$`` stands for a table, ``$ts$`` for the
engine's time-zone-free timestamp keyword.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _when(cond: str, html: str) -> str:
    return "CASE WHEN " + cond + " THEN '" + html.replace("'", "''") + "' ELSE '' END"


_HEAD = [
    _when("page_id % 3 <> 0", '<meta name="description" content="About &quot;pages&quot; &amp; more">'),
    _when("page_id % 6 = 1", "<META NAME=description CONTENT='Second description'>"),
    _when("page_id % 4 = 0", '<meta name="robots" content="index,follow"/>'),
    _when("page_id % 2 = 0", '<meta name="viewport" content="width=device-width">'),
    _when("page_id % 8 = 0", '<meta name="language" content="en"><meta name="charset" content="utf-8">'),
    _when("page_id % 3 = 0", '<meta property="og:title" content="Title &copy; 2024"><meta property="og:image" content="/i.png">'),
    _when("page_id % 5 = 0", '<meta name="twitter:card" content="summary"><meta name="twitter:site" property="og:x" content="@a">'),
    _when("page_id % 7 = 0", '<meta property="fb:app_id" content="123"><meta name="Facebook-domain-verification">'),
    _when("page_id % 7 = 3", '<meta name="" property="og:skipped" content="x">'),
    _when("page_id % 2 = 1", '<link rel="canonical" href="https://canon.example.com/a?x=1&amp;y=2">'),
    _when("page_id % 3 = 1", '<link rel="shortcut icon" href="/fav.ico">'),
    _when("page_id % 6 = 2", '<link rel="icon" href="/icon.png"><link rel="icon" href="/second.png">'),
    _when("page_id % 4 = 1", '<link rel="sitemap" type="application/xml" href="/sitemap.xml">'),
    _when("page_id % 5 = 1", '<link rel="alternate" type="application/rss+xml" title="News" href="/rss">'),
    _when("page_id % 5 = 2", '<link rel="alternate" type="application/atom+xml" href="/atom"><link rel="alternate" hreflang="de" href="/de">'),
    "repeat('<link rel=\"stylesheet\" href=\"/s.css\">', CAST(page_id % 4 AS INT))",
    _when("page_id % 9 = 4", '<link rel="preload stylesheet">'),
    _when("page_id % 5 = 3", '<style>.a::before{content:"<b>"}</style><style></style>'),
    _when("page_id % 6 = 0", '<script async src="https://www.googletagmanager.com/gtag/js?id=G-ABCDEFGHIJ"></script><script>gtag("config", "G-ABCDEFGHIJ");</script>'),
    _when("page_id % 6 = 1", '<script>ga("create", "UA-12345-6"); gtag("config", "G-ZYXWVUTSRQ");</script>'),
    _when("page_id % 4 = 2", "<script>(function(w){w.src='https://www.googletagmanager.com/gtm.js'})(window,'GTM-ABC1234');</script>"),
    _when("page_id % 5 = 0", "<script>!function(f){}(window);fbq('init', '123456789012');fbq('track','PageView');</script>"),
    _when("page_id % 7 = 2", "<script>h._hjSettings={hjid: 998877,hjsv:6}; /* hotjar */</script>"),
    _when("page_id % 8 = 3", '<script>mixpanel.init("0123456789abcdef0123456789ABCDEF");</script>'),
    _when("page_id % 9 = 5", "<SCRIPT>window.Clarity=1;/* " + "long text " * 30 + "*/</SCRIPT>"),
    _when("page_id % 10 = 7", '<script src="/js/facebook.js"></script><script>hotjar()</script>'),
    _when("page_id % 3 = 2", '<script type="application/ld+json">{"@type": "Article", "name": "x"}</script>'),
    _when("page_id % 6 = 5", '<script type="application/ld+json">{broken</script><script type="application/ld+json"></script>'),
    "repeat('<script src=\"/lib.js\">var a=1;</script>', CAST(page_id % 23 AS INT))",
]

_BODY = [
    "repeat('<img src=\"/a.png\" alt=\"A &lt;pic&gt;\" loading=\"lazy\" width=\"10\" height=\"20\">', CAST(page_id % 13 AS INT))",
    "repeat('<img src=/b.png width=5 />', CAST(page_id % 4 AS INT))",
    _when("page_id % 6 = 4", "<IMG SRC='/c.png' ALT='' TITLE='C' decoding=async>"),
    "repeat('<h2> Part <em>two</em> &amp; on </h2><div>text</div>', CAST(page_id % 6 AS INT))",
    "repeat('<h3>Third&nbsp;</h3>', CAST(page_id % 9 AS INT))",
    _when("page_id % 10 = 3", "<h1>Second <!-- gone --> main</h1><h4>x</h4><h6>y</h6>"),
    "repeat('<p style=\"color:red\">styled</p>', CAST(page_id % 61 AS INT))",
    _when("page_id % 2 = 0", '<a href="https://www.facebook.com/x?a=1&amp;b=2" rel="nofollow noopener" target=_blank>Our <b>page</b></a>'),
    _when("page_id % 3 = 0", '<a href="//youtube.com/watch/../v" title="vid">Watch</a><a href="https://docs.example.org:8080/ref">Reference</a>'),
    _when("page_id % 5 = 0", '<a href="../up/./x.html?q=1#f"> Read  More </a><a href="?page=3">Next</a><a href="#top">Top</a>'),
    _when("page_id % 7 = 1", '<a href="mailto:a@example.com">Contact us</a><a href="javascript:void(0)">Go</a><a href="">Self</a>'),
    _when("page_id % 7 = 2", '<a href="sub//page/../../other/">Review it</a><a href="httpd/conf">Odd</a><a name="x">no href</a>'),
    _when("page_id % 4 = 3", '<a href="/share/twitter">Share<a href="/about">About</a>'),
    _when("page_id % 8 = 5", '<a href="/x" href="/last">Learn more</a><a title="a > b" href=/unq/path?x=y>un &#39;quoted&#x27; &unknown; 5 < 6</a>'),
    _when("page_id % 9 = 2", "<!-- <a href=/hidden>hidden</a> <img src=x> -->Caf&eacute; na&iuml;ve &euro;5 &#8364;6 AT&amp;T x_y"),
]

_ENRICHED = (
    "replace(replace(html, '</head>', " + " || ".join(_HEAD) + " || '</head>'), '<footer>', " + " || ".join(_BODY) + " || '<footer>')"
)

_LINE_ID = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"
    " || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_extendedprice AS STRING)"
)

# What a fetch records besides the page itself.
_FETCH = (
    "$ts$'2025-01-01 00:00:00' + page_id * INTERVAL '37' MINUTE AS scraped_at,"
    " CASE WHEN page_id % 10 = 9 THEN NULL ELSE 'user' || CAST(page_id % 9 AS STRING) || '@example.com' END AS user_email,"
    " 'scraped_sites/page_' || CAST(page_id AS STRING) AS saved_directory"
)

VIEWS: dict[str, str] = {
    "web_pages": f"SELECT page_id, url, {_ENRICHED} AS html, {_FETCH} FROM $pages$",
    "fetched_pages": (
        "SELECT page_id, CASE WHEN page_id % 10 = 1 THEN replace(url, 'http', 'ftp') ELSE url END AS url,"
        " CASE WHEN page_id % 11 = 2 THEN NULL WHEN page_id % 11 = 5 THEN '' ELSE html END AS html FROM $pages$"
    ),
    "scrape_log": f"SELECT page_id, url, {_FETCH} FROM $pages$",
    "site_optimizations": (
        "SELECT conv_id * 1000 + turn AS opt_id, p.url AS original_url, role AS user_profile,"
        " $ts$'2025-01-02 00:00:00' + (conv_id * 1000 + turn) * INTERVAL '3' MINUTE AS optimized_at,"
        " 'optimized_sites/' || CAST(conv_id AS STRING) AS optimized_directory"
        " FROM $conversations$ c JOIN $pages$ p ON p.page_id = c.conv_id"
    ),
    "users": (
        "SELECT 'u' || CAST(c_custkey AS STRING) AS user_id,"
        " 'customer.' || CAST(CASE WHEN c_custkey % 25 = 1 THEN c_custkey - 1 ELSE c_custkey END AS STRING) || '@' || lower(c_mktsegment) || '.example.com' AS email,"
        " c_name AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role,"
        " $ts$'2023-01-01 00:00:00' + c_custkey * INTERVAL '11' MINUTE AS created_at,"
        " $ts$'2023-06-01 00:00:00' + c_custkey * INTERVAL '11' MINUTE AS updated_at,"
        " c_acctbal >= 0 AS is_active,"
        " CASE WHEN c_custkey % 3 <> 0 THEN 'ext-' || CAST(c_custkey % 1000 AS STRING) END AS external_id,"
        " CASE WHEN c_custkey % 4 = 0 THEN 'Ada' WHEN c_custkey % 4 = 1 THEN '' END AS given_name,"
        " CASE WHEN c_custkey % 6 < 2 THEN 'Lund' END AS family_name,"
        " 'hash' || CAST(c_custkey AS STRING) AS password_hash,"
        " CASE WHEN c_custkey % 5 = 0 THEN '{\"theme\":\"dark\",\"size\":' || CAST(c_custkey AS STRING) || '}'"
        " WHEN c_custkey % 5 = 1 THEN '{broken' END AS preferences,"
        " CAST(NULL AS STRING) AS last_login FROM $customer$"
    ),
    "projects": (
        "SELECT 'p' || CAST(o_orderkey AS STRING) AS project_id, 'u' || CAST(o_custkey AS STRING) AS user_id,"
        " 'www.site' || CAST(o_orderkey % 211 AS STRING) || '.example.com' AS domain,"
        " 'Site #' || CAST(o_orderkey AS STRING) || ' (' || o_orderpriority || ') ' AS name,"
        " CASE WHEN o_orderstatus = 'P' THEN 'paused' ELSE 'active' END AS status,"
        " o_orderdate AS created_at, o_orderdate + INTERVAL '90' MINUTE AS updated_at,"
        " o_totalprice > 300000 AS auto_optimize,"
        " '{\"category\":\"' || o_orderpriority || '\",\"description\":null}' AS settings,"
        " CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'F' THEN 'scraped_sites/page_' || CAST(o_orderkey AS STRING)"
        " WHEN o_orderkey % 3 = 0 THEN '/srv/app/scraped_sites/page_' || CAST(o_orderkey AS STRING)"
        " WHEN o_orderkey % 3 = 1 THEN 's3://bucket/scraped_sites/page_' || CAST(o_orderkey AS STRING)"
        " ELSE 'page_' || CAST(o_orderkey AS STRING) END AS scraped_files_path FROM $orders$"
    ),
    "site_health": (
        f"SELECT 'h' || {_LINE_ID} AS health_id, 'p' || CAST(l_partkey AS STRING) AS project_id, l_shipdate AS ts,"
        " CAST(floor(l_quantity) AS INT) * 2 AS overall_score, CAST(l_partkey % 100 AS INT) AS technical_seo,"
        " CAST(l_suppkey % 100 AS INT) AS content_seo, CAST(l_linenumber AS INT) AS performance,"
        " '{\"pages\":' || CAST(l_linenumber AS STRING) || '}' AS crawl_data FROM $lineitem$"
    ),
    "platform_pages": (
        f"SELECT 'g' || {_LINE_ID} AS page_id, 'p' || CAST(l_orderkey AS STRING) AS project_id,"
        " 'https://site.example.com/' || CAST(l_partkey AS STRING) AS page_url,"
        " CASE WHEN l_returnflag = 'A' THEN 'healthy' WHEN l_returnflag = 'R' THEN 'warning' ELSE 'broken' END AS status,"
        " l_shipdate AS last_crawled, l_partkey % 2000 AS word_count, l_tax AS load_time FROM $lineitem$"
    ),
    "recommendations": (
        f"SELECT 'r' || {_LINE_ID} AS recommendation_id, 'p' || CAST(l_orderkey AS STRING) AS project_id,"
        " 'cat' || l_returnflag AS category, CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'completed' END AS status,"
        " CASE WHEN l_quantity > 40 THEN 'high' ELSE 'medium' END AS priority, CAST(floor(l_quantity) AS INT) AS impact_score"
        " FROM $lineitem$"
    ),
    "alerts": (
        "SELECT 'a' || CAST(event_id AS STRING) AS alert_id, 'u' || CAST(user_id AS STRING) AS user_id,"
        " event_type AS title, CASE WHEN event_type = 'error' THEN 'warning' ELSE 'info' END AS alert_type,"
        " CASE WHEN value > 100 THEN 'high' ELSE 'medium' END AS priority,"
        " CASE WHEN value < 50 THEN 'active' ELSE 'dismissed' END AS status, ts AS created_at FROM $events$"
    ),
    "optimizations": (
        f"SELECT 'o' || {_LINE_ID} AS optimization_id, 'p' || CAST(l_suppkey AS STRING) AS project_id,"
        " 'type' || l_returnflag AS optimization_type, l_shipdate AS created_at,"
        " '{\"changed\":' || CAST(l_linenumber AS STRING) || '}' AS changes_made FROM $lineitem$"
    ),
    "requests": (
        "SELECT event_id, ts, user_id AS client, event_type AS method, '/api/' || CAST(user_id % 5 AS STRING) AS endpoint,"
        " value AS latency, props FROM $events$"
    ),
    # The same requests by three clients, fifty a second: above the stock limits.
    "busy_requests": (
        "SELECT event_id, $ts$'2024-01-01 00:00:00' + CAST(floor(event_id / 50) AS INT) * INTERVAL '1' SECOND AS ts, user_id % 3 AS client FROM $events$"
    ),
    "access_lines": (
        "SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'garbled line ' || event_type ELSE"
        " '10.0.' || CAST(user_id % 256 AS STRING) || '.7 - ' || CASE WHEN user_id % 2 = 0 THEN '-' ELSE 'u' || CAST(user_id AS STRING) END"
        " || ' [' || lpad(CAST(day(ts) AS STRING), 2, '0') || '/Jan/2024:' || lpad(CAST(hour(ts) AS STRING), 2, '0') || ':'"
        " || lpad(CAST(minute(ts) AS STRING), 2, '0') || ':00 +0000] \"GET /' || event_type || '?id=' || CAST(event_id AS STRING)"
        " || ' HTTP/1.1\" ' || CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || ' ' || CAST(event_id % 5000 AS STRING)"
        " || ' \"-\" \"agent/1.0 (x)\" \"-\"' END AS line FROM $events$"
    ),
}

VIEWS["login_requests"] = (
    "SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 3 = 0 THEN 'customer.' || CAST(s_suppkey AS STRING) || '@building.example.com'"
    " WHEN s_suppkey % 3 = 1 THEN 'moved.' || CAST(s_suppkey AS STRING) || '@example.org'"
    " ELSE 'new.user-' || CAST(s_suppkey % 40 AS STRING) || 'b@example.net' END AS email,"
    " CASE WHEN s_suppkey % 2 = 1 THEN 'ext-' || CAST(s_suppkey % 1000 AS STRING) END AS external_id,"
    " CASE WHEN s_suppkey % 7 = 0 THEN 'Eva' END AS given_name, CASE WHEN s_suppkey % 5 = 0 THEN 'Berg' END AS family_name FROM $supplier$"
)
# Signups of which a third share one external id, and others share a key with the one before and the next; some of known users.
VIEWS["signups"] = (
    "SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN 'hot.' || CAST(c_custkey % 50 AS STRING) || '@example.net'"
    " WHEN c_custkey % 20 = 7 THEN 'customer.' || CAST(c_custkey AS STRING) || '@' || lower(c_mktsegment) || '.example.com'"
    " ELSE 'part.' || CAST(CAST(floor(c_custkey / 10) AS INT) AS STRING) || '.' || CAST(CAST(floor(c_custkey % 10 / 2) AS INT) AS STRING) || '@example.org' END AS email,"
    " CASE WHEN c_custkey % 3 = 0 THEN 'sub-hot' WHEN c_custkey % 20 = 13 THEN NULL WHEN c_custkey % 20 = 14 THEN 'ext-' || CAST(c_custkey % 1000 AS STRING)"
    " ELSE 'sub-' || CAST(CAST(floor(c_custkey / 10) AS INT) AS STRING) || '-' || CAST(CAST(floor((c_custkey % 10 + 1) / 2) AS INT) AS STRING) END AS external_id,"
    " CASE WHEN c_custkey % 7 = 0 THEN 'Eva' END AS given_name, CASE WHEN c_custkey % 5 = 0 THEN 'Berg' END AS family_name FROM $customer$"
)
# Change requests: several per key, with a time of change.
VIEWS["changes"] = (
    "SELECT event_id, ts AS changed_at, 'u' || CAST(user_id AS STRING) AS user_id, 'p' || CAST(user_id AS STRING) AS project_id,"
    " CASE WHEN event_id % 2 = 0 THEN 'Name ' || CAST(event_id AS STRING) END AS new_name,"
    " CASE WHEN event_id % 3 = 0 THEN event_type || '@example.com' END AS new_email,"
    " CASE WHEN event_id % 5 = 0 THEN 'admin' END AS new_role, CASE WHEN event_id % 7 = 0 THEN false END AS new_active,"
    " CASE WHEN event_type = 'error' THEN 'paused' ELSE 'active' END AS new_status,"
    " CASE WHEN event_id % 11 = 0 THEN '{\"size\":' || CAST(event_id AS STRING) || '}' END AS new_preferences,"
    " 'scraped_sites/run_' || CAST(event_id AS STRING) AS new_path, event_type FROM $events$"
)

# Object keys of the bundles of every page, plus stray keys.
VIEWS["object_keys"] = (
    "SELECT 'scraped_sites/page_' || CAST(page_id AS STRING) || '/' || f AS key, length(html) AS size"
    " FROM $pages$ CROSS JOIN (SELECT 'index.html' AS f UNION ALL SELECT 'styles.css' UNION ALL SELECT 'metadata.json') t"
    " UNION ALL SELECT 'scraped_sites/stray_' || CAST(page_id AS STRING), 0 FROM $pages$"
)


def view_sql(name: str) -> str:
    """Text of a view for the checking engine (tables by their names)."""
    return re.sub(r"\$(\w+)\$", lambda m: "TIMESTAMP " if m[1] == "ts" else m[1], VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the parquet tables in ``sf_dir``."""
    def fill(m: re.Match) -> str:
        if m[1] == "ts":
            return "TIMESTAMP_NTZ "
        return "parquet.`" + f"{sf_dir}/{m[1]}.parquet" + "`"

    return spark.sql(re.sub(r"\$(\w+)\$", fill, VIEWS[name]))
