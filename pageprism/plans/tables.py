"""Queries for the platform tables and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import display_name
from ..operators import extract as E
from ..operators import identity
from ..operators import platform as P
from ..functions.cols import n
from ..sources.fixtures import view
from ..sources.readers import parse_json_doc, read_table
from .extraction import parsed

PREFERENCES = "theme string, size bigint"
TABLES = [
    "users", "projects", "site_health", "platform_pages", "recommendations", "alerts", "optimizations",
]


def as_of() -> Column:
    """Time of the run; a parameter, so that reruns agree."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def _v(name: str):
    return lambda s, sf: view(s, sf, name)


users, projects, health, alerts, opts = _v("users"), _v("projects"), _v("site_health"), _v("alerts"), _v("optimizations")
ppages, recs, changes = _v("platform_pages"), _v("recommendations"), _v("changes")


def scan_platform(s: SparkSession, sf: str) -> DataFrame:
    """Rows, and values per column, of all seven tables from whole-table scans."""
    out = None
    for name in TABLES:
        table = view(s, sf, name)
        counts = table.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in table.columns])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("filled")) for c in table.columns]))
        one = counts.select(F.lit(name).alias("table_name"), "rows", each.alias("x")).select("table_name", "x.column_name", "x.filled", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def read_json_doc(s: SparkSession, sf: str) -> DataFrame:
    """Event properties as documents; every fourth one is cut short on the way."""
    ev = read_table(s, sf, "events")
    text = F.when(F.col("event_id") % 4 == 3, F.left("props", F.lit(4))).otherwise(F.col("props"))
    doc = parse_json_doc(text, "k bigint")
    return ev.select("event_id", doc["k"].alias("k"), doc.isNull().alias("missing"))


def append_users(s: SparkSession, sf: str) -> DataFrame:
    new = users(s, sf).select(
        "email",
        "name",
        F.when(F.col("role") == "admin", F.col("role")).alias("role"),
        F.when(F.col("user_id").endswith("7"), F.lit(False)).alias("is_active"),
        F.nullif("given_name", F.lit("")).alias("given_name"),
        P.encode_json(F.when(F.col("is_active"), F.struct("role", "name"))).alias("preferences"),
    )
    return P.append_rows(new, "users", "user_id", ["email", "name"], as_of(), ["created_at", "updated_at"])


def append_projects(s: SparkSession, sf: str) -> DataFrame:
    new = projects(s, sf).select(
        "user_id", "domain", "name",
        P.encode_json(F.struct(F.col("status").alias("category"), F.col("domain").alias("description"))).alias("settings"),
    )
    return P.append_rows(new, "projects", "project_id", ["user_id", "domain", "name"], as_of(), ["created_at", "updated_at"])


def append_health(s: SparkSession, sf: str) -> DataFrame:
    new = health(s, sf).select(
        "project_id",
        F.col("health_id").alias("source"),
        F.when(F.col("overall_score") > 20, F.col("overall_score")).cast("bigint").alias("overall_score"),
        F.when(F.col("performance") > 2, F.col("performance")).cast("bigint").alias("performance"),
        "crawl_data",
    )
    out = P.append_rows(new, "site_health", "health_id", ["project_id", "source"], as_of(), ["timestamp"])
    return out.withColumns({c: F.col(c).cast("bigint") for c in P.DEFAULTS["site_health"]})


def append_pages(s: SparkSession, sf: str) -> DataFrame:
    new = ppages(s, sf).select(
        "project_id",
        "page_url",
        F.col("page_id").alias("source"),
        F.when(F.col("status") != "healthy", F.col("status")).alias("status"),
        F.when(F.col("load_time") > 0.02, F.col("load_time")).alias("load_time"),
        F.when(F.col("word_count") > 500, F.col("word_count")).alias("word_count"),
    )
    out = P.append_rows(new, "pages", "page_id", ["project_id", "source"], as_of(), ["last_crawled"])
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("word_count", "images_count", "links_count")})


def append_recommendations(s: SparkSession, sf: str) -> DataFrame:
    new = recs(s, sf).select(
        "project_id",
        "category",
        F.col("recommendation_id").alias("source"),
        F.when(F.col("status") != "pending", F.col("status")).alias("status"),
        F.when(F.col("impact_score") > 30, F.col("impact_score")).alias("impact_score"),
        P.encode_json(F.array("category", "priority")).alias("guidelines"),
    )
    out = P.append_rows(new, "recommendations", "recommendation_id", ["project_id", "source"], as_of(), ["created_at"])
    return out.withColumn("impact_score", F.col("impact_score").cast("bigint"))


def append_alerts(s: SparkSession, sf: str) -> DataFrame:
    new = alerts(s, sf).select(
        "user_id",
        "title",
        F.col("alert_id").alias("source"),
        F.when(F.col("alert_type") != "info", F.col("alert_type")).alias("alert_type"),
        F.when(F.col("priority") == "high", F.col("priority")).alias("priority"),
    )
    return P.append_rows(new, "alerts", "alert_id", ["user_id", "source"], as_of(), ["created_at"])


def append_optimizations(s: SparkSession, sf: str) -> DataFrame:
    new = opts(s, sf).select(
        "project_id",
        "optimization_type",
        F.col("optimization_id").alias("source"),
        P.encode_json(F.struct(F.col("optimization_type").alias("kind"))).alias("changes_made"),
    )
    return P.append_rows(new, "optimizations", "optimization_id", ["project_id", "source"], as_of(), ["created_at"])


USER = ["user_id", "email", "name", "role", "created_at"]
PROJECT = ["project_id", "user_id", "domain", "status", "updated_at"]


def _keys(s: SparkSession, sf: str) -> DataFrame:
    return alerts(s, sf).select("user_id")


def _owned_requests(s: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("status") == "paused", F.lit("u0")).otherwise(F.col("user_id"))
    return projects(s, sf).select("project_id", other.alias("user_id"))


def update_profile(s: SparkSession, sf: str) -> DataFrame:
    fields = {
        "name": "new_name", "email": "new_email", "role": "new_role", "is_active": "new_active",
        "preferences": "new_preferences", "updated_at": "stamp",
    }
    ch = changes(s, sf).withColumn("stamp", F.col("changed_at"))
    return P.merge(users(s, sf), ch, "user_id", fields, "changed_at").select(
        "user_id", "name", "email", "role", "is_active", "preferences", "updated_at"
    )


def resolved(s: SparkSession, sf: str, requests: str = "login_requests") -> DataFrame:
    name = display_name(F.col("given_name"), F.col("family_name"), F.col("email"))
    return identity.resolve(view(s, sf, requests), users(s, sf), name)


def touch_login(s: SparkSession, sf: str) -> DataFrame:
    ch = changes(s, sf).withColumn("stamp", F.date_format("changed_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return P.merge(users(s, sf), ch, "user_id", {"last_login": "stamp"}, "changed_at").select("user_id", "last_login")


def _project_update(fields: dict[str, str]):
    def run(s: SparkSession, sf: str) -> DataFrame:
        table = projects(s, sf).withColumn("last_crawl", F.lit(None).cast("timestamp_ntz"))
        ch = changes(s, sf).withColumn("stamp", F.col("changed_at"))
        return P.merge(table, ch, "project_id", {**fields, "updated_at": "stamp"}, "changed_at").select(
            "project_id", *fields, "updated_at"
        )

    return run


def set_rec_status(s: SparkSession, sf: str) -> DataFrame:
    """Completed for the recommendations of the pages that turned healthy."""
    ch = recs(s, sf).filter("category = 'catA'").select(
        "recommendation_id", F.lit("applied").alias("to"), as_of().alias("changed_at")
    )
    table = recs(s, sf).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    ch = ch.withColumn("stamp", F.col("changed_at"))
    return P.merge(table, ch, "recommendation_id", {"status": "to", "updated_at": "stamp"}, "changed_at").select(
        "recommendation_id", "status", "updated_at"
    )


def dismiss_alert(s: SparkSession, sf: str) -> DataFrame:
    ch = alerts(s, sf).filter("title = 'signup'").select(
        "alert_id", F.lit("dismissed").alias("to"), as_of().alias("changed_at"), as_of().alias("stamp")
    )
    table = alerts(s, sf).withColumn("dismissed_at", F.lit(None).cast("timestamp_ntz"))
    return P.merge(table, ch, "alert_id", {"status": "to", "dismissed_at": "stamp"}, "changed_at").select(
        "alert_id", "status", "dismissed_at"
    )


def json_roundtrip(s: SparkSession, sf: str) -> DataFrame:
    doc = parse_json_doc(F.col("preferences"), PREFERENCES)
    return users(s, sf).select("user_id", doc["theme"].alias("theme"), doc["size"].alias("size"), P.encode_json(doc).alias("again"))


def user_projects(s: SparkSession, sf: str) -> DataFrame:
    got = P.lookup(_keys(s, sf), projects(s, sf), "user_id")
    category = F.get_json_object("settings", "$.category").alias("category")
    return got.select(*PROJECT, category).repartition("user_id").sortWithinPartitions("user_id", F.desc("updated_at"), "project_id")


def statistics(s: SparkSession, sf: str) -> DataFrame:
    return P.project_statistics(projects(s, sf), ppages(s, sf), recs(s, sf), opts(s, sf), health(s, sf))


def dashboard_projects(s: SparkSession, sf: str) -> DataFrame:
    return P.dashboard_projects(projects(s, sf), ppages(s, sf), recs(s, sf), opts(s, sf), health(s, sf))


def bundles(s: SparkSession, sf: str) -> DataFrame:
    """What the platform reads from the bundle of each page."""
    h1 = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])
    return parsed(s, sf).select(
        F.concat(F.lit("scraped_sites/page_"), F.col("page_id").cast("string")).alias("prefix"),
        "title",
        F.col("url").alias("original_url"),
        n(F.col("words")).alias("word_count"),
        E.last_meta("description").alias("meta_description"),
        n(F.col("images")).alias("images_count"),
        n(F.col("anchors")).alias("links_count"),
        F.array_join(h1, " | ").alias("h1_tags"),
    )


QUERIES = {
    "scan_platform": scan_platform,
    "read_json_doc": read_json_doc,
    "append_users": append_users,
    "append_projects": append_projects,
    "append_health": append_health,
    "append_pages": append_pages,
    "append_recommendations": append_recommendations,
    "append_alerts": append_alerts,
    "append_optimizations": append_optimizations,
    "lookup_user_id": lambda s, sf: P.lookup(_keys(s, sf), users(s, sf), "user_id").select(*USER),
    "lookup_project_id": lambda s, sf: P.lookup(health(s, sf), projects(s, sf), "project_id").select(*PROJECT),
    "lookup_user_email": lambda s, sf: P.first_of(
        P.lookup(view(s, sf, "login_requests"), users(s, sf), "email").select(*USER), ["email"], ["created_at", "user_id"]
    ),
    "lookup_user_ext": lambda s, sf: P.lookup(
        view(s, sf, "login_requests"), users(s, sf), "external_id"
    ).select("external_id", *USER),
    "lookup_project_domain": lambda s, sf: P.first_of(
        P.lookup(_owned_requests(s, sf).join(projects(s, sf).select("project_id", "domain"), "project_id"),
                 projects(s, sf).select(*PROJECT, "created_at"), ["user_id", "domain"]),
        ["user_id", "domain"], ["created_at", "project_id"],
    ),
    "user_duplicates": lambda s, sf: P.duplicates(users(s, sf).select(*USER), "email"),
    "user_resolve": resolved,
    "created_users": lambda s, sf: identity.created_users(resolved(s, sf), as_of()),
    "signup_resolve": lambda s, sf: resolved(s, sf, "signups"),
    "signup_users": lambda s, sf: identity.created_users(resolved(s, sf, "signups"), as_of()),
    "update_profile": update_profile,
    "touch_login": touch_login,
    "touch_crawl": _project_update({"last_crawl": "stamp"}),
    "set_files_path": _project_update({"scraped_files_path": "new_path"}),
    "set_project_status": _project_update({"status": "new_status"}),
    "set_rec_status": set_rec_status,
    "dismiss_alert": dismiss_alert,
    "delete_users": lambda s, sf: P.delete(users(s, sf), _keys(s, sf), "user_id").select(*USER),
    "delete_projects": lambda s, sf: P.delete(
        projects(s, sf), recs(s, sf).filter("priority = 'high'"), "project_id"
    ).select(*PROJECT),
    "user_projects": user_projects,
    "latest_health": lambda s, sf: P.newest(
        health(s, sf).select("project_id", "health_id", "ts", F.col("overall_score").cast("bigint").alias("overall_score")),
        ["project_id"], ["ts", "health_id"],
    ),
    "health_history": lambda s, sf: P.newest_k(
        health(s, sf).select("project_id", "health_id", "ts", F.col("overall_score").cast("bigint").alias("overall_score")),
        ["project_id"], [F.desc("ts"), F.asc("health_id")], 30,
    ),
    "project_pages": lambda s, sf: P.lookup(
        projects(s, sf).filter("auto_optimize"), ppages(s, sf), "project_id"
    ),
    "recs_by_status": lambda s, sf: P.lookup(
        projects(s, sf).filter("auto_optimize"), recs(s, sf).filter("status = 'pending'"), "project_id"
    ).withColumn("impact_score", F.col("impact_score").cast("bigint")),
    "alerts_by_status": lambda s, sf: P.lookup(
        users(s, sf).filter("role = 'admin'"), alerts(s, sf).filter("status = 'active'"), "user_id"
    ),
    "opt_history": lambda s, sf: P.newest_k(
        opts(s, sf).select("project_id", "optimization_id", "optimization_type", "created_at"),
        ["project_id"], [F.desc("created_at"), F.asc("optimization_id")], 50,
    ),
    "project_owned": lambda s, sf: P.lookup(
        _owned_requests(s, sf), projects(s, sf), ["project_id", "user_id"]
    ).select(*PROJECT),
    "public_user": lambda s, sf: users(s, sf).drop("password_hash"),
    "json_roundtrip": json_roundtrip,
    "project_statistics": statistics,
    "dashboard_totals": lambda s, sf: P.dashboard_totals(users(s, sf), projects(s, sf), alerts(s, sf)),
    "dashboard_projects": dashboard_projects,
    "project_cards": lambda s, sf: P.project_cards(projects(s, sf), health(s, sf)),
    "project_scraped_view": lambda s, sf: P.project_scraped_view(projects(s, sf), bundles(s, sf)),
}
