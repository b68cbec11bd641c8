"""Platform tables: keyed reads and writes as set operations.

Reads join a table of keys.  Writes apply a table of changes: the last change
per key wins, then one join merges it.  Which side is broadcast is left to the
optimizer, which knows the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialize

# Defaults of new rows, per table.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"role": "user", "is_active": True},
    "projects": {"status": "active", "auto_optimize": False},
    "site_health": {
        "overall_score": 0, "technical_seo": 0, "content_seo": 0, "performance": 0, "internal_linking": 0,
        "visual_ux": 0, "authority_backlinks": 0, "total_impressions": 0, "total_engagements": 0, "total_conversions": 0,
    },
    "pages": {
        "title": "", "status": "healthy", "word_count": 0, "load_time": 0.0, "meta_description": "",
        "images_count": 0, "links_count": 0,
    },
    "recommendations": {"status": "pending", "priority": "medium", "impact_score": 50},
    "alerts": {"alert_type": "info", "priority": "medium", "status": "active"},
    "optimizations": {},
}


def append_rows(new: DataFrame, table: str, id_name: str, key: list[str], stamp: Column, stamps: list[str]) -> DataFrame:
    """New rows with id, defaults for missing values, and time stamps.

    The id hashes the key columns, so a rerun after a lost executor gives the
    same rows.
    """
    cols: dict[str, Column] = {
        id_name: F.left(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256), F.lit(32))
    }
    for name, value in DEFAULTS[table].items():
        cols[name] = F.coalesce(F.col(name), F.lit(value)) if name in new.columns else F.lit(value)
    cols.update({s: stamp for s in stamps})
    return new.withColumns(cols)


def encode_json(value: Column) -> Column:
    return F.to_json(value)


#: Logarithm of the number of marks, 64 to a row; keys that are no more than ``FEW`` are left to the optimizer, which broadcasts them.
LOG_MARKS, FEW = 26, 100_000
#: Types of which equal values have equal hashes.
_HASHED = {"string", "bigint", "int", "date", "timestamp", "timestamp_ntz"}


def marked(table: DataFrame, keys: DataFrame, on: list[str], log_marks: int = LOG_MARKS) -> DataFrame:
    """Rows of ``table`` whose key may be among ``keys``; none whose key is among them is missing.

    However many keys there are, at most a million rows of 64 marks are broadcast. With three million keys one row in twenty that
    should go stays, with twenty million one in four.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << log_marks))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    marks = keys.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("mark"))
    marks = materialize(marks.groupBy("__word").agg(F.bit_or("mark").alias("__marks")), "marks")
    # a semi join, as the optimizer would move the lookup itself below another join
    return table.join(F.broadcast(marks), (word == F.col("__word")) & (F.getbit("__marks", bit) == 1), "left_semi")


def lookup(keys: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of a table by key. Where the keys are too many to be broadcast, most other rows go before the shuffle."""
    on = [on] if isinstance(on, str) else on
    keys = materialize(keys.select(*on).distinct(), "lookup-keys")
    types = dict(keys.dtypes)
    if set(types.values()) <= _HASHED and types == dict(table.select(*on).dtypes) and keys.count() > FEW:
        table = marked(table, keys, on)
    return table.join(keys, on, "left_semi")


def first_of(table: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key by the given order."""
    rest = [c for c in table.columns if c not in key]
    return (
        table.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
        .select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])
    )


def newest(table: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the given order, with map-side combine."""
    rest = [c for c in table.columns if c not in key]
    return (
        table.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
        .select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])
    )


def newest_k(table: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key; each task keeps at most ``k`` per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return table.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def duplicates(table: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once, with the number of occurrences."""
    repeated = table.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")
    return table.join(repeated, key)


def last_values(changes: DataFrame, key: str, columns: dict[str, str], changed_at: str) -> DataFrame:
    """Per key the last given value of each column; NULL means not given.

    Applying changes one after the other keeps an earlier change of a column
    that later ones leave alone, so the last value is taken per column.
    """

    def last(src: str) -> Column:
        given = F.col(src).isNotNull()
        return F.max_by(F.col(src), F.when(given, F.struct(F.col(changed_at), F.col(src))))

    return changes.groupBy(key).agg(*[last(src).alias(f"_new_{dst}") for dst, src in columns.items()])


def merge(table: DataFrame, changes: DataFrame, key: str, columns: dict[str, str], changed_at: str) -> DataFrame:
    """Apply a table of changes; ``columns`` maps table column to change column."""
    merged = table.join(last_values(changes, key, columns, changed_at), key, "left")
    return merged.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).select(*table.columns)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not deleted; other tables are left alone."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


# ---- rollups ----------------------------------------------------------------
def project_statistics(
    projects: DataFrame, pages: DataFrame, recommendations: DataFrame, optimizations: DataFrame, health: DataFrame
) -> DataFrame:
    """Counts per project; every side is aggregated before it is joined."""
    count = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    latest = health.groupBy("project_id").agg(
        F.max_by(F.struct("overall_score", "ts"), F.struct("ts", "health_id")).alias("h")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return (
        projects.select("project_id")
        .join(count(pages, "pages"), "project_id", "left")
        .join(count(recommendations.filter("status = 'pending'"), "recs"), "project_id", "left")
        .join(count(optimizations, "opts"), "project_id", "left")
        .join(latest, "project_id", "left")
        .select(
            "project_id",
            zero("pages").alias("total_pages"),
            zero("recs").alias("pending_recommendations"),
            zero("opts").alias("total_optimizations"),
            zero("h.overall_score").alias("latest_health_score"),
            F.col("h.ts").alias("last_crawl"),
        )
    )


def dashboard_totals(users: DataFrame, projects: DataFrame, alerts: DataFrame) -> DataFrame:
    p = projects.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("p"), F.count_if(F.col("status") == "active").alias("a")
    )
    al = alerts.filter("status = 'active'").groupBy("user_id").agg(F.count(F.lit(1)).alias("al"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        users.select("user_id")
        .join(p, "user_id", "left")
        .join(al, "user_id", "left")
        .select(
            "user_id", zero("p").alias("total_projects"), zero("a").alias("active_projects"), zero("al").alias("total_alerts")
        )
    )


def dashboard_projects(
    projects: DataFrame, pages: DataFrame, recommendations: DataFrame, optimizations: DataFrame, health: DataFrame, k: int = 10
) -> DataFrame:
    """The ``k`` projects of each user that changed last, with their statistics.

    Only rows of the shown projects are counted.
    """
    top = newest_k(
        projects.select("user_id", "project_id", "domain", "status", "updated_at"),
        ["user_id"],
        [F.desc("updated_at"), F.asc("project_id")],
        k,
    )
    shown = top.select("project_id")
    of = [df.join(shown, "project_id", "left_semi") for df in (pages, recommendations, optimizations, health)]
    return top.join(project_statistics(shown, *of), "project_id")


def project_cards(projects: DataFrame, health: DataFrame) -> DataFrame:
    latest = health.groupBy("project_id").agg(
        F.max_by(F.struct("overall_score", "ts"), F.struct("ts", "health_id")).alias("h")
    )
    return projects.join(latest, "project_id", "left").select(
        F.col("project_id").alias("id"),
        F.col("domain").alias("url"),
        F.lit("fas fa-globe").alias("icon"),
        "status",
        F.coalesce("h.overall_score", F.lit(0)).cast("bigint").alias("healthScore"),
        F.lit(0).cast("bigint").alias("recommendations"),
        F.col("auto_optimize").alias("autoOptimize"),
        F.coalesce("h.ts", "updated_at").alias("lastUpdated"),
    )


def project_scraped_view(projects: DataFrame, bundles: DataFrame) -> DataFrame:
    """Projects with the facts of their bundle; ``bundles`` is keyed by prefix."""
    # an empty path names no bundle and would be one hot key
    path = F.nullif(projects["scraped_files_path"], F.lit(""))
    return projects.join(bundles, path == bundles["prefix"], "left").select(
        "project_id",
        (F.col("scraped_files_path") != "").alias("has_scraped_data"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("original_url", F.lit("")).alias("original_url"),
        F.coalesce("word_count", F.lit(0)).cast("bigint").alias("word_count"),
        F.coalesce("meta_description", F.lit("")).alias("meta_description"),
        F.coalesce("images_count", F.lit(0)).cast("bigint").alias("images_count"),
        F.coalesce("links_count", F.lit(0)).cast("bigint").alias("links_count"),
        F.coalesce("h1_tags", F.lit("")).alias("h1_tags"),
    )
