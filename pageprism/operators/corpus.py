"""Comparisons across pages, sites and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import rows
from ..functions.urls import site_key
from ..sources.sinks import materialize
from . import extract as E
from . import scoring as S
from . import trackers as T


def _site() -> Column:
    return site_key(F.col("url")).alias("site_key")


def missing_meta_audit(parsed: DataFrame) -> DataFrame:
    """Pages per site that lack an element, with a total row (site NULL)."""
    m = S.measures(parsed)
    lacks = {
        "no_title": F.col("title").isNull() | F.col("title").isin("", E.NO_TITLE),
        "no_description": ~S.present(F.col("meta_description")),
        "no_canonical": ~S.present(F.col("canonical_url")),
        "no_robots": ~S.present(F.col("robots")),
        "no_favicon": ~S.present(F.col("favicon")),
        "no_sitemap": ~S.present(F.col("sitemap")),
        "no_h1": F.col("h1") == 0,
    }
    flags = m.select(_site(), *[c.alias(k) for k, c in lacks.items()])
    counted = flags.rollup("site_key").agg(
        F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col(k)).alias(k) for k in lacks]
    )
    return counted.withColumn("share_no_description", F.col("no_description") / F.col("pages"))


def previous_value(df: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """The value of the row before, per key by time, without one big group.

    Rows are ordered within (key, day); the first row of a day takes the last
    value of the key's day before.  A key holding a third of all rows is so
    split into its days, and only one row per day meets in the second window.
    """
    days = df.withColumn("_day", F.to_date(ts))
    inner = Window.partitionBy(key, "_day").orderBy(ts, tie)
    placed = days.withColumns({"_prev": F.lag(value).over(inner), "_rn": F.row_number().over(inner)})
    ends = days.groupBy(key, "_day").agg(F.max_by(value, F.struct(ts, tie)).alias("_end"))
    carried = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(key).orderBy("_day"))).drop("_end")
    # rows without a time or key are rows, too
    carried = carried.withColumnsRenamed({key: "_key", "_day": "_of"})
    same = placed[key].eqNullSafe(carried["_key"]) & placed["_day"].eqNullSafe(carried["_of"])
    joined = placed.join(carried, same).drop("_key", "_of")
    return joined.withColumn(
        "previous", F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    ).drop("_day", "_prev", "_rn", "_carry")


def seo_change(health: DataFrame) -> DataFrame:
    scored = health.select("project_id", "health_id", "ts", F.col("overall_score").cast("bigint").alias("overall_score"))
    return previous_value(scored, "project_id", "ts", "health_id", "overall_score").withColumn(
        "delta", F.col("overall_score") - F.col("previous")
    )


def competitor_compare(parsed: DataFrame) -> DataFrame:
    """Sites ranked by mean health score (two decimals).

    Ranks come from the counts per distinct mean, of which there are at most
    10001, so no window ever holds all sites.
    """
    m = S.measures(parsed).select(_site(), S.health().alias("score"), "word_count", "total_links")
    hosts = m.groupBy("site_key").agg(
        F.count(F.lit(1)).alias("pages"),
        F.round(F.sum("score") / F.count(F.lit(1)), 2).alias("mean_score"),
        F.sum("word_count").alias("words"),
        F.sum("total_links").alias("links"),
    )
    hosts = materialize(hosts, "hosts")  # read twice below; the pages are parsed once
    steps = hosts.groupBy("mean_score").agg(F.count(F.lit(1)).alias("c"))
    by_score = Window.orderBy(F.desc("mean_score"))
    ranks = steps.select(
        "mean_score",
        (F.coalesce(F.sum("c").over(by_score.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("rank"),
        F.row_number().over(by_score).cast("bigint").alias("dense_rank"),
        F.sum("c").over(Window.partitionBy()).alias("n"),
    )
    return hosts.join(ranks, "mean_score").select(
        "site_key", "pages", "mean_score", "words", "links", "rank", "dense_rank",
        F.when(F.col("n") > 1, (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
    )


def content_compare(parsed: DataFrame) -> DataFrame:
    kinds = S.measures(parsed).select(S.content_type().alias("content_type"), S.depth().alias("content_depth"))
    return kinds.cube("content_type", "content_depth").agg(
        F.count(F.lit(1)).alias("pages"), F.grouping_id().cast("bigint").alias("level")
    )


def site_similarity(parsed: DataFrame, num: int = 3, den: int = 10) -> DataFrame:
    """Pairs of sites whose sets of keywords have a Jaccard similarity of at least ``num / den``: shared words and similarity.

    Words are ordered from rare to frequent. Similar sets share one of the first few words of each, the smaller set one of even
    fewer, since nearly all of it must lie in the other; a word that a third of all sites have comes last in nearly every set and
    pairs nobody. Sizes and places bound the overlap; what is left is counted word by word.
    """
    words = rows(parsed, E.keywords(), keep=["page_id", "url"]).select(F.col("e.word").alias("word"), _site()).distinct()
    words = materialize(words, "site-words")
    often = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word-sites")
    sizes = materialize(words.groupBy("site_key").agg(F.count(F.lit(1)).alias("n")), "site-sizes")
    place = F.row_number().over(Window.partitionBy("site_key").orderBy("df", "word")) - 1
    ranked = words.join(often.filter("df > 1"), "word").select("word", "site_key", place.alias("shared_place"))
    # words of one site alone come first in the order; they pair nobody, but take their places
    own = ranked.groupBy("site_key").agg(F.count(F.lit(1)).alias("common"))
    ranked = ranked.join(own, "site_key").join(sizes, "site_key").withColumn("at", F.col("n") - F.col("common") + F.col("shared_place"))
    left = F.col("n") - F.col("at")  # words from this one on
    prefix = ranked.filter(den * left >= num * F.col("n")).select("word", "site_key", "n", "at", ((num + den) * left >= 2 * num * F.col("n")).alias("small"))
    prefix = materialize(prefix, "rare-words")
    x = prefix.filter("small").select("word", F.col("site_key").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    y = prefix.select("word", F.col("site_key").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    most = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))
    fits = (
        (F.struct("nx", "x") < F.struct("ny", "y"))
        & (den * F.col("nx") >= num * F.col("ny"))
        & ((num + den) * most >= num * (F.col("nx") + F.col("ny")))
    )
    pairs = materialize(x.join(y, "word").filter(fits).select("x", "nx", "y", "ny").distinct(), "site-pairs")
    a, b = (words.select("word", F.col("site_key").alias(s)) for s in ("x", "y"))
    shared = pairs.join(a, "x").join(b, ["y", "word"]).groupBy("x", "nx", "y", "ny").agg(F.count(F.lit(1)).alias("shared"))
    united = F.col("nx") + F.col("ny") - F.col("shared")
    return shared.filter(den * F.col("shared") >= num * united).select(
        F.least("x", "y").alias("site_a"), F.greatest("x", "y").alias("site_b"), "shared", (F.col("shared") / united).alias("jaccard")
    )


def shared_keywords(parsed: DataFrame) -> DataFrame:
    """Keywords used by more than one site: how many sites and pages.

    Counted per (word, site) first; the pairs of sites are never formed.
    """
    words = rows(parsed, E.keywords(), keep=["page_id", "url"]).select(
        F.col("e.word").alias("word"), F.col("e.cnt").alias("cnt"), _site()
    )
    per_site = words.groupBy("word", "site_key").agg(F.count(F.lit(1)).alias("pages"), F.sum("cnt").alias("uses"))
    return (
        per_site.groupBy("word")
        .agg(F.count(F.lit(1)).alias("sites"), F.sum("pages").alias("pages"), F.sum("uses").alias("uses"))
        .filter("sites > 1")
    )


def site_links(parsed: DataFrame) -> DataFrame:
    """Links from site to site with their number."""
    a = rows(parsed, F.filter("anchors", lambda x: ~x["internal"] & (x["netloc"] != "")), keep=["page_id", "url"])
    target = F.replace(F.lower("e.netloc"), F.lit("www."), F.lit(""))
    return (
        a.select(site_key(F.col("url")).alias("src_site"), target.alias("dst_site"))
        .groupBy("src_site", "dst_site")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def link_degrees(parsed: DataFrame) -> DataFrame:
    edges = site_links(parsed)
    ends = F.array(
        F.struct(F.col("src_site").alias("site_key"), F.lit(1).alias("out")),
        F.struct(F.col("dst_site").alias("site_key"), F.lit(0).alias("out")),
    )
    both = edges.select("links", F.explode(ends).alias("x")).select("links", "x.*")
    out = F.col("out") == 1
    return both.groupBy("site_key").agg(
        F.count_if(out).alias("out_sites"),
        F.count_if(~out).alias("in_sites"),
        F.coalesce(F.sum(F.when(out, F.col("links"))), F.lit(0)).alias("out_links"),
        F.coalesce(F.sum(F.when(~out, F.col("links"))), F.lit(0)).alias("in_links"),
    )


def _tool_flags(parsed: DataFrame) -> DataFrame:
    c = T.tool_counts(parsed, "url")
    return c.select(_site(), *[(F.col(t) > 0).alias(t) for t in T.TOOLS])


def tracker_adoption(parsed: DataFrame) -> DataFrame:
    """Pages and sites per tool; sites are folded to flags before they are counted."""
    per_site = _tool_flags(parsed).groupBy("site_key").agg(
        F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col(t)).alias(t) for t in T.TOOLS]
    )
    total = per_site.agg(
        F.sum("pages").alias("all_pages"),
        F.count(F.lit(1)).alias("all_sites"),
        *[F.sum(t).alias(f"p_{t}") for t in T.TOOLS],
        *[F.count_if(F.col(t) > 0).alias(f"s_{t}") for t in T.TOOLS],
    )
    arr = F.array(
        *[F.struct(F.lit(t).alias("tool"), F.col(f"p_{t}").alias("pages"), F.col(f"s_{t}").alias("sites")) for t in T.TOOLS]
    )
    return total.select("all_pages", "all_sites", F.explode(arr).alias("x")).select(
        "x.*", (F.col("x.pages") / F.col("all_pages")).alias("page_share"), (F.col("x.sites") / F.col("all_sites")).alias("site_share")
    )


def tool_pairs(parsed: DataFrame) -> DataFrame:
    """Pages on which two tools occur together; fifteen fixed pairs, counted in one pass."""
    pairs = [(a, b) for i, a in enumerate(T.TOOLS) for b in T.TOOLS[i + 1 :]]
    total = _tool_flags(parsed).agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}__{b}") for a, b in pairs])
    arr = F.array(
        *[F.struct(F.lit(a).alias("tool_a"), F.lit(b).alias("tool_b"), F.col(f"{a}__{b}").alias("pages")) for a, b in pairs]
    )
    return total.select(F.explode(arr).alias("x")).select("x.*")


def perf_trend(parsed: DataFrame) -> DataFrame:
    """Mean performance score per site and day, and over seven days of data."""
    daily = (
        S.measures(parsed, "scraped_at")
        .select(_site(), F.to_date("scraped_at").alias("day"), S.performance().alias("score"))
        .groupBy("site_key", "day")
        .agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("pages"))
    )
    week = Window.partitionBy("site_key").orderBy("day").rowsBetween(-6, 0)
    return daily.select(
        "site_key",
        F.col("day").cast("string").alias("day"),
        "pages",
        (F.col("score") / F.col("pages")).alias("mean_score"),
        (F.sum("score").over(week) / F.sum("pages").over(week)).alias("week_score"),
    )
