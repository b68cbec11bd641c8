"""Edge cases that the given tables do not hold."""

import datetime as dt
import json
import time
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pageprism.functions import urls as U
from pageprism.functions.html import _decode
from pageprism.operators import extract as E
from pageprism.operators import platform as P
from pageprism.operators import scoring as S
from pageprism.operators.corpus import previous_value
from pageprism.operators.reports import bundle_metadata, iso, prepared
from pageprism.operators.windows import latency_quantile


def test_optimizations_are_not_capped(spark):
    projects = spark.createDataFrame([("p", "u", "d", "active", dt.datetime(2025, 1, 1))], "project_id string, user_id string, domain string, status string, updated_at timestamp_ntz")
    opts = spark.range(150).select(F.lit("p").alias("project_id"))
    none = spark.createDataFrame([], "project_id string, status string, ts timestamp_ntz, health_id string, overall_score int")
    row = P.project_statistics(projects, none, none, opts, none).first()
    assert row.total_optimizations == 150 and row.total_pages == 0
    assert P.dashboard_projects(projects, none, none, opts, none).first().total_optimizations == 150


def test_lookup_drops_rows_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW", 10)
    word = F.when(F.col("id") % 4 != 0, F.concat(F.lit("u"), (F.col("id") % 3).cast("string")))
    table = spark.range(20_000).select((F.col("id") % 5000).alias("a"), word.alias("b"), F.col("id").alias("rest"))
    keys = table.filter("a % 50 = 7").select("b", "a").unionByName(spark.createDataFrame([(None, None), ("u1", 10**9)], "b string, a bigint"))
    want = sorted(map(tuple, table.filter("a % 50 = 7 AND b IS NOT NULL").select("a", "b", "rest").collect()))
    assert want and sorted(map(tuple, P.lookup(keys, table, ["a", "b"]).select("a", "b", "rest").collect())) == want
    left = P.marked(table, keys.distinct(), ["a", "b"])
    assert left.columns == table.columns and len(want) <= left.filter("b IS NOT NULL").count() <= len(want) + 20
    plan = P.lookup(keys, table, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftSemi" in line]
    assert len(joins) == 2 and "__marks" in joins[1] and "__marks" not in joins[0]  # the marks lie below the join with the keys
    # keys of another type are only joined
    assert P.lookup(keys.withColumn("a", F.col("a").cast("decimal(20,0)")), table, ["a", "b"]).count() == len(want)


def test_dots_fold_like_urljoin(spark):
    base = "http://h.example/a/b/c?q"
    hrefs = ["../x", "../../../../y", "./.", "a/./b/../../c/", "/../p/..", "..", ".", "x/..", "/a/b/../../..", "g;p?y#s", "a/" * 30 + "../" * 17 + "z", "./" * 40 + "e"]
    df = spark.createDataFrame([(h, base) for h in hrefs], "href string, url string")
    for r in df.select("href", U.resolve(U.base_parts(F.col("url")), F.col("href")).alias("full")).collect():
        assert r.full == urljoin(base, r.href), r.href


def test_a_million_segments(spark):
    df = spark.sql("SELECT 'http://h/x/y' AS url, concat(repeat('a/', 700000), repeat('../', 300000), 'end') AS href")
    start = time.time()
    full = df.select(U.resolve(U.base_parts(F.col("url")), F.col("href")).alias("full")).first().full
    assert full == "http://h/x/" + "a/" * 400000 + "end"
    assert time.time() - start < 60


def test_path_without_parameters(spark):
    urls = ["http://h/a/b;p?q", "http://h/a;x/b", "http://h/a;x/b;y;z#f", "http://h", "http://h/;"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(U.url_path(F.col("u"))).collect()
    assert [r[0] for r in got] == [urlparse(u).path for u in urls]


def test_fractions_of_a_second_stay(spark):
    stamps = [dt.datetime(2025, 1, 2, 3, 4, 5, us) for us in (0, 123456, 500000)]
    got = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz").select(iso("t")).collect()
    assert [r[0] for r in got] == [t.isoformat() for t in stamps]


def test_numbers_of_windows_1252(spark):
    got = spark.createDataFrame([("a&#150;b&#x80;&#129;&#8364;&#65;",)], "t string").select(_decode(F.col("t"), False)).first()[0]
    assert got == "a–b€\x81€A"


def test_previous_value_keeps_every_row(spark):
    rows = [("a", dt.datetime(2025, 1, 1), 1, 10), ("a", dt.datetime(2025, 1, 3), 2, 20), ("a", None, 3, 5), (None, dt.datetime(2025, 1, 1), 4, 7)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v int")
    got = {r.id: r.previous for r in previous_value(df, "k", "ts", "id", "v").collect()}
    assert got == {1: 5, 2: 10, 3: None, 4: None}


def test_quantile_is_exact(spark):
    rows = [(dt.datetime(2025, 1, 1, 0, i % 11), float((i * 7919) % 1000) / 7 - 20) for i in range(999)] + [(dt.datetime(2025, 1, 1, 0, 3), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, latency double")
    start = F.window("ts", "5 minutes")["start"]
    for q in (0.0, 0.5, 0.95, 1.0):
        want = df.groupBy(start.alias("w")).agg(F.round(F.percentile("latency", F.lit(q)), 6).alias("p"), F.count(F.lit(1)).alias("n"))
        got = latency_quantile(df, q).select("window_start", "p95", "requests")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_failed_fetches_have_no_scores(spark):
    rows = [(1, "http://a/", "<h1>x</h1>"), (2, "http://b/", None), (3, "http://c/", ""), (4, "ftp://d/", "<p>y</p>"), (5, None, "z")]
    fetched = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    good, bad = E.quarantine(fetched)
    assert {r.page_id: r.state for r in bad.collect()} == {2: "fetch_failed", 4: "bad_scheme", 5: "bad_scheme"}
    scores = {r.page_id for r in S.performance_score(E.parse_pages(good)).collect()}
    assert scores == {1, 3}


def test_metadata_document(spark):
    html = (
        "<title>T</title><script type='application/ld+json'>{\"@type\": \"A\", \"n\": [1]}</script><script>fbq('init', '123456789012');</script>"
        "<a href='/x' rel='nofollow  noopener'>one</a><a href='http://o/'>two</a><p style='a'> word word other</p>"
    )
    rows = [(1, "http://h/", html, dt.datetime(2025, 1, 1, 2, 3, 4, 5))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, scraped_at timestamp_ntz")
    doc = json.loads(prepared(E.parse_pages(pages)).select(bundle_metadata(F.lit("s3://b/p"))).first()[0])
    seo = doc["seo_metadata"]
    assert doc["scraped_at"] == "2025-01-01T02:03:04.000005"
    assert seo["structured_data"] == [{"@type": "A", "n": [1]}]
    assert [x["rel"] for x in seo["internal_links"] + seo["external_links"]] == [["nofollow", "noopener"], []]
    assert list(seo["keyword_density"].items())[0] == ("word", 2)
    assert seo["page_speed_indicators"]["inline_styles"] == 1
    tools = seo["detailed_analytics"]
    assert tools["facebook_pixel"][0]["pixel_id"] == "123456789012" and tools["hotjar"] == []
    assert tools["analytics_summary"]["has_facebook_pixel"] and tools["analytics_summary"]["tracking_intensity"] == "Light"


def test_page_plans_do_not_move_the_text(spark, sf):
    from pageprism.plans.catalog import all_queries

    spark.conf.unset("pageprism.parse.partitions")
    plan = all_queries()["page_title"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_nested_structured_data(spark):
    docs = [
        {"@graph": [{"@type": "A", "list": [1, 2.5, None, True]}, {"n": {"deep": [[], {}, "x/y"]}}], "a/b~c": "text", "none": None},
        ["only", {"k": "v"}],
        "plain",
    ]

    def walk(v, path=""):
        if isinstance(v, dict | list) and v:
            items = v.items() if isinstance(v, dict) else enumerate(v)
            return [x for k, w in items for x in walk(w, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")]
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
        return [(path, kind, None if v in ({}, [], None) else str(v).lower() if isinstance(v, bool) else str(v))]

    script = "".join(f'<script type="application/ld+json">{json.dumps(d)}</script>' for d in docs) + '<script type="application/ld+json">{broken</script>'
    page = spark.createDataFrame([(1, "http://h/", f"<html>{script}</html>")], "page_id bigint, url string, html string")
    got = sorted((r.block, r.path, r.type, r.value or "") for r in E.structured_values(E.parse_pages(page, "scripts")).collect())
    assert got == sorted((i, p, k, v or "") for i, d in enumerate(docs, 1) for p, k, v in walk(d))
