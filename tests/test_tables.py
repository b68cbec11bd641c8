"""Keyed sets, time-ordered values, sources and sinks, streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from pageprism.operators import corpus as C
from pageprism.operators import platform as P
from pageprism.operators import windows as W
from pageprism.sources import readers, sinks

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_merge_keeps_earlier_changes_of_other_columns(spark):
    table = spark.createDataFrame([("a", "n", "r"), ("b", "n", "r")], "id string, name string, role string")
    changes = spark.createDataFrame(
        [("a", at(1), "first", "admin"), ("a", at(2), "second", None), ("x", at(3), "none", None)],
        "id string, changed_at timestamp_ntz, new_name string, new_role string",
    )
    got = P.merge(table, changes, "id", {"name": "new_name", "role": "new_role"}, "changed_at")
    assert sorted(map(tuple, got.collect())) == [("a", "second", "admin"), ("b", "n", "r")]


def test_newest_k_with_one_hot_key(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id"
    ).repartition(8)
    got = P.newest_k(df, ["key"], [F.desc("id")], 30)
    hot = [r["id"] for r in got.filter("key = 'hot'").orderBy("rank").collect()]
    assert hot == [i for i in range(19999, -1, -1) if i % 3 == 0][:30]
    # Every task keeps at most k rows per key before the shuffle.
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_previous_value_crosses_days(spark):
    rows = [("hot", at(i * 97), f"{i:04d}", i) for i in range(500)] + [("cold", at(5), "z", 7)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, tie string, v bigint").repartition(4)
    got = {(r["k"], r["v"]): r["previous"] for r in C.previous_value(df, "k", "ts", "tie", "v").collect()}
    assert got[("cold", 7)] is None and got[("hot", 0)] is None
    assert all(got[("hot", i)] == i - 1 for i in range(1, 500))


def test_over_limit_is_strict(spark):
    rows = [("a", at(0))] * 100 + [("b", at(0))] * 101
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz")
    assert [r["client"] for r in W.over_limit(df, "hour", 100).collect()] == ["b"]


def test_tracker_document(spark, tmp_path):
    stats = {f.name: i for i, f in enumerate(readers.SCRAPE_STATS)}
    scrape = {"url": "https://www.a.org/", "scraped_at": "2025-06-26T19:56:31.428080", "saved_directory": "d", "title": "A", "stats": stats}
    doc = {
        "metadata": {"version": "1.0"},
        "sites": {
            "a.org": {"domain": "a.org", "scrapes": [scrape, {**scrape, "user_email": "u@x"}], "optimizations": []},
            "b.org": {"domain": "b.org", "scrapes": [], "optimizations": [
                {"original_url": "https://b.org", "user_profile": "p", "optimized_at": "2025-06-27T00:00:00", "optimized_directory": "o"}]},
        },
    }
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(doc, indent=2))
    bad.write_text('{"sites": {')
    scrapes, opts = readers.read_tracker(spark, str(good))
    got = scrapes.orderBy("user_email").collect()
    assert [r["user_email"] for r in got] == [None, "u@x"]
    assert got[0]["scraped_at"] == dt.datetime(2025, 6, 26, 19, 56, 31, 428080)
    assert got[0]["external_scripts_count"] == 5
    assert [r["site_key"] for r in opts.collect()] == ["b.org"]
    assert readers.read_tracker(spark, str(bad))[0].count() == 0


def test_json_and_text_docs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n')
    (tmp_path / "b.json").write_text("{oops")
    docs = readers.read_json_docs(spark, str(tmp_path), "k int")
    assert sorted((r["key"][-6:], r["doc"]) for r in docs.select("key", "doc.k").toDF("key", "doc").collect()) == [("a.json", 1), ("b.json", None)]
    assert readers.list_objects(spark, str(tmp_path)).agg(F.sum("size")).first()[0] == 14


def test_csv_roundtrip_keeps_any_text(spark, tmp_path):
    texts = ['plain', 'a "quoted", b', "two\nlines", "", "back\\slash", "  spaced  ", "tab\t", '"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    path = str(tmp_path / "csv")
    sinks.write_csv(df, path)
    assert [r["t"] for r in sinks.read_csv(spark, path, "i int, t string").orderBy("i").collect()] == texts


def test_bundle_is_partitioned_by_artifact(spark, tmp_path):
    df = spark.createDataFrame([(1, "links.txt", "k1", "x"), (1, "styles.css", "k2", "y")], "page_id int, artifact string, key string, body string")
    path = str(tmp_path / "b")
    sinks.write_bundle(df, path)
    plan = spark.read.parquet(path).filter("artifact = 'links.txt'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(artifact" in plan

