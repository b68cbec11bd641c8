"""Keyed tables changed bucket by bucket, and the streams that write them."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageprism.operators import platform as P
from pageprism.plans import storage
from pageprism.plans.catalog import all_queries
from pageprism.sources.stored import StoredTable
from pageprism.streaming import incremental as I

T0 = dt.datetime(2024, 1, 1)
ROWS = "id bigint, name string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def files(path):
    """Data files by bucket."""
    return {b: sorted(f for f in os.listdir(f"{path}/rows/{b}") if f.endswith(".parquet")) for b in os.listdir(f"{path}/rows") if b.startswith("bucket=")}


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    table = StoredTable(spark, path, "id", ROWS, buckets=8)
    assert rows(table) == []
    table.upsert(spark.createDataFrame([(i, f"n{i}") for i in range(200)], ROWS))
    before = files(path)
    assert len(before) == 8 and all(len(f) == 1 for f in before.values())
    table.upsert(spark.createDataFrame([(3, "new"), (1000, "more")], ROWS))
    after = files(path)
    touched = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(touched) <= 2 and all(len(f) == 1 for f in after.values())
    assert rows(table) == sorted([(i, "new" if i == 3 else f"n{i}") for i in range(200)] + [(1000, "more")])
    table.upsert(spark.createDataFrame([(3, "new"), (1000, "more")], ROWS))  # again: the same
    assert len(rows(table)) == 201
    with pytest.raises(ValueError):
        StoredTable(spark, path, "id", ROWS, buckets=4)


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), "id", ROWS, buckets=4)
    table.upsert(spark.createDataFrame([(i, "x") for i in range(50)], ROWS))
    before = files(table.path), rows(table)
    broken = table.read().withColumn("name", F.when(F.col("id") == 30, F.raise_error(F.lit("lost"))).otherwise(F.lit("y")))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    with pytest.raises(Exception, match="lost"):
        table._replace(broken.withColumn("bucket", table.bucket()), list(range(4)))
    assert (files(table.path), rows(table)) == before


def test_delete(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), "id", ROWS, buckets=4)
    table.upsert(spark.createDataFrame([(i, f"n{i % 2}") for i in range(40)] + [(None, "none")], ROWS))
    before = files(table.path)
    table.delete(F.col("id") == 7)
    assert sum(files(table.path)[b] != before[b] for b in before) == 1
    table.delete(keys=spark.createDataFrame([(8,), (9,), (5000,)], "id bigint"))
    assert len(rows_without_null(table)) == 37 and table.read().count() == 38
    table.delete(F.lit(True))  # buckets that become empty go, too
    assert rows(table) == [] and files(table.path) == {}
    table.upsert(spark.createDataFrame([(1, "back")], ROWS))
    assert rows(table) == [(1, "back")]


def rows_without_null(table):
    return [r for r in table.read().collect() if r.id is not None]


def test_merge_of_changes_on_a_stored_table(spark, tmp_path):
    schema = "id string, name string, role string"
    table = StoredTable(spark, str(tmp_path / "t"), "id", schema, buckets=4)
    table.upsert(spark.createDataFrame([(f"u{i}", "n", "r") for i in range(30)], schema))
    changes = spark.createDataFrame(
        [("u1", at(1), "first", "admin"), ("u1", at(2), "second", None), ("x", at(3), "none", None)],
        "id string, changed_at timestamp_ntz, new_name string, new_role string",
    )
    table.update(changes, lambda old, new: P.merge(old, new, "id", {"name": "new_name", "role": "new_role"}, "changed_at"))
    got = {r.id: (r.name, r.role) for r in table.read().collect()}
    assert got == {f"u{i}": ("second", "admin") if i == 1 else ("n", "r") for i in range(30)}


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch_and_reads_one_snapshot(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(f"https://www.s{i % 5}.org/p", at(i * 7 % 300)) for i in range(200)], "url string, scraped_at timestamp_ntz")
    df.repartition(5).write.parquet(src)
    table = StoredTable(spark, f"{out}/t", "site_key", I.SITES, buckets=2)
    I.run_upserts(I.site_upsert(_stream(spark, src, df.schema)), table, f"{out}/state")
    want = sorted(map(tuple, I.site_upsert(df).collect()))
    assert rows(table) == want
    assert sum(map(len, files(table.path).values())) <= 2  # whatever the number of batches
    table.upsert(I.site_upsert(df))  # a batch that is repeated
    assert rows(table) == want


def test_streams_of_tables_in_one_file_and_in_folders(spark, sf, tmp_path):
    """A table of several files is read whole, and a file or folder with a like name is not read."""
    for name in ("pages", "lineitem", "events"):
        whole = spark.read.parquet(f"{sf}/{name}.parquet")
        whole.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        whole.limit(5).write.parquet(str(tmp_path / f"more_{name}.parquet"))
    for query in ("stream_site_upsert", "stream_latest_health", "stream_request_counts"):
        one, many = (all_queries()[query](spark, folder) for folder in (sf, str(tmp_path)))
        want = sorted(map(str, one.collect()))
        assert want and sorted(map(str, many.collect())) == want


def test_history_over_many_batches_and_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    r = random.Random(2)
    health = [(f"p{min(r.randint(0, 5), 2)}", f"h{i}", at(r.randint(0, 50)), i) for i in range(240)]  # one project has most rows
    table = StoredTable(spark, f"{out}/t", ["project_id", "rank"], I.HISTORY, buckets=2)
    schema = "project_id string, health_id string, ts timestamp_ntz, overall_score bigint"
    for n in range(3):
        part = spark.createDataFrame(health[n * 80 : n * 80 + 80], schema)
        part.coalesce(1).write.mode("append").parquet(src)
        I.run_history(_stream(spark, src, part.schema), table, f"{out}/state")
    batch = P.newest_k(spark.createDataFrame(health, schema), ["project_id"], [F.desc("ts"), F.asc("health_id")], 30)
    assert rows(table) == sorted(map(tuple, batch.select(*table.columns).collect()))
    state = spark.read.format("statestore").option("stateVarName", "newest").load(f"{out}/state")
    assert state.groupBy("key").count().agg(F.max("count")).first()[0] <= 30


def test_projects_of_a_shard_share_a_state(spark, tmp_path, monkeypatch):
    """State calls are paid per shard, so their number does not grow with the projects; null projects, scores and times are kept."""
    monkeypatch.setattr(I, "SHARDS", 3)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    r = random.Random(3)
    health = [(None if i % 50 == 0 else f"p{i % 50}", f"h{i}", None if i % 29 == 0 else at(r.randint(0, 400)), None if i % 31 == 0 else i) for i in range(3000)]
    table = StoredTable(spark, f"{out}/t", ["project_id", "rank"], I.HISTORY, buckets=2)
    schema = "project_id string, health_id string, ts timestamp_ntz, overall_score bigint"
    for n in range(2):
        spark.createDataFrame(health[n * 1500 : n * 1500 + 1500], schema).coalesce(1).write.mode("append").parquet(src)
        I.run_history(_stream(spark, src, spark.createDataFrame([], schema).schema), table, f"{out}/state")
    batch = P.newest_k(spark.createDataFrame(health, schema), ["project_id"], [F.desc("ts"), F.asc("health_id")], 30)
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(table.read().collect()) == key(batch.select(*table.columns).collect())
    assert spark.read.format("statestore").option("stateVarName", "newest").load(f"{out}/state").count() <= 3


def test_projects_of_a_shard_are_forgotten_one_by_one():
    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    def batch(now, *projects):
        rows = pd.DataFrame([(0, p, f"h{i}", at(i), i) for p, i in projects], columns=["shard", "project_id", "health_id", "ts", "overall_score"])
        time = type("Time", (), {"getCurrentProcessingTimeInMs": lambda self: now})()
        return [(x.project_id, x.health_id, x.rank) for out in newest.handleInputRows((0,), iter([rows]), time) for x in out.itertuples()]

    newest = I.NewestRows(2, 100)
    newest.rows = State()
    assert batch(1000, ("a", 1), ("b", 1)) == [("a", "h1", 1), ("b", "h1", 1)]
    assert batch(1050, ("a", 2), ("b", 1)) == [("a", "h2", 1), ("a", "h1", 2)]  # b's row was sent again
    assert batch(1120, ("a", 3)) == [("a", "h3", 1), ("a", "h2", 2)]
    assert set(newest._held().project_id) == {"a"}  # nothing new of b for 100 ms
    assert batch(1130, ("a", 3), ("b", 0)) == [("b", "h0", 1)]


def test_more_log_lines_are_more_files(spark, sf, monkeypatch):
    monkeypatch.setattr(storage, "LINES_PER_FILE", 70)
    out = storage._followed_logs(spark, sf)
    parsed, malformed = (spark.read.parquet(f"{out}/{name}") for name in ("parsed", "malformed"))
    files = parsed.select("batch", "file").unionByName(malformed.select("batch", "file")).groupBy("batch", "file").count().collect()
    lines = spark.read.parquet(f"{sf}/events.parquet").count()
    assert sum(r["count"] for r in files) == lines and max(r["count"] for r in files) <= 70
    assert {r.batch for r in files} == {0, 1} and any(r.file.endswith(".gz") for r in files)


def test_late_rows_are_kept_over_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id bigint, ts timestamp_ntz, method string"
    batches = [
        [(1, at(0), "m"), (2, at(1), "m"), (2, at(1), "m")],
        [(3, at(60), "m")],
        # late by an hour; late and sent twice; on time; late, but counted before; without a time
        [(4, at(2), "m"), (7, at(3), "n"), (7, at(3), "n"), (5, at(61), "m"), (1, at(0), "m"), (9, None, "m")],
        [(6, at(120), "m")],
    ]
    for b in batches:  # one run per batch: the stream goes on from its checkpoint
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        router = I.run_append(_stream(spark, src, spark.createDataFrame([], schema).schema), out)
    got = sorted((r["window_start"], r["requests"]) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [(at(0), 2), (at(60), 2)]
    given = spark.createDataFrame([], schema).schema
    late = sorted(r.event_id for r in router.late(given).collect())
    assert late == [4, 7, 9]
    ontime = {r.event_id for r in spark.read.schema(given).option("recursiveFileLookup", True).parquet(f"{out}/ontime").collect()}
    assert sorted(ontime) + late == [1, 2, 3, 5, 6, 4, 7, 9]
    # a batch that had finished writes nothing when it is run again
    before = sorted(os.listdir(f"{out}/late/batch=2"))
    router(spark.createDataFrame([(99, at(0), "m")], schema), 2)
    assert sorted(os.listdir(f"{out}/late/batch=2")) == before
