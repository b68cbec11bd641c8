"""Streaming forms of the keyed aggregates and of the request windows.

Event time is ``ts``; the watermark is ten minutes. Running aggregates are
merged into keyed tables on storage, so reading one is reading a snapshot, and a
batch that is repeated after a failure changes nothing. Rows that come too late
for a window are set aside as rows before the windows are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import site_key
from ..sources.fixtures import VIEWS
from ..sources.readers import read_table
from ..sources.sinks import materialize, work_dir
from ..sources.stored import StoredTable

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over streams of the given tables, each a file or a folder of files."""

    def fill(m: re.Match) -> str:
        if m[1] == "ts":
            return "TIMESTAMP_NTZ "
        schema = read_table(spark, sf_dir, m[1]).schema
        # a stream takes a single file only as the match of a pattern, and the files of a folder, too
        source = spark.readStream.schema(schema).parquet(f"{sf_dir}/{m[1]}.parque[t]")
        source.createOrReplaceTempView(f"stream_of_{m[1]}")
        return f"stream_of_{m[1]}"

    return spark.sql(re.sub(r"\$(\w+)\$", fill, VIEWS[name]))


def drain(writer, checkpoint: str) -> None:
    """Run a stream until its source is empty."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# ---- running aggregates in keyed tables -------------------------------------------------------------------------------
SITES = "site_key string, first_scraped timestamp_ntz, last_scraped timestamp_ntz, total_scrapes bigint"
HEALTH = "project_id string, health_id string, ts timestamp_ntz, overall_score bigint"


def site_upsert(scrapes: DataFrame) -> DataFrame:
    return scrapes.groupBy(site_key(F.col("url")).alias("site_key")).agg(
        F.min("scraped_at").alias("first_scraped"),
        F.max("scraped_at").alias("last_scraped"),
        F.count(F.lit(1)).alias("total_scrapes"),
    )


def latest_health(health: DataFrame) -> DataFrame:
    last = F.max_by(
        F.struct("health_id", "ts", F.col("overall_score").cast("bigint").alias("overall_score")), F.struct("ts", "health_id")
    )
    return health.groupBy("project_id").agg(last.alias("x")).select("project_id", "x.*")


def run_upserts(stream: DataFrame, table: StoredTable, checkpoint: str) -> None:
    """Drain a running aggregate into a keyed table: each micro-batch sets the rows of the keys it changed."""
    drain(stream.writeStream.outputMode("update").foreachBatch(lambda batch, _: table.upsert(batch)), checkpoint)


# ---- the newest rows per key as state ------------------------------------------------------------------------------------
#: Shards that the projects of a stream are dealt to; a stream goes on with the number it began with.
SHARDS = 4096
_KEPT = pa.schema(
    [("project_id", pa.string()), ("health_id", pa.string()), ("ts", pa.timestamp("us")), ("overall_score", pa.int64()), ("changed_at", pa.int64())]
)


class NewestRows(StatefulProcessor):
    """Keeps the newest ``k`` rows of each project of a shard; a project whose rows have not changed for ``ttl_ms`` is forgotten.

    A shard's rows are one value, an Arrow table, so what a call of the state costs is paid per shard and not per project.
    A batch's rows are read in chunks, of which only the newest ``k`` of a project are held. Rows that are sent twice count once.
    """

    def __init__(self, k: int, ttl_ms: int):
        self.k, self.ttl_ms = k, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("newest", "rows binary", self.ttl_ms)

    def _held(self) -> pd.DataFrame:
        value = self.rows.get() if self.rows.exists() else None
        table = pa.ipc.open_stream(bytes(value[0])).read_all() if value else _KEPT.empty_table()
        return table.to_pandas().astype({"overall_score": "Int64"})

    def _newest(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["project_id", "ts", "health_id"])
        rows = rows.sort_values(["project_id", "ts", "health_id"], ascending=[True, False, True], ignore_index=True)
        return rows[rows.groupby("project_id", dropna=False, sort=False).cumcount() < self.k]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._held()
        best = held[held["changed_at"] > now - self.ttl_ms].assign(new=False)
        lost = len(best) < len(held)
        for chunk in rows:
            chunk = chunk[_KEPT.names[:4]].astype({"ts": "datetime64[us]", "overall_score": "Int64"}).assign(changed_at=now, new=True)
            best = self._newest(pd.concat([best, chunk], ignore_index=True) if len(best) else chunk)
        projects = best.groupby("project_id", dropna=False, sort=False)
        # a row goes only for a new one, so a project has changed if it has a new row
        changed = projects["new"].transform("any")
        if lost or changed.any():
            table = pa.Table.from_pandas(best.assign(changed_at=best["changed_at"].mask(changed, now)), _KEPT, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _KEPT) as writer:
                writer.write_table(table)
            self.rows.update((sink.getvalue().to_pybytes(),))
        if changed.any():
            best = best.assign(rank=projects.cumcount() + 1)[changed]
            yield best[["project_id", "health_id", "ts", "overall_score", "rank"]]

    def close(self) -> None:
        pass


HISTORY = "project_id string, health_id string, ts timestamp_ntz, overall_score bigint, rank bigint"


def health_history(stream: DataFrame, k: int = 30, ttl_days: int = 90) -> DataFrame:
    """The newest ``k`` rows of each project that a batch changed. State is at most ``k`` rows a project; a project without any
    new row for ``ttl_days`` of processing time is forgotten by the state (not by the table it was written to)."""
    shard = F.pmod(F.xxhash64("project_id"), F.lit(SHARDS)).alias("shard")
    rows = stream.select(shard, "project_id", "health_id", "ts", F.col("overall_score").cast("bigint").alias("overall_score"))
    return rows.groupBy("shard").transformWithStateInPandas(
        NewestRows(k, ttl_days * 86_400_000), outputStructType=HISTORY, outputMode="Update", timeMode="ProcessingTime"
    )


def run_history(stream: DataFrame, table: StoredTable, checkpoint: str) -> None:
    """Drain a stream of health rows into a table with the newest rows of each project, keyed by project and rank."""
    conf = stream.sparkSession.conf
    # state of this kind needs RocksDB; without new rows there is nothing to do, though processing time goes on
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: conf.get(name) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        # a list only grows until it is full, so a rank once written is written again by every later change
        drain(health_history(stream).writeStream.outputMode("update").foreachBatch(lambda batch, _: table.upsert(batch)), checkpoint)
    finally:
        for name, value in before.items():
            conf.set(name, value)


# ---- windows, and what comes too late for them ---------------------------------------------------------------------------
class LateRouter:
    """Splits a stream by a watermark of its own, which it writes down after every batch.

    A batch's rows are held against the watermark that the batches before it have left: the highest event time less
    ``delay``. Rows at or above it go to ``ontime``, the others, and rows without a time, to ``late``; each batch has its folder
    in both. What a batch wrote depends on the batch and the watermark alone, so a batch that is run again after a
    failure writes the same, and one that had finished writes nothing.
    """

    def __init__(self, spark: SparkSession, out: str, delay: str = WATERMARK):
        self.spark, self.out, self.delay = spark, out.rstrip("/"), delay

    def _done(self, batch: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/marks/batch={batch}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _mark(self, batch: int):
        return self.spark.read.schema("mark timestamp_ntz").parquet(f"{self.out}/marks/batch={batch}").first().mark if self._done(batch) else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self._done(number):
            return
        mark = self._mark(number - 1)
        rows = materialize(batch, "arrivals")  # read three times
        time = F.col("ts").cast("timestamp_ntz")
        ontime = time.isNotNull() if mark is None else F.coalesce(time >= F.lit(mark), F.lit(False))
        rows.filter(ontime).write.mode("overwrite").parquet(f"{self.out}/ontime/batch={number}")
        rows.filter(~ontime).write.mode("overwrite").parquet(f"{self.out}/late/batch={number}")
        top = rows.agg((F.max(time) - F.expr(f"INTERVAL {self.delay}")).alias("mark"))
        top.select(F.greatest("mark", F.lit(mark).cast("timestamp_ntz")).alias("mark")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.out}/marks/batch={number}"
        )

    def run(self, stream: DataFrame) -> None:
        """Drain a stream (columns ``ts``, ``event_id`` and others)."""
        self.schema = stream.schema
        drain(stream.writeStream.foreachBatch(self), f"{self.out}/routing")

    def ontime(self, schema) -> DataFrame:
        """The rows on time as a stream again. Its own watermark never passes the router's, so nothing is dropped behind it."""
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.out}/ontime")

    def late(self, schema) -> DataFrame:
        """Late rows, each event once, without those whose event was on time before."""
        read = lambda name: self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.out}/{name}")
        return read("late").dropDuplicates(["event_id"]).join(read("ontime").select("event_id"), "event_id", "left_anti")


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests per method and five minutes, repeated events counted once."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)
    return (
        timed.dropDuplicatesWithinWatermark(["event_id"])
        .groupBy("method", F.window("ts", "5 minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("method", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests")
    )


def run_append(stream: DataFrame, out: str) -> LateRouter:
    """Drain a stream of requests: late rows are set aside, the windows that the watermark has closed are appended to ``rows``."""
    router = LateRouter(stream.sparkSession, out)
    router.run(stream)
    counts = request_counts(router.ontime(stream.schema))
    drain(counts.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"), f"{out}/state")
    return router


# ---- queries ---------------------------------------------------------------------------------------------------------------
def stream_site_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "site-upsert")
    table = StoredTable(spark, f"{out}/sites", "site_key", SITES, buckets=8)
    run_upserts(site_upsert(stream_view(spark, sf_dir, "scrape_log")), table, f"{out}/state")
    return table.read()


def stream_latest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "latest-health")
    table = StoredTable(spark, f"{out}/health", "project_id", HEALTH, buckets=8)
    run_upserts(latest_health(stream_view(spark, sf_dir, "site_health")), table, f"{out}/state")
    return table.read()


def stream_health_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "health-history")
    table = StoredTable(spark, f"{out}/history", ["project_id", "rank"], HISTORY, buckets=8)
    run_history(stream_view(spark, sf_dir, "site_health"), table, f"{out}/state")
    return table.read()


def stream_request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    out = work_dir(spark, "request-counts")
    run_append(stream_view(spark, sf_dir, "requests"), out)
    return spark.read.parquet(f"{out}/rows")


#: Batches in which the requests arrive for the query on late ones.
ARRIVALS = 4


def arrivals(requests: DataFrame) -> DataFrame:
    """Requests with the batch they arrive in: by time, but every eleventh event comes in the last batch, and every seventh twice."""
    span = F.ntile(ARRIVALS - 1).over(Window.orderBy("day")).alias("span")
    days = requests.select(F.to_date("ts").alias("day")).distinct().select("day", span)
    placed = requests.withColumn("day", F.to_date("ts")).join(days, "day")
    last = F.lit(ARRIVALS)
    when = F.when(F.col("event_id") % 11 == 0, F.array(last)).when(F.col("event_id") % 7 == 0, F.array(F.col("span"), last))
    return placed.withColumn("arrival", F.explode(when.otherwise(F.array("span")))).drop("day", "span")


def stream_late_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that came too late for their window; the stream is stopped and goes on after every batch."""
    from ..sources.fixtures import view

    out = work_dir(spark, "late-requests")
    rows = materialize(arrivals(view(spark, sf_dir, "requests")), "arrivals")
    schema = rows.drop("arrival").schema
    for n in range(1, ARRIVALS + 1):
        rows.filter(F.col("arrival") == n).drop("arrival").write.mode("append").parquet(f"{out}/in")
        router = run_append(spark.readStream.schema(schema).parquet(f"{out}/in"), out)
    return router.late(schema).select("event_id", "ts", "method", "client", "endpoint")
