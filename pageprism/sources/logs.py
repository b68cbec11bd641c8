"""Access logs as a source: rotated text files, lines of another form set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import parse_access_log
from .sinks import materialize

LINE = "value string"


def _parsed(lines: DataFrame) -> DataFrame:
    named = lines.select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    return parse_access_log(named, keep=("file", "line"))


def split_log(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with their fields, and (``file``, ``line``) of those of another form. Each line is in one of the two."""
    return parsed.filter("ok").drop("ok", "line"), parsed.filter("NOT ok").select("file", "line")


def read_logs(spark: SparkSession, path: str, files: str = "*") -> tuple[DataFrame, DataFrame]:
    """All lines of the log files below ``path`` whose name fits ``files`` (compressed ones, too)."""
    return split_log(_parsed(spark.read.schema(LINE).option("pathGlobFilter", files).text(path)))


def follow_logs(spark: SparkSession, path: str, out: str, files: str = "*.log.*") -> None:
    """Take the new files below ``path`` to the tables ``out/parsed`` and ``out/malformed``, each line once.

    A log that is still written to has another name than ``files``; rotation gives it one that stays. Files are remembered by
    the stream's checkpoint, and a batch that is run again writes over its own folders. Lines are matched once. A compressed file is one
    task, so rotation should bound its size.
    """

    def save(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("line", F.when(~F.col("ok"), F.col("line")))
        parsed, malformed = split_log(materialize(lines, "log-lines"))
        parsed.write.mode("overwrite").parquet(f"{out}/parsed/batch={number}")
        malformed.write.mode("overwrite").parquet(f"{out}/malformed/batch={number}")

    lines = spark.readStream.schema(LINE).option("pathGlobFilter", files).text(path)
    writer = _parsed(lines).writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
