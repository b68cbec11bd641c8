"""Traffic measures over time windows of a request table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: fields of an access-log line, in the order of the log format.
LOG_PATTERN = (
    r'^(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+) "([^"]*)" "([^"]*)" "([^"]*)"$'
)
LOG_FIELDS = [
    "remote_addr", "remote_user", "time_local", "request", "status", "body_bytes_sent",
    "http_referer", "http_user_agent", "http_x_forwarded_for",
]


def request_rate(requests: DataFrame, by: tuple[str, ...] = ("method", "endpoint"), width: int = 5) -> DataFrame:
    """Requests per second over the ``width`` minutes before each full minute.

    Minutes are counted first; only their counts enter the overlapping windows.
    """
    per_minute = requests.groupBy(*by, F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(
        F.count(F.lit(1)).alias("c")
    )
    starts = F.explode(
        F.array(*[F.col("minute") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(i)) for i in range(width)])
    )
    return (
        per_minute.select(*by, "c", starts.alias("window_start"))
        .groupBy(*by, "window_start")
        .agg(F.sum("c").alias("requests"))
        .withColumn("rate", F.col("requests") / F.lit(width * 60))
    )


def latency_quantile(requests: DataFrame, q: float = 0.95) -> DataFrame:
    """Interpolated quantile per five-minute window, exact and without one big group.

    Equal values are counted first. The counts of about two thousand value
    ranges tell in which ranges the two ranks around the quantile lie; only
    values of these ranges are ordered.
    """
    start = F.window("ts", "5 minutes")["start"]
    value = F.col("latency")
    span = F.floor(F.signum(value) * F.log1p(F.abs(value) * 1000) * 64)
    counted = requests.groupBy(start.alias("window_start"), "latency").agg(F.count(F.lit(1)).alias("c")).withColumn("span", span)
    ranges = counted.groupBy("window_start", "span").agg(F.sum("c").alias("in_span"), F.sum(F.when(value.isNotNull(), F.col("c")).otherwise(0)).alias("n"))
    whole = Window.partitionBy("window_start")
    place = F.lit(q) * (F.col("total") - 1)
    holds = lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto"))
    low, high = F.floor(place), F.ceil(place)
    ranges = ranges.select(
        "window_start", "span", "n", F.sum("n").over(whole.orderBy("span")).alias("upto"),
        F.sum("n").over(whole).alias("total"), F.sum("in_span").over(whole).alias("requests"),
    )
    # a window without any value is kept, too
    chosen = ranges.filter((holds(low) | holds(high)) & (F.col("n") > 0) | (F.col("total") == 0))
    chosen = chosen.withColumnsRenamed({"upto": "upto_span", "n": "n_span"})
    inside = Window.partitionBy("window_start", "span").orderBy("latency")
    values = chosen.join(counted, ["window_start", "span"], "left").withColumns(
        {"n": F.col("c"), "upto": F.col("upto_span") - F.col("n_span") + F.sum("c").over(inside)}
    )
    at = lambda r: F.max(F.when(holds(r), value))
    share = F.max(place - low)
    found = values.groupBy("window_start").agg(
        F.round(at(low) * (1 - share) + at(high) * share, 6).alias("p95"), F.max("requests").alias("requests")
    )
    return found.select("window_start", "p95", "requests")


def latest_gauge(requests: DataFrame) -> DataFrame:
    newest = F.max_by("latency", F.struct("ts", "event_id"))
    return requests.groupBy("method").agg(newest.alias("value"), (newest / F.lit(1048576)).alias("value_mb"))


def over_limit(requests: DataFrame, unit: str, limit: int) -> DataFrame:
    """Clients with more than ``limit`` requests in a second, hour or day."""
    return (
        requests.groupBy("client", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("window_start"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > limit)
    )


def parse_access_log(lines: DataFrame, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Log lines to fields, behind the columns ``keep``; ``ok`` is false for lines of another form."""
    fields = [F.nullif(F.regexp_extract("line", LOG_PATTERN, i + 1), F.lit("")).alias(f) for i, f in enumerate(LOG_FIELDS)]
    return lines.select(*keep, F.col("line").rlike(LOG_PATTERN).alias("ok"), *fields).withColumns(
        {c: F.col(c).cast("bigint") for c in ("status", "body_bytes_sent")}
    )


def log_slices(requests: DataFrame, as_of: Column) -> DataFrame:
    ago = lambda hours: as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    past = F.col("ts") <= as_of
    return requests.agg(
        F.count_if(past & (F.col("ts") > ago(24))).alias("last_24h"),
        F.count_if(past & (F.col("ts") > ago(1))).alias("last_1h"),
        F.count_if(past & (F.to_date("ts") == F.to_date(as_of))).alias("today"),
        F.count_if(past).alias("all_lines"),
    )
