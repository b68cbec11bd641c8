"""Rate limits with a burst allowance: what a leaky bucket does with each request.

A client's bucket leaks ``rate`` requests a second. A request adds one; what is
above zero then is its excess. A request without excess is allowed, one whose
excess is within ``burst`` is delayed (it takes room of the burst), any other is
rejected and leaves the bucket as it is. Levels are thousandths of a request,
times are milliseconds, so all of it is whole numbers.

One request after the other would make a busy client one task. So a client's
requests are cut into blocks of time. A block is folded to a table: for each level
that the bucket can have before its first request, the level behind its last one;
all levels are carried through the block together. Only a block whose first
request comes so early that it can still feel the block before needs more than one entry. The
tables of a client are applied one after the other (a row a block, as a
stream), and then every block is replayed by itself from the level it begins with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize

_ONE = 1000  # a request, in thousandths


class Bucket:
    """The leaky bucket. A level lies between minus one request (empty for long) and the burst."""

    def __init__(self, rate: int, burst: int):
        self.rate, self.full = rate, burst * _ONE
        #: Milliseconds after which any bucket is empty.
        self.memory = -(-(self.full + _ONE) // rate)

    def fold(self, times: np.ndarray) -> np.ndarray:
        """Level behind the last request for each level before the first: -1000, -999, ... up to the burst."""
        level = np.arange(-_ONE, self.full + 1, dtype=np.int64)
        gaps = np.diff(times, append=times[-1])
        for i, gap in enumerate(gaps.tolist()):
            more = level + _ONE
            level = np.where(more > self.full, level, more)
            if gap >= self.memory:  # whatever it was: empty
                return np.full(len(level), self.last(times[i + 1 :], -_ONE))
            level = np.maximum(level - self.rate * gap, -_ONE)
        return level

    def last(self, times: np.ndarray, level: int) -> int:
        return self.replay(times, level)[1]

    def replay(self, times: np.ndarray, level: int) -> tuple[list[int], int]:
        """Excess of each request (above the burst: rejected), and the level behind the last one."""
        out, before = [], int(times[0])
        for t in times.tolist():
            level = max(level - self.rate * (t - before), -_ONE)
            before = t
            out.append(level + _ONE)
            if level + _ONE <= self.full:
                level += _ONE
        return out, level


def burst_limit(requests: DataFrame, rate: int, burst: int, block: str = "1 hour") -> DataFrame:
    """``event_id``, ``client``, ``ts``, ``excess`` (thousandths) and ``decision`` (allowed, delayed, rejected) of every request.

    Requests (``event_id``, ``client``, ``ts``) of a client go in order of time (whole milliseconds), then id. A client's
    first request finds an empty bucket. Rows without a client are one client; rows without a time have no decision. The
    result does not depend on ``block``.
    """
    bucket = Bucket(rate, burst)
    ms = F.expr("unix_millis(CAST(ts AS TIMESTAMP))")
    width = int(requests.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {block}) AS w").first().w)
    named = requests.select("event_id", F.col("client").cast("string").alias("client"), "ts", ms.alias("ms"))
    rows = materialize(named.withColumn("block", F.floor(F.col("ms") / width)), "requests")
    timed = rows.filter("ms IS NOT NULL")

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(frame["ms"].to_numpy(np.int64))
        early = times[0] < key[1] * width + bucket.memory
        table = bucket.fold(times) if early else np.array([bucket.last(times, -_ONE)])
        return pd.DataFrame({"client": [key[0]], "block": [key[1]], "first": [times[0]], "last": [times[-1]], "levels": [table.tolist()]})

    schema = "client string, block bigint, first bigint, last bigint, levels array<bigint>"
    folded = materialize(timed.groupBy("client", "block").applyInPandas(fold, schema), "folded")

    def chain(batches):
        client, level, last, started = None, -_ONE, 0, False
        for frame in batches:
            begins = []
            for own, first, end, levels in zip(frame["client"], frame["first"], frame["last"], frame["levels"], strict=True):
                if not started or own != client:
                    client, started, begin = own, True, -_ONE
                else:
                    begin = max(level - bucket.rate * (first - last), -_ONE)
                level, last = int(levels[begin + _ONE if len(levels) > 1 else 0]), end
                begins.append(begin)
            yield pd.DataFrame({"client": frame["client"], "block": frame["block"], "begin": begins})

    ordered = folded.repartition("client").sortWithinPartitions("client", "block")
    begins = materialize(ordered.mapInPandas(chain, "client string, block bigint, begin bigint"), "begins")
    both = timed.alias("r").join(
        begins.alias("b"), F.col("r.client").eqNullSafe(F.col("b.client")) & (F.col("r.block") == F.col("b.block"))
    ).select("r.*", "b.begin")

    def replay(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ms", "event_id"])
        frame["excess"] = bucket.replay(frame["ms"].to_numpy(np.int64), int(frame["begin"].iloc[0]))[0]
        return frame[["event_id", "client", "ts", "excess"]]

    out = both.groupBy("client", "block").applyInPandas(replay, rows.select("event_id", "client", "ts").schema.add("excess", "long"))
    out = out.unionByName(rows.filter("ms IS NULL").select("event_id", "client", "ts", F.lit(None).cast("bigint").alias("excess")))
    decision = F.when(F.col("excess") > bucket.full, "rejected").when(F.col("excess") > 0, "delayed").when(F.col("excess").isNotNull(), "allowed")
    return out.withColumn("decision", decision)
