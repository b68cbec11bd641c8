"""The leaky bucket over blocks against one request after the other."""

import datetime as dt
import random

import numpy as np

from pageprism.operators.burst import Bucket, burst_limit

T0 = dt.datetime(2024, 1, 1)


def one_by_one(requests, rate, burst):
    out, state = {}, {}
    for event, client, ts in sorted((r for r in requests if r[2] is not None), key=lambda r: (r[2], r[0])):
        ms = round((ts - T0).total_seconds() * 1000)
        if client not in state:
            excess = 0
        else:
            level, last = state[client]
            excess = max(level - rate * (ms - last) + 1000, 0)
        if excess <= burst * 1000:
            state[client] = (excess, ms)
            out[event] = "delayed" if excess else "allowed"
        else:
            out[event] = "rejected"
    return out


def requests(seed, n):
    """Clients that come seldom, in bursts and all the time; one has half of the requests; equal times and none."""
    r, rows, now = random.Random(seed), [], dict.fromkeys("abcd", 0)
    for i in range(n):
        c = r.choice("aaabcd")
        now[c] += r.choice([0, 0, 3, 40, 90, 100]) if c == "a" else r.choice([0, 50, 400, 5000])
        rows.append((i, c, T0 + dt.timedelta(milliseconds=now[c])))
    return [*rows, (n, None, T0), (n + 1, None, T0), (n + 2, "a", None)]


def test_blocks_of_any_length_agree(spark):
    rows = requests(1, 1500)
    df = spark.createDataFrame(rows, "event_id bigint, client string, ts timestamp_ntz").repartition(4)
    for rate, burst, block in ((10, 20, "1 hour"), (10, 20, "2 seconds"), (2, 5, "7 seconds")):
        want = one_by_one(rows, rate, burst)
        got = burst_limit(df, rate, burst, block).collect()
        assert len(got) == len(rows)
        assert {r.event_id: r.decision for r in got if r.ts is not None} == want
        assert [r.decision for r in got if r.ts is None] == [None]
        assert {"allowed", "delayed", "rejected"} == set(want.values())
    assert burst_limit(df.filter("false"), 10, 20).count() == 0


def test_fold_is_a_replay_from_every_level():
    r = random.Random(2)
    for rate, burst in ((10, 2), (3, 1)):
        b = Bucket(rate, burst)
        times = np.cumsum([r.choice([0, 10, 60, 150, 400]) for _ in range(60)])
        table = b.fold(times)
        assert [b.last(times, v) for v in range(-1000, burst * 1000 + 1, 37)] == table[::37].tolist()
