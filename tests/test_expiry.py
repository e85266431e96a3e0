"""Sessions of a fixed life against a plain loop."""

import random
import tempfile
from datetime import datetime, timedelta, timezone

import pandas as pd

from quire.streaming import expiry as E
from quire.streaming.jobs import read_stream

HOUR = 3_600_000_000


def test_closed_sessions_equal_a_loop_and_no_state_is_left(spark):
    rng = random.Random(3)
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    # two files, each out of order; a last one whose time is far later closes all sessions
    spans = [[(rng.randrange(4), rng.randrange(0, 40 * 3600)) for _ in range(80)] + [(0, 3600)] * 3, [(rng.randrange(4), rng.randrange(40 * 3600, 90 * 3600)) for _ in range(80)]]
    for n, rows in enumerate([*spans, [(99, 1000 * 3600)]]):
        rows = [(u, zero + timedelta(seconds=s)) for u, s in rows]
        spark.createDataFrame(rows + [(None, zero), (1, None)], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in/{n}")
    path = f"{folder}/in/*"
    query = E.stream_expiry(read_stream(spark, path, "user_id long, ts timestamp", files_per_batch=1), folder, ttl_hours=24)
    query.awaitTermination()
    got = {(r["user_id"], r["started"], r["events"]) for r in spark.read.parquet(f"{folder}/data").collect()}
    base, want = int(zero.timestamp()) * 1_000_000, set()
    for user in range(4):
        times = sorted(base + s * 1_000_000 for u, s in spans[0] + spans[1] if u == user)
        while times:
            inside = [t for t in times if t < times[0] + 24 * HOUR]
            want.add((user, times[0], len(inside)))
            times = times[len(inside):]
    assert got == want
    # only the times of the last user, and none of the closed ones, are left
    left = spark.read.format("statestore").option("stateVarName", "pending").load(f"{folder}/progress").collect()
    assert len(left) == 1


class _Calls:
    """A store that counts what is asked of it."""

    def __init__(self):
        self.n, self.timers = 0, []

    def getListState(self, *_):
        return _State(self)

    getValueState = getMapState = getListState

    def registerTimer(self, at):
        self.n += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)

    def listTimers(self):
        self.n += 1
        return iter(self.timers)


class _State:
    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def _count(self, *_):
        self.calls.n += 1

    updateValue = appendValue = removeKey = _count

    def containsKey(self, _):
        self.calls.n += 1
        return False

    def get(self):
        self.calls.n += 1
        return self.rows[0] if len(self.rows) == 1 else None

    def update(self, row):
        self.calls.n += 1
        self.rows = [row]

    def appendList(self, rows):
        self.calls.n += 1

    def keys(self):
        self.calls.n += 1
        return iter([])


def test_the_store_is_called_by_frame_and_not_by_event():
    calls = _Calls()
    life = E.FixedLife(24 * HOUR)
    life.init(calls)
    frames = [pd.DataFrame({"us": [HOUR * k + n for n in range(500)]}) for k in (5, 3, 4)]
    list(life.handleInputRows((1,), iter(frames[:2]), None))
    list(life.handleInputRows((1,), iter(frames[2:]), None))
    assert calls.n < 12 and calls.timers == [27 * HOUR // 1000]
