"""Sessions of a fixed time to live, closed by timers of the event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quire import fixed_values as V

#: Timers need this store of the state.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FixedLife(StatefulProcessor):
    """A user's first event opens a session that ends a fixed time later, whatever happens in between; the next event opens another.

    The state holds the numbers of events per time of each frame until their session is final, so
    events may come in any order that the watermark allows, and frames are taken one
    at a time, each with one call to the store. A timer stands at the end of the session that is
    open (``first`` is its begin); once it has closed the last one, nothing is left of the user.
    """

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, events long")
        self.first = handle.getValueState("first", "at long")

    def _end(self, first: int) -> int:
        return -(-(first + self.ttl_us) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        held = self.first.get()
        before = first = held[0] if held else None
        for frame in rows:
            counts = frame["us"].value_counts(sort=False)
            self.pending.appendList([(int(at), int(n)) for at, n in counts.items()])
            first = int(counts.index.min()) if first is None else min(first, int(counts.index.min()))
        if first != before:
            self.first.update((first,))
            if before is None or self._end(first) != self._end(before):
                if before is not None:
                    self.handle.deleteTimer(self._end(before))
                self.handle.registerTimer(self._end(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.pending.get())
        closed, i = [], 0
        while i < len(held) and held[i][0] + self.ttl_us <= until:
            start, end, n = held[i][0], held[i][0] + self.ttl_us, 0
            while i < len(held) and held[i][0] < end:
                n += held[i][1]
                i += 1
            closed.append((key[0], start, end, n))
        if i < len(held):
            self.pending.put(held[i:])
            self.first.update((held[i][0],))
            if self._end(held[i][0]) != expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(self._end(held[i][0]))
        else:
            self.pending.clear()
            self.first.clear()
        yield pd.DataFrame(closed, columns=["user_id", "started", "ended", "events"])

    def close(self) -> None:
        pass


def fixed_sessions(events: DataFrame, ttl_hours: int = V.SESSION_HOURS, late: str = "1 hour") -> DataFrame:
    """Closed sessions (user_id, started, ended in microseconds, events) of a stream (user_id, ts).

    Events without a time or a user are left out. Sessions that the watermark hasn't passed stay open.
    """
    rows = events.where("user_id is not null and ts is not null").select("user_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    kind = dict(events.dtypes)["user_id"]
    return rows.groupBy("user_id").transformWithStateInPandas(
        FixedLife(ttl_hours * 3_600_000_000), f"user_id {kind}, started long, ended long, events long", "Append", "EventTime"
    )


def stream_expiry(events: DataFrame, folder: str, ttl_hours: int = V.SESSION_HOURS, late: str = "1 hour") -> StreamingQuery:
    """Closed sessions land in ``folder``/data, one part per batch."""
    conf = events.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    try:
        # a query keeps the settings it was started with
        return (
            fixed_sessions(events, ttl_hours, late).writeStream.foreachBatch(run).outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/progress").start()
        )
    finally:
        conf.unset(STORE[0]) if before is None else conf.set(STORE[0], before)
