"""Stateful processors with typed state and timers: admissions and lifecycle status whose state does not outlive its use.

They need a state store that keeps column families (RocksDB, see use_rocksdb) and a watermark: a timer in event
time drops what a key holds once nothing later can refer to it, so state is bounded by what is live in a window
and not by every user or lifecycle ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.operators.lifecycle import reopening, terminal

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def wait_until(handle: StatefulProcessorHandle, at: int) -> None:
    """Leave one timer of the key, for that moment (milliseconds)."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at)


class Admission(StatefulProcessor):
    """The admitted times of a user's window, a list; gone when the window has passed."""

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        out = []
        for at, request in sorted((a, r) for pdf in rows for a, r in zip(pdf["at"], pdf["request_id"])):
            held = [t for t in held if at - t < self.seconds]
            out.append((key[0], request, len(held) < self.limit))
            if out[-1][2]:
                held.append(at)
        if held:
            self.held.put([(t,) for t in held])
            wait_until(self.handle, int((held[-1] + self.seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["user_id", "request_id", "allowed"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class Status(StatefulProcessor):
    """Whether a lifecycle is done and how often it was reopened; forgotten when nothing came for a while after completion."""

    def __init__(self, quiet_seconds: float) -> None:
        self.quiet = quiet_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "done boolean, reopened long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        done, reopened = self.state.get() if self.state.exists() else (False, 0)
        last = 0.0
        for at, _, signal in sorted((a, e, s) for pdf in rows for a, e, s in zip(pdf["at"], pdf["event_id"], pdf["signal"])):
            last = at
            if signal == 2 and done:
                done, reopened = False, reopened + 1
            elif signal == 1:
                done = True
        self.state.update((bool(done), int(reopened)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if done:
            self.handle.registerTimer(int((last + self.quiet) * 1000) + 1)
        yield pd.DataFrame({"lifecycle_id": [key[0]], "status": ["completed" if done else "active"], "reopen_count": [reopened]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def seconds_of(ts: str) -> Any:
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at")


def admissions(requests: DataFrame, limit: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """(user_id, request_id, allowed) of a stream of requests(user_id, request_id, ts): at most limit admitted in a sliding window.

    Requests later than the watermark may find their window gone and are then judged by what is left of it.
    """
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("user_id", "request_id", "ts", seconds_of("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(Admission(limit, seconds), "user_id long, request_id long, allowed boolean", "Append", "EventTime")


def statuses(events: DataFrame, quiet_seconds: float = 90 * 86400.0, late: str = "1 hour") -> DataFrame:
    """(lifecycle_id, status, reopen_count) after each micro-batch of events(lifecycle_id, event_id, event_type, ts).

    A lifecycle that was completed and then had no event for quiet_seconds is forgotten; should it come back, it
    begins anew.
    """
    signal = F.when(terminal(F.col("event_type")), 1).when(reopening(F.col("event_type")), 2).otherwise(0)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("lifecycle_id", "event_id", "ts", seconds_of("ts"), signal.alias("signal"))
    return rows.groupBy("lifecycle_id").transformWithStateInPandas(Status(quiet_seconds), "lifecycle_id string, status string, reopen_count long", "Update", "EventTime")
