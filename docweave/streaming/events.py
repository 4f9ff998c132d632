"""Structured Streaming forms of the event analytics: windows, sessions, status, admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from docweave.operators.lifecycle import reopening, terminal


def read_events(spark: SparkSession, folder: str, schema: StructType, files_a_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 day", kind: str = "event_type") -> DataFrame:
    """Events per tumbling window and kind; rows later than the watermark are dropped by the engine."""
    window = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Session windows per user: start, end, number of events."""
    window = F.session_window("ts", gap)
    counts = events.withWatermark("ts", late).groupBy(window, "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def status_stream(events: DataFrame) -> DataFrame:
    """(lifecycle_id, status, reopen_count) after each micro-batch, one state of two values per lifecycle.

    Reopening is checked before completion, as for a single event; events of a batch go in order.
    """
    signal = F.when(terminal(F.col("event_type")), 1).when(reopening(F.col("event_type")), 2).otherwise(0)
    rows = events.select("lifecycle_id", "event_id", "ts", signal.alias("signal"))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, reopened = state.get if state.exists else (False, 0)
        for _, signal in sorted(((t, e), s) for pdf in parts for t, e, s in zip(pdf["ts"], pdf["event_id"], pdf["signal"])):
            if signal == 2 and done:
                done, reopened = False, reopened + 1
            elif signal == 1:
                done = True
        state.update((done, reopened))
        yield pd.DataFrame({"lifecycle_id": [key[0]], "status": ["completed" if done else "active"], "reopen_count": [reopened]})

    return rows.groupBy("lifecycle_id").applyInPandasWithState(
        fold, "lifecycle_id string, status string, reopen_count long", "done boolean, reopened long", "update", GroupStateTimeout.NoTimeout
    )


def admission_stream(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, request_id, allowed) of a stream of requests(user_id, request_id, ts): at most limit admitted in a sliding window.

    The state is the admitted times of the window, at most limit numbers per user.
    """
    rows = requests.select("user_id", "request_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for at, request in sorted((a, r) for pdf in parts for a, r in zip(pdf["at"], pdf["request_id"])):
            held = [t for t in held if at - t < seconds]
            out.append((key[0], request, len(held) < limit))
            if out[-1][2]:
                held.append(at)
        state.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "request_id", "allowed"])

    return rows.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, request_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout
    )
