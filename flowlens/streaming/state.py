"""Keyed event-time state: sliding profiles and anchored windows on streams.

State is per key and bounded by the window: the profile keeps one window of rows,
the anchored window keeps one number. Rows are applied in event-time order within
a trigger; rows older than the watermark were dropped by Spark before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.operators.anchored import LONG_AGO, window_starts

LATENESS = "5 minutes"


def event_time(df: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", lateness)


def sliding_rate(df: DataFrame, *, window_us: int, key: str = "orig_h") -> DataFrame:
    """Rows of the key in [ts - W, ts] per row, with state that expires by event
    time when the key falls silent."""
    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = np.array(state.get[0] if state.exists else [], dtype=np.int64)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts_us", "uid"], ignore_index=True)
        times = np.sort(np.concatenate([past, rows["ts_us"].to_numpy()]))
        ts = rows["ts_us"].to_numpy()
        rate = np.searchsorted(times, ts, side="right") - np.searchsorted(times, ts - window_us, side="left")
        newest = int(times[-1])
        # Late rows may still arrive down to the watermark, so the state keeps one
        # window before the older of the two.
        floor = min(newest, state.getCurrentWatermarkMs() * 1000 or newest) - window_us
        state.update(([int(t) for t in times[times >= floor]],))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() * 1000) // 1000 + window_us // 1000 + 1)
        yield pd.DataFrame({"uid": rows["uid"], key: group[0], "ts_us": ts, "ip_profile_uid_rate": rate})

    return df.groupBy(key).applyInPandasWithState(
        update, f"uid string, {key} string, ts_us bigint, ip_profile_uid_rate bigint", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_windows(df: DataFrame, *, span_us: int, key: str = "src_ip", id_column: str = "alert_id") -> DataFrame:
    """Anchored windows on a stream: ``start_us`` of the window of each row. With
    ``span_us = W`` the rows with ``ts_us = start_us`` are what a cooldown passes."""
    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free_from = state.get[0] if state.exists else LONG_AGO
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts_us", id_column], ignore_index=True)
        starts = window_starts(rows["ts_us"].to_numpy(), span_us, int(free_from))
        state.update((int(starts.max()) + span_us,))
        state.setTimeoutTimestamp(max((int(starts.max()) + span_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({id_column: rows[id_column], key: group[0], "ts_us": rows["ts_us"], "start_us": starts})

    return df.groupBy(key).applyInPandasWithState(
        update, f"{id_column} string, {key} string, ts_us bigint, start_us bigint", "free_from bigint", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling_counts(df: DataFrame, *, window: str = "300 seconds", key: str = "orig_h") -> DataFrame:
    """Per key and closed bucket: rows and distinct destinations (sketched)."""
    return df.groupBy(F.window("event_time", window), key).agg(
        F.count("*").alias("n"), F.approx_count_distinct("resp_h").alias("hosts")).select(
        key, F.unix_micros("window.start").alias("bucket_us"), "n", "hosts")


def dedup_stream(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(keys)
