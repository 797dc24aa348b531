"""Streaming jobs: log folder in, findings table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowlens.plans.flows import Detector, detect_conn, detect_dns
from flowlens.session import cut_lineage
from flowlens.sources.commits import query_id
from flowlens.sources.envelope import unwrap_conn, unwrap_dns
from flowlens.sources.zeek import split_lines, stream_lines, typed
from flowlens.streaming.findings import FindingsStore
from flowlens.streaming.windows import FRESH, QuietState, WindowState


class ProgressCallback(StreamingQueryListener):
    """Hands input and output rates of each trigger to a function."""

    def __init__(self, notify: Callable[[str, dict], None]):
        self.notify = notify

    def onQueryStarted(self, event) -> None:
        self.notify("started", {"id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.notify("progress", {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        self.notify("idle", {"id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.notify("stopped", {"id": str(event.id), "error": event.exception})


def parse_lines(lines: DataFrame, kind: str, *, envelope: bool = False) -> DataFrame:
    rows = (unwrap_conn if kind == "conn" else unwrap_dns)(lines) if envelope else split_lines(lines, kind)
    return typed(rows, kind)


def start(rows: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, *, seconds: int | None = None) -> StreamingQuery:
    """Catch-up (``seconds`` is None: everything available, then stop) or live."""
    writer = rows.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def run_dns(spark: SparkSession, source: str, store: FindingsStore, checkpoint: str, detector: Detector, *,
            seconds: int | None = None, max_files: int = 100) -> StreamingQuery:
    """DNS lines to findings: alerts of a trigger go into the open findings of their sources."""
    def each_batch(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("ts_us")).first()[0]
        store.add(detect_dns(batch, detector, explain=False), number, query_id(batch), feed="dns", high_us=newest)

    return start(parse_lines(stream_lines(spark, source, max_files=max_files), "dns"), each_batch, checkpoint, seconds=seconds)


def run_conn(spark: SparkSession, source: str, store: FindingsStore, state: WindowState, quiet: QuietState, checkpoint: str, detector: Detector, *,
             seconds: int | None = None, max_files: int = 100) -> StreamingQuery:
    """Connection lines to findings, with the windows and silences of earlier triggers.

    It may write to the store that :func:`run_dns` writes to, with ``feeds=("conn", "dns")``:
    commits take turns, and each query has its own batches in the log. A trigger that is run again starts
    from the states before it, and the store takes it once."""
    def each_batch(batch: DataFrame, number: int) -> None:
        run = query_id(batch)
        rows = state.advance(batch, number, run)
        alerts = detect_conn(rows, detector, explain=False, quiet_us=None, only=FRESH)
        store.add(quiet.let_through(cut_lineage(alerts), number, run), number, run, feed="conn", high_us=state.high_us())

    return start(parse_lines(stream_lines(spark, source, max_files=max_files), "conn"), each_batch, checkpoint, seconds=seconds)
