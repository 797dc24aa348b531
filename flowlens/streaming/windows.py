"""State of all sliding-window families between triggers.

Every family (profiles, beacon, scans, DDoS, live environment, concurrency) asks for
what happened in the last window. One of them is a single frame over all rows and
others have hot keys, so the state is not held by key in a state store, where such a
key lives in one task: it is a table of the last window's rows with the columns that the
families read, and a trigger runs the same two-level totals over it as a batch does
(``operators/sliding.py``). No task holds more than one short slot of a key, and the
state never outgrows a window and the allowed lateness.

Rows before the horizon (newest time of earlier triggers less the lateness) are late:
they are left out and counted. ``wait`` holds a row back until the horizon has passed it,
so that its frames are complete whatever the order of arrival; without it rows go out
in the trigger that brings them.

Commits are keyed by (query id, batch). A replayed batch starts from the state before
it and gives the same rows. After a checkpoint is lost, rows that the state has from
another run are known by (uid, time) and do not count twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.anchored import cooldown
from flowlens.operators.profiles import duration_us
from flowlens.sources.commits import CommitLog, query_id

FRESH = "fresh_"
HELD, RUN = "held_", "run_"


class RowState:
    """Commits of one folder of rows each; ``before`` names the folder a batch began with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, CommitLog(spark, path)

    def _begin(self, run: str, batch: int) -> dict:
        """The commit that the batch follows."""
        last = self.log.latest()
        return last["before"] if self.log.has(last, run, batch) and "before" in last else last

    def _rows(self, entry: dict) -> DataFrame | None:
        return self.log.read([f"rows/commit={entry['folder']}"], entry["schema"]) if "folder" in entry else None

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _end(self, rows: DataFrame, begun: dict, run: str, batch: int, **more) -> dict:
        last = self.log.latest()
        if self.log.has(last, run, batch):
            return last  # replayed: the state has it
        version = last["version"] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/commit={version}")
        before = {k: v for k, v in begun.items() if k != "before"}
        entry = {**before, **more, "version": version, "folder": version, "schema": rows.schema.json(), "before": before}
        self.log.commit(entry, run, batch)
        if "before" in last and "folder" in last["before"]:
            self.log.remove(f"rows/commit={last['before']['folder']}")
        return entry


class WindowState(RowState):
    def __init__(self, spark: SparkSession, path: str, *, window_us: int, lateness_us: int = 0, wait: bool = False):
        super().__init__(spark, path)
        self.window_us, self.lateness_us, self.wait = window_us, lateness_us, wait

    def advance(self, rows: DataFrame, batch: int, run: str | None = None) -> DataFrame:
        """The state and the batch together; FRESH marks the rows whose turn it is.

        Compute the families over all of it, then keep the fresh rows. ``rows`` has
        ``ts_us`` and ``uid`` and whatever the families read. What is returned can be
        read until the batch after the next begins.
        """
        run = run or query_id(rows)
        with self.log.turn:
            begun = self._begin(run, batch)
            stored = self._rows(begun)
            horizon = begun["high_us"] - self.lateness_us if "high_us" in begun else None
            timely = F.col("ts_us").isNotNull() if horizon is None else F.coalesce(F.col("ts_us") >= horizon, F.lit(False))
            arrived = self._write(rows.withColumns({HELD: F.lit(True), RUN: F.lit(run), "timely_": timely}), f"incoming/{batch % 2}")
            seen = arrived.agg(F.max("ts_us").alias("high"), F.count_if(~F.col("timely_")).alias("late")).first()
            arrived = arrived.filter("timely_").drop("timely_")
            if stored is not None:
                others = stored.filter((F.col(RUN) != run) & (F.col("uid") != "")).select("uid", "ts_us").distinct()
                arrived = arrived.join(others, ["uid", "ts_us"], "left_anti").select(*arrived.columns)
                arrived = stored.unionByName(arrived, allowMissingColumns=True)
            highs = [x for x in (begun.get("high_us"), seen["high"]) if x is not None]
            ahead = max(highs) - self.lateness_us if highs else 0
            due = F.col(HELD) & (F.col("ts_us") < ahead if self.wait else F.lit(True))
            marked = self._write(arrived.withColumn(FRESH, due), f"marked/{batch % 2}")
            # a row at the horizon looks back one window, and at connections that are still open
            needed = F.col("ts_us") + self.window_us
            if "duration" in rows.columns:
                needed = F.greatest(needed, F.col("ts_us") + duration_us())
            kept = marked.filter((needed >= ahead) | (F.col(HELD) & ~F.col(FRESH)))
            kept = kept.withColumn(HELD, F.col(HELD) & ~F.col(FRESH)).drop(FRESH)
            self._end(kept, begun, run, batch, late=begun.get("late", 0) + seen["late"], **({"high_us": max(highs)} if highs else {}))
            return marked.drop(HELD, RUN)

    def rest(self) -> DataFrame | None:
        """At the end of a stream with ``wait``: the state, the rows still held marked FRESH."""
        rows = self._rows(self.log.latest())
        return None if rows is None else rows.withColumn(FRESH, F.col(HELD)).drop(HELD, RUN)

    def high_us(self) -> int | None:
        """Newest time seen."""
        return self.log.latest().get("high_us")

    def late(self) -> int:
        return self.log.latest().get("late", 0)


class QuietState(RowState):
    """Cooldown across triggers: per key the time of the last alert that was let through."""

    def __init__(self, spark: SparkSession, path: str, *, window_us: int, keys: Sequence[str] = ("matched_scenario", "src_ip"), lateness_us: int = 0):
        super().__init__(spark, path)
        self.window_us, self.keys, self.lateness_us = window_us, list(keys), lateness_us

    def let_through(self, alerts: DataFrame, batch: int, run: str | None = None) -> DataFrame:
        """The alerts of the batch that pass; ``alerts`` are in event-time order from batch to batch, but for
        those inside a silence that is known."""
        run = run or query_id(alerts)
        with self.log.turn:
            begun = self._begin(run, batch)
            stored, open_alerts = self._rows(begun), alerts
            if stored is not None:
                joined = alerts.join(stored, self.keys, "left")
                silent = F.coalesce(F.col("ts_us") < F.col("last_us") + self.window_us, F.lit(False))
                open_alerts = joined.filter(~silent).select(*alerts.columns)
            passed = self._write(cooldown(open_alerts, keys=self.keys, window_us=self.window_us), f"passed/{batch % 2}")
            complete = passed.dropna(subset=[*self.keys, "ts_us"])
            last = complete.groupBy(*self.keys).agg(F.max("ts_us").alias("last_us"))
            if stored is not None:
                last = last.unionByName(stored).groupBy(*self.keys).agg(F.max("last_us").alias("last_us"))
            # a silence that is over before the horizon is forgotten
            newest = last.agg(F.max("last_us")).first()[0]
            if newest is not None:
                last = last.filter(F.col("last_us") + self.window_us >= newest - self.lateness_us)
            self._end(last, begun, run, batch)
            return passed
