"""Findings kept up to date batch by batch, at a cost that does not grow with history.

An anchored window that ended before the horizon cannot change any more: its finding and
evidence are written once as closed. The horizon is the newest time of the feed that is
farthest behind, less the allowed lateness, so that several streams can share a table.
The rest is open and lies in hash buckets of the source; a batch reads and rewrites
only the buckets that its alerts fall into. Within a source all open evidence is
anchored anew together with the new alerts, so the findings are those of one batch
over all alerts, in whatever order they came within the lateness.

Batches are committed by (query id, batch): a replayed batch writes nothing. A query
that starts again from an empty checkpoint brings old alerts once more: those before the
horizon are late, and those still open are known by their ``alert_id``.

Alerts without a source drop out, as in a batch. Late ones and those without a time
are left out and counted. ``alert_id`` is never null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.correlate import correlate, findings
from flowlens.sources.commits import CommitLog, query_id
from flowlens.sources.sinks import match_findings

BUCKETS = 64


class FindingsStore:
    def __init__(self, spark: SparkSession, path: str, *, window_us: int, lateness_us: int = 0, buckets: int = BUCKETS, feeds: Sequence[str] = ("alerts",)):
        self.spark, self.path, self.window_us, self.lateness_us = spark, path, window_us, lateness_us
        self.log, self.buckets, self.feeds = CommitLog(spark, path), buckets, list(feeds)

    def _bucket(self, source: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")

    def _open(self, entry: dict, table: str, touched: list[int] | None = None) -> DataFrame:
        """Open rows, of all buckets or of some."""
        parts = {int(k): v for k, v in entry.get("parts", {}).items()}
        names = [f"{table}/commit={v}/closed=false/bucket={k}" for k, v in parts.items() if touched is None or k in touched]
        return self.log.read(names, entry[f"{table}_schema"])

    def _closed(self, entry: dict, table: str) -> DataFrame:
        names = [f"{table}/commit={v}/closed=true" for v in entry.get("closed", [])]
        return self.log.read(names, entry[f"{table}_schema"])

    def _horizon(self, entry: dict) -> int | None:
        high = entry.get("high_us", {})
        return min(high.values()) - self.lateness_us if high and all(f in high for f in self.feeds) else None

    def add(self, alerts: DataFrame, batch: int, run: str | None = None, *, feed: str | None = None, high_us: int | None = None) -> bool:
        """Takes in the alerts of a batch; False if it is in the table already.

        ``high_us``: newest time that the feed has seen, if not that of its alerts.
        """
        run, feed = run or query_id(alerts), feed or self.feeds[0]
        with self.log.turn:
            last = self.log.latest()
            if self.log.has(last, run, batch):
                return False
            self._take(alerts, batch, run, last, feed, high_us)
            return True

    def _take(self, alerts: DataFrame, batch: int, run: str, last: dict, feed: str, high_us: int | None) -> None:
        version, buckets = last["version"] + 1, last.get("buckets", self.buckets)
        horizon = self._horizon(last)
        known = alerts.filter(F.col("src_ip").isNotNull() & (F.col("src_ip") != ""))
        known.withColumn("bucket", self._bucket("src_ip", buckets)).write.mode("overwrite").parquet(f"{self.path}/incoming/commit={version}")
        kind = T.StructType([*known.schema.fields, T.StructField("bucket", T.IntegerType())])
        incoming = self.spark.read.schema(kind).parquet(f"{self.path}/incoming/commit={version}")
        timely = F.col("ts_us").isNotNull() if horizon is None else F.coalesce(F.col("ts_us") >= horizon, F.lit(False))
        tally = incoming.groupBy("bucket").agg(F.count_if(timely).alias("timely"), F.count_if(~timely).alias("late"), F.max("ts_us").alias("high")).collect()
        touched = sorted(r["bucket"] for r in tally if r["timely"])
        high = last.get("high_us", {})
        highs = [x for x in (high.get(feed), high_us, *(r["high"] for r in tally)) if x is not None]
        entry = {**last, "version": version, "buckets": buckets, "late": last.get("late", 0) + sum(r["late"] for r in tally)}
        if highs:
            entry["high_us"] = {**high, feed: max(highs)}
        stale = [f"incoming/commit={version}"]
        if touched:
            stale += self._rewrite(incoming.filter(timely), touched, entry, last)
        for name in last.get("stale", []):  # readers of the last commit are given one batch of time
            self.log.remove(name)
        entry["stale"] = stale
        self.log.commit(entry, run, batch)

    def _rewrite(self, timely: DataFrame, touched: list[int], entry: dict, last: dict) -> list[str]:
        version, buckets = entry["version"], entry["buckets"]
        fresh = timely.drop("bucket").dropDuplicates(["alert_id"])
        old = None
        if "evidence_schema" in last:
            stored = self._open(last, "evidence", touched).drop("start_us", "finding_id")
            fresh = fresh.join(stored.select("alert_id"), "alert_id", "left_anti").select(*timely.drop("bucket").columns)
            fresh, old = stored.unionByName(fresh, allowMissingColumns=True), self._open(last, "findings", touched)
        placed = correlate(fresh, window_us=self.window_us)
        horizon = self._horizon(entry)
        closed = F.lit(False) if horizon is None else F.col("start_us") + self.window_us < horizon
        evidence = self._write(placed, "evidence", "src_ip", closed, version, buckets)
        states = findings(evidence)
        now = F.unix_micros(F.current_timestamp())
        if old is None:
            states = states.withColumn("output_us", now)
        else:
            # an old finding that is not seen now was anchored anew under another start
            pair = match_findings(old, states.withColumn("output_us", now)).filter("change <> 'kept'")
            states = pair.select(F.when(F.col("change") == "same", F.col("old")).otherwise(F.col("new")).alias("row")).select("row.*")
        self._write(states, "findings", "ip", closed, version, buckets)
        entry["evidence_schema"], entry["findings_schema"] = evidence.schema.json(), states.schema.json()
        left = evidence.select(closed.alias("closed"), self._bucket("src_ip", buckets).alias("bucket")).distinct().collect()
        parts = {k: v for k, v in last.get("parts", {}).items() if int(k) not in touched}
        entry["parts"] = parts | {str(r["bucket"]): version for r in left if not r["closed"]}
        entry["closed"] = last.get("closed", []) + ([version] if any(r["closed"] for r in left) else [])
        return [f"{t}/commit={v}/closed=false/bucket={k}" for k, v in last.get("parts", {}).items() if int(k) in touched for t in ("evidence", "findings")]

    def _write(self, rows: DataFrame, table: str, source: str, closed: Column, version: int, buckets: int) -> DataFrame:
        path = f"{self.path}/{table}/commit={version}"
        dealt = rows.withColumns({"closed": closed, "bucket": self._bucket(source, buckets)})
        # large buckets are split among tasks
        dealt.hint("rebalance", "closed", "bucket").write.mode("overwrite").partitionBy("closed", "bucket").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)

    def _all(self, table: str) -> DataFrame | None:
        entry = self.log.latest()
        return self._open(entry, table).unionByName(self._closed(entry, table)) if f"{table}_schema" in entry else None

    def findings(self) -> DataFrame | None:
        """Current state of every finding; None before the first one."""
        return self._all("findings")

    def evidence(self) -> DataFrame | None:
        """Every alert with its finding."""
        return self._all("evidence")

    def late(self) -> int:
        return self.log.latest().get("late", 0)
