"""Tables and JSON lines the jobs write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WATCHED = ["finding_type", "severity", "risk_score", "evidence_count"]


def match_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new findings side by side: ``old`` and ``new`` structs and
    ``change``: new, kept (not seen now), same or changed. One row per id."""
    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*df.columns)
        rank = F.struct("last_us", "evidence_count")
        return df.groupBy("finding_id").agg(F.max_by(row, rank).alias(name))

    pair = side(old, "old").join(side(new, "new"), "finding_id", "full_outer")
    same = F.lit(True)
    for c in WATCHED:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "kept").when(same, "same").otherwise("changed")
    return pair.withColumn("change", change)


def upsert_findings(old: DataFrame, new: DataFrame, *, written_us: Column | None = None) -> DataFrame:
    """The findings table after a batch; ``output_us`` marks rows written now."""
    stamp = written_us if written_us is not None else F.unix_micros(F.current_timestamp())
    stored = old if "output_us" in old.columns else old.withColumn("output_us", F.lit(None).cast("bigint"))
    fresh = new.withColumn("output_us", stamp.cast("bigint")).select(*stored.columns)
    pair = match_findings(stored, fresh)
    pick = F.when(F.col("change").isin("new", "changed"), F.col("new")).otherwise(F.col("old"))
    return pair.select(pick.alias("row")).select("row.*")


def append_compact(stored: DataFrame | None, new: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """All compact states in time order; a finding may have several."""
    rows = new if stored is None or overwrite else stored.unionByName(new, allowMissingColumns=True)
    return rows.orderBy("timestamp_us", "finding_id")


def latest_compact(rows: DataFrame) -> DataFrame:
    row = F.struct(*rows.columns)
    return rows.groupBy(F.col("finding_id").alias("_id")).agg(F.max_by(row, F.struct("timestamp_us", "evidence_count")).alias("_row")).select("_row.*")


def with_alert_date(alerts: DataFrame, version: str = "1.0") -> DataFrame:
    return alerts.withColumns({"alert_date": F.to_date(F.timestamp_micros("ts_us")), "version": F.lit(version)})


def append_daily(alerts: DataFrame, path: str, batch: str) -> None:
    """Alerts as JSON lines, one folder per batch and day. A batch that is written
    again replaces what it wrote. Large days are split among tasks."""
    with_alert_date(alerts).hint("rebalance", "alert_date").write.mode("overwrite").partitionBy("alert_date").json(f"{path}/batch={batch}")


def feedback_rows(alerts: DataFrame, verdict: Column) -> DataFrame:
    """Analyst verdicts (TP or FP) beside the alert they judge."""
    return alerts.withColumn("feedback", verdict).filter(F.col("feedback").isin("TP", "FP"))


def append_feedback(rows: DataFrame, path: str, batch: str) -> None:
    """One folder per batch, replaced when it is written again."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def export_counts(findings: DataFrame) -> DataFrame:
    """The head of an export: one row of counts."""
    return findings.agg(
        F.count("*").alias("total_findings"), F.sum("evidence_count").alias("total_events"), F.countDistinct("ip").alias("sources"),
        F.count_if(F.col("severity") == "critical").alias("critical"))


def export_findings(findings: DataFrame, evidence: DataFrame, path: str) -> None:
    """A bundle of three folders; findings and events stay distributed."""
    export_counts(findings).write.mode("overwrite").json(f"{path}/metadata")
    findings.write.mode("overwrite").json(f"{path}/findings")
    evidence.write.mode("overwrite").json(f"{path}/events")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
