"""Orders, pages, best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.rules import BEACON, BRUTE, COVERT, DDOS, DGA, EXFIL, GENERAL, HSCAN, ICMP_EXFIL, TUNNEL, VSCAN

# --- fixed values ---------------------------------------------------------------
CATEGORY_ORDER = [
    DGA, TUNNEL, DDOS, VSCAN, HSCAN, BRUTE, EXFIL, BEACON, ICMP_EXFIL, COVERT,
    "Suspicious Change in Connection Outcomes", GENERAL, "Suspicious Network Connection", "General Network Anomaly", "Normal DNS Query",
]
THREAT_WEIGHT = {"threat_intel_match": 100, "behavior_anomaly": 80, "ml_anomaly": 60, "baseline_deviation": 40, "suricata_alert": 70, "log_flood": 50}
# --------------------------------------------------------------------------------


def triage(lines: DataFrame, n: int, *, conn_first: bool = True) -> DataFrame:
    """The ``n`` lines to look at first: score, then connections, then age."""
    kind = [F.col("log_type") != "conn"] if conn_first else []
    return lines.orderBy(F.desc("score"), *kind, "arrival", "uid").limit(n)


def top_entries(values: Column, n: int, *, by_size: bool = True) -> Column:
    """The n array entries farthest from 0 (or largest) as (position, value)."""
    key = (lambda v: -F.abs(v)) if by_size else (lambda v: -v)
    keyed = F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("position"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda e: F.struct(e["position"].alias("position"), e["value"].alias("value")))


def page(findings: DataFrame, number: int, *, size: int = 10) -> DataFrame:
    """Newest first; page 0 is the first."""
    return findings.orderBy(F.desc("last_us"), "finding_id").offset(number * size).limit(size)


def latest(df: DataFrame, n: int, *, ts: str = "ts_us", tie: str = "alert_id") -> DataFrame:
    return df.orderBy(F.desc(ts), tie).limit(n)


def evidence_score() -> Column:
    confidence = F.when(F.col("severity") == "High", 30).when(F.col("severity") == "Medium", 20).when(F.col("severity") == "Low", 10).otherwise(0)
    kind = F.when(F.col("type") == "behavior_anomaly", 20).when(F.col("type") == "ml_anomaly", 15).otherwise(0)
    details = F.when(F.col("dst_ip").isNotNull(), 10).otherwise(0)
    return confidence + kind + details + F.when(F.coalesce(F.col("matched_scenario"), F.lit("")) != "", 5).otherwise(0)


def threat_weight() -> Column:
    chain = F.when(F.lit(False), F.lit(0))
    for kind, weight in THREAT_WEIGHT.items():
        chain = chain.when(F.col("type") == kind, F.lit(weight))
    bonus = F.when((F.col("type") == "ml_anomaly") & (F.col("severity") == "High"), 20).when((F.col("type") == "ml_anomaly") & (F.col("severity") == "Medium"), 10)
    return chain.otherwise(F.lit(0)) + bonus.otherwise(0)


def best_row(evidence: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The best-scored row of each group; the earliest of equals. Reduced on the
    map side, so no group is gathered."""
    row = F.struct(*evidence.columns)
    picked = evidence.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min_by(row, F.struct(-score, F.col("ts_us"), F.col("alert_id"))).alias("_row"))
    return picked.select("_row.*")


def category_rank(category: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), category)
    return F.when(place > 0, place).otherwise(len(CATEGORY_ORDER) + 1)


def ordered_categories(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Place of each category inside its group: fixed order first, then count."""
    w = Window.partitionBy(*keys).orderBy(category_rank(F.col("category")), F.desc("n"), "category")
    return counts.withColumn("place", F.row_number().over(w))
