"""Alerts to findings.

A finding is the set of alerts of one source inside one anchored window. The
evidence stays a table (one row per alert, with its ``finding_id``), because one
finding may hold a large share of all alerts; findings carry aggregates only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.anchored import anchor_windows
from flowlens.operators.rules import BEACON, BRUTE, COVERT, DDOS, DGA, EXFIL, HSCAN, ICMP_EXFIL, TUNNEL, VSCAN, with_threat

# --- fixed values ---------------------------------------------------------------
TITLES = {
    TUNNEL: "DNS Tunneling", DGA: "DNS DGA Attack", COVERT: "DNS Covert Channel", DDOS: "DDoS Attack",
    VSCAN: "Port Scanning", HSCAN: "Port Scanning", BRUTE: "Brute Force", EXFIL: "Data Exfiltration",
    BEACON: "C2 Communication", ICMP_EXFIL: "ICMP Tunneling",
}
SCENARIO_WEIGHT = {
    BEACON: 100, TUNNEL: 95, DGA: 90, VSCAN: 75, HSCAN: 75, "DDoS Attack": 70, BRUTE: 70, EXFIL: 70,
    "General Behavioral Anomaly": 10,
}
ALERT_KEY = ["type", "src_ip", "matched_scenario", "detector", "dst_ip", "dst_port"]
# --------------------------------------------------------------------------------


def finding_id(ip: Column, start_us: Column) -> Column:
    return F.concat_ws("_", F.lit("finding"), ip, F.floor(start_us / 1_000_000).cast("bigint").cast("string"))


def correlate(alerts: DataFrame, *, window_us: int, open_findings: DataFrame | None = None) -> DataFrame:
    """Alerts with ``start_us`` and ``finding_id``; alerts without a source drop out.
    Those of a source without a time are one finding of their own, without a start.

    ``open_findings`` (ip, start_us) come from an earlier batch, one per source:
    alerts still inside such a window join it, later ones open new windows.
    """
    known = alerts.filter(F.col("src_ip").isNotNull() & (F.col("src_ip") != ""))
    # The window is closed: an alert exactly W after the start still belongs to it.
    if open_findings is None:
        placed = anchor_windows(known, ["src_ip"], span_us=window_us + 1)
    else:
        latest = open_findings.groupBy(F.col("ip").alias("src_ip")).agg(F.max("start_us").alias("_open"))
        joined = known.join(latest, "src_ip", "left")
        inside = F.coalesce(F.col("ts_us") <= F.col("_open") + window_us, F.lit(False))
        kept = joined.filter(inside).withColumn("start_us", F.col("_open")).drop("_open")
        fresh = anchor_windows(joined.filter(F.col("_open").isNull() | ~inside).drop("_open"), ["src_ip"], span_us=window_us + 1)
        placed = kept.unionByName(fresh)
    return placed.withColumn("finding_id", finding_id(F.col("src_ip"), F.col("start_us")))


def behavior() -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(F.col("matched_scenario"), blank), F.nullif(F.col("behavior_type"), blank), F.lit("unknown"))


def _any(names: str, *words: str) -> Column:
    def has(x: Column) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(x).contains(w)
        return hit
    return F.exists(F.col(names), has)


def classify_finding(behaviors: str = "behavior_types") -> Column:
    """(finding_type, category, subcategory): DNS first, then the gravest."""
    def kind(name: str, sub: str | None = None) -> Column:
        return F.struct(F.lit(name).alias("finding_type"), F.lit("network_security").alias("category"), F.lit(sub or name).alias("subcategory"))

    dns = _any(behaviors, "dns")
    return (
        F.when(dns & _any(behaviors, "tunneling"), kind("dns_tunneling"))
        .when(dns & _any(behaviors, "dga"), kind("dns_dga"))
        .when(dns, kind("dns_anomaly"))
        .when(_any(behaviors, "port_scan", "port scan"), kind("port_scan"))
        .when(_any(behaviors, "brute"), kind("brute_force", "authentication_attack"))
        .when(_any(behaviors, "ddos", "flood"), kind("dos_attack"))
        .when(_any(behaviors, "exfiltration"), kind("data_exfiltration"))
        .when(_any(behaviors, "beaconing", "c2", "command and control"), kind("c2_communication", "command_control"))
        .otherwise(kind("security_anomaly", "anomaly_detection"))
    )


def title(ip: Column, behaviors: str = "behavior_types") -> Column:
    """Up to three threat names, in the fixed order, then those found by keyword."""
    b = F.col(behaviors)
    named = [F.when(F.array_contains(b, n), t) for n, t in TITLES.items()]

    def keyword(x: Column) -> Column:
        low = F.lower(x)
        return (F.when(low.contains("dns") & low.contains("tunneling"), "DNS Tunneling").when(low.contains("port_scan"), "Port Scanning")
                .when(low.contains("brute"), "Brute Force").when(low.contains("ddos") | low.contains("flood"), "DDoS Attack"))

    rest = F.transform(F.filter(b, lambda x: ~x.isin(list(TITLES))), keyword)
    threats = F.slice(F.array_distinct(F.array_compact(F.concat(F.array(*named), rest))), 1, 3)
    subject = F.when(F.size(threats) > 0, F.array_join(threats, " & ")).otherwise("Security Event")
    return F.concat(subject, F.lit(" from "), ip)


def findings(evidence: DataFrame) -> DataFrame:
    """One row per finding. Sets hold rule names and alert types, which are few."""
    scored = with_threat(evidence).withColumn("_behavior", behavior())
    order = F.struct(-F.col("threat_score"), F.col("ts_us"), F.col("alert_id"))
    rows = scored.groupBy("finding_id", F.col("src_ip").alias("ip"), "start_us").agg(
        F.max("ts_us").alias("last_us"),
        F.count("*").alias("evidence_count"),
        F.max("threat_score").alias("risk_score"),
        F.min_by("threat_severity", order).alias("severity"),
        F.array_sort(F.collect_set("_behavior")).alias("behavior_types"),
        F.array_sort(F.collect_set("type")).alias("alert_types"),
        F.array_sort(F.collect_set("threat_category")).alias("threat_categories"),
    )
    return rows.withColumn("_kind", classify_finding()).select("*", "_kind.*").drop("_kind").withColumns(
        {"title": title(F.col("ip")), "status": F.lit("New")})


def _count_map(evidence: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    counts = evidence.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias(out))


def ip_profile(evidence: DataFrame, keys: Sequence[str] = ("finding_id",)) -> DataFrame:
    """What the alerts of a finding (or of any other key) say about its source."""
    keys = list(keys)
    host = F.when(~F.col("dst_ip").isin("", "-"), F.col("dst_ip"))
    port = F.when(F.col("dst_port") != 0, F.col("dst_port"))
    base = evidence.groupBy(*keys).agg(
        F.count("*").alias("connection_count"), F.countDistinct(host).alias("unique_destinations"),
        F.countDistinct(port).alias("unique_dest_ports"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    for value, out in (("type", "type_counts"), ("conn_state", "state_counts")):
        base = base.join(_count_map(evidence.filter(F.col(value).isNotNull()), keys, value, out), keys, "left")
    return base.withColumnRenamed("type_counts", "alert_type_counts")


def ip_risk(evidence: DataFrame, keys: Sequence[str] = ("src_ip",)) -> DataFrame:
    """Risk of a source: gravest alert plus volume, failures and diversity."""
    keys = list(keys)
    scored = with_threat(evidence)
    failed = F.col("conn_state").isin("REJ", "S0")
    stats = scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("threat_score").alias("top"),
        F.countDistinct(F.when(~F.col("dst_ip").isin("", "-"), F.col("dst_ip"))).alias("hosts"),
        F.countDistinct(F.when(F.col("dst_port") != 0, F.col("dst_port"))).alias("ports"),
        F.avg(failed.cast("double")).alias("failure_rate"), F.countDistinct("threat_key").alias("kinds"))
    c = F.col
    volume = (F.when((c("n") > 100) | (c("ports") > 20) | (c("hosts") > 10), 15)
              .when((c("n") > 20) | (c("ports") > 5) | (c("hosts") > 3), 8).when(c("n") > 5, 3).otherwise(0))
    failures = F.when(c("failure_rate") > 0.5, 10).when(c("failure_rate") > 0.2, 5).otherwise(0)
    variety = F.when(c("kinds") >= 3, 10).when(c("kinds") >= 2, 5).otherwise(0)
    base = F.when(c("top") == 0, 10).otherwise(c("top"))
    return stats.select(*keys, F.least(F.lit(100), base + volume + failures + variety).alias("ip_risk_score"))


def finding_risk(evidence: DataFrame) -> DataFrame:
    """Gravest alert plus 5 for each further kind of threat scoring 30 or more."""
    scored = with_threat(evidence)
    kinds = F.countDistinct(F.when(F.col("threat_score") >= 30, F.col("threat_key")))
    bonus = F.least(F.greatest((kinds - 1) * 5, F.lit(0)), F.lit(15))
    return scored.groupBy("finding_id").agg(F.least(F.max("threat_score") + bonus, F.lit(100)).cast("int").alias("finding_risk_score"))


def first_per_alert_key(alerts: DataFrame, keys: Sequence[str] = ALERT_KEY) -> DataFrame:
    """The earliest alert of each alert key (no time in the key). ``min_by``
    reduces on the map side, so a hot key never gathers."""
    row = F.struct(*[F.col(c) for c in alerts.columns])
    best = alerts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(row, F.struct("ts_us", "alert_id")).alias("_row"))
    return best.select("_row.*")


def merge_evidence(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ALERT_KEY) -> DataFrame:
    """Stored evidence of open findings plus the new alerts of the same finding
    whose alert key is not stored yet."""
    on = ["finding_id", *keys]
    fresh = first_per_alert_key(new, on).join(stored.select(*on).distinct(), on, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def merge_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two states of the findings table as one: risk is the larger, sets unite,
    counts add."""
    both = old.unionByName(new, allowMissingColumns=True)
    merged = both.groupBy("finding_id", "ip").agg(
        F.min("start_us").alias("start_us"), F.max("last_us").alias("last_us"), F.sum("evidence_count").alias("evidence_count"),
        F.max("risk_score").alias("risk_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("behavior_types")))).alias("behavior_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("alert_types")))).alias("alert_types"))
    return merged.withColumn("_kind", classify_finding()).select("*", "_kind.*").drop("_kind").withColumn("title", title(F.col("ip")))


def one_row_per_finding(rows: DataFrame) -> DataFrame:
    """The latest state of each finding."""
    row = F.struct(*rows.columns)
    return rows.groupBy(F.col("finding_id").alias("_id")).agg(F.max_by(row, F.struct("last_us", "evidence_count")).alias("_row")).select("_row.*")


def is_dns_evidence() -> Column:
    return F.coalesce(F.col("behavior_type").startswith("dns_"), F.lit(False)) | F.col("type").startswith("dns_")


def _best(evidence: DataFrame, payload: str, out: str) -> DataFrame:
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCENARIO_WEIGHT.items() for x in kv]), F.col("matched_scenario")), F.lit(0))
    order = F.struct(-weight, -F.col("risk_score"), F.col("ts_us"), F.col("alert_id"))
    return evidence.groupBy("finding_id").agg(F.min_by(payload, order).alias(out))


def strongest(entries: Column, n: int, digits: int) -> Column:
    """``name=value`` of the n entries of a map that are farthest from 0."""
    items = F.filter(F.map_entries(entries), lambda e: e["value"] != 0)
    ordered = F.array_sort(F.transform(items, lambda e: F.struct((-F.abs(e["value"])).alias("k"), e["key"].alias("name"), e["value"].alias("v"))))
    return F.array_join(F.transform(F.slice(ordered, 1, n), lambda e: F.concat(e["name"], F.lit("="), F.format_string(f"%.{digits}f", e["v"]))), "; ")


def compact(evidence: DataFrame, *, ports: int = 10, z: str = "z", shap: str = "contributions") -> DataFrame:
    """One flat row per finding. ``z`` and ``shap`` are map columns of the evidence."""
    rows = findings(evidence)
    order = F.struct("ts_us", "alert_id")
    first = evidence.groupBy("finding_id").agg(*[F.min_by(c, order).alias(c) for c in ("dst_ip", "dst_port", "proto", "detector")])
    conn = _best(evidence.filter(~is_dns_evidence()), z, "_z")
    dns = _best(evidence.filter(is_dns_evidence()), shap, "_shap")
    out = rows.join(first, "finding_id").join(first_ports(evidence, n=ports), "finding_id").join(conn, "finding_id", "left").join(dns, "finding_id", "left")
    z_text, shap_text = strongest(F.col("_z"), 3, 3), strongest(F.col("_shap"), 3, 3)
    parts = F.array_compact(F.array(
        F.when(F.length(z_text) > 0, F.concat(F.lit("Behavioral: "), z_text)), F.when(F.length(shap_text) > 0, F.concat(F.lit("Content: "), shap_text))))
    return out.select(
        F.col("last_us").alias("timestamp_us"), "finding_id", "finding_type", F.col("ip").alias("src_ip"), "dst_ip", "dst_port", "proto", "severity",
        "risk_score", "detector", F.col("title").alias("matched_scenario"), "evidence_count", F.col("start_us").alias("first_ev_us"),
        F.col("last_us").alias("last_ev_us"), "sample_dst_ports",
        F.when(F.size(parts) > 0, F.array_join(parts, " | ")).otherwise("No explanation available").alias("ai_explanation"),
        F.col("behavior_types").alias("behavior_history"))


def first_ports(evidence: DataFrame, *, n: int = 10) -> DataFrame:
    """Distinct ports among the first ``n`` alerts, in order of appearance. The
    rank filter cuts each finding to n rows before the shuffle."""
    w = Window.partitionBy("finding_id").orderBy("ts_us", "alert_id")
    head = evidence.select("finding_id", "ts_us", "alert_id", "dst_port").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    listed = head.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("_n", "dst_port"))).alias("_list"))
    real = F.filter(F.transform("_list", lambda e: e["dst_port"]), lambda p: p.isNotNull() & (p != 0))
    return listed.select("finding_id", F.array_distinct(real).alias("sample_dst_ports"))
