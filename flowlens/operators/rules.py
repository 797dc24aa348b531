"""Ordered rules: a table of predicates, first match wins.

A rule is data plus a Column predicate. ``classify`` turns a rule list into one
expression, so user rules run inside the same JVM projection as the built-in ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: names, priorities and limits of the built-in rules ----------
DDOS, VSCAN, HSCAN = "Distributed Denial of Service (DDoS)", "Vertical Port Scan", "Horizontal Port Scan"
BEACON, ICMP_EXFIL, EXFIL = "C2 Beaconing", "ICMP Data Exfiltration", "Data Exfiltration"
BRUTE, GENERAL = "Brute-Force Attack", "General Behavioral Anomaly"
DGA, TUNNEL, DNS_ANOMALY, COVERT = "DNS DGA Attack Pattern", "DNS Tunneling Pattern", "DNS Anomaly", "DNS Covert Channel"
CONN_PRIORITIES = {DDOS: 1, VSCAN: 1, HSCAN: 1, BEACON: 1, ICMP_EXFIL: 1, EXFIL: 1, BRUTE: 1, GENERAL: 3}
DNS_PRIORITIES = {DGA: 1, TUNNEL: 0, DNS_ANOMALY: 2, COVERT: 2}
CONN_SCORES, DNS_SCORES = {1: 90, 2: 70, 3: 50, 4: 30}, {0: 95, 1: 95, 2: 80, 3: 60, 4: 40}
SEVERITIES = {0: "critical", 1: "critical", 2: "high", 3: "medium", 4: "low"}
CONN_LIMITS = {
    "ddos_sources": 20, "scan_ports": 10, "scan_hosts": 10, "beacon_count_z": 5.0, "beacon_timing_z": -1.5,
    "icmp_bytes": 200, "icmp_rate": 5, "exfil_bytes": 50_000, "brute_rate": 25, "brute_duration": 1.0,
}
LOGIN_PORTS = [22, 3389]
DIRECTORY_NAMES = ["_ldap", "_kerberos", "_msdcs", "dc.", "microsoft.com", "windows.com"]
DISCOVERY_NAMES = ["wpad", "isatap"]
CLOUD_NAMES = ["cloudfront", "amazonaws", "azure", "googleapis"]
TUNNEL_LAB, ATTACKER_NAME = ".tunnel.lab", ".attacker.com"
# -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``severity`` and ``detector`` may depend on which models fired."""

    name: str
    priority: int
    predicate: Column
    severity: Column
    detector: Column
    description: str = ""


def num(name: str, default: float = 0.0) -> Column:
    """Missing, empty, '-' or unreadable values take the default."""
    return F.coalesce(F.nullif(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("-")).try_cast("double"), F.lit(default))


def either() -> Column:
    return F.col("isof_anomaly") | F.col("ae_anomaly")


def both() -> Column:
    return F.col("isof_anomaly") & F.col("ae_anomaly")


def conn_rules(limits: dict | None = None) -> list[Rule]:
    """Connection rules over profile, group and z columns; ``limits`` overrides."""
    at = {**CONN_LIMITS, **(limits or {})}
    hit = either()

    def fixed(name: str, predicate: Column, severity: str, detector: str) -> Rule:
        return Rule(name, CONN_PRIORITIES[name], hit & predicate, F.lit(severity), F.lit(f"AI Classified: {detector}"))

    return [
        fixed(DDOS, num("ddos_group_unique_src_ip_count") > at["ddos_sources"], "Critical", "DDoS Attack"),
        fixed(VSCAN, (num("vertical_scan_unique_dst_port_count") > at["scan_ports"]) | (num("ip_profile_resp_p_rate") > at["scan_ports"]),
              "Critical", "Vertical Scan"),
        fixed(HSCAN, (num("horizontal_scan_unique_dst_ip_count") > at["scan_hosts"]) | (num("ip_profile_resp_h_rate") > at["scan_hosts"]),
              "Critical", "Horizontal Scan"),
        fixed(BEACON, (num("z_beacon_group_count") > at["beacon_count_z"]) & (num("z_beacon_channel_timediff_std") < at["beacon_timing_z"]),
              "High", "Machine-like Beaconing"),
        fixed(ICMP_EXFIL, (F.col("proto") == "icmp") & (num("orig_bytes") > at["icmp_bytes"]) & (num("ip_profile_uid_rate") > at["icmp_rate"]),
              "High", "ICMP Tunneling"),
        fixed(EXFIL, (F.col("conn_state") == "SF") & (num("ip_profile_mean_orig_bytes") > at["exfil_bytes"]), "High", "Anomalous Data Volume"),
        fixed(BRUTE, (num("ip_profile_uid_rate") > at["brute_rate"]) & (num("ip_profile_mean_duration") < at["brute_duration"])
              & num("resp_p").isin(LOGIN_PORTS), "Critical", "Brute-Force Attack"),
        Rule(GENERAL, CONN_PRIORITIES[GENERAL], hit, F.when(both(), "Medium").otherwise("Low"),
             F.when(both(), "AI Classified: Consensus Anomaly").when(F.col("ae_anomaly"), "AI Classified: Behavioral Pattern Anomaly")
             .otherwise("AI Classified: Statistical Pattern Anomaly")),
    ]


def conn_fallback() -> list[Rule]:
    """For anomalies no rule names; a guard while the general rule exists."""
    return [
        Rule("High-Confidence ML Anomaly", 4, both(), F.lit("High"), F.lit("AI Classified: High-Confidence ML Anomaly")),
        Rule("Network Anomaly", 4, F.col("isof_anomaly"), F.lit("Medium"), F.lit("AI Classified: IF Pattern Anomaly")),
        Rule("Behavioral Anomaly", 4, F.col("ae_anomaly"), F.lit("Medium"), F.lit("AI Classified: AE Pattern Anomaly")),
    ]


def _names(words: Sequence[str]) -> Column:
    lowered, hit = F.lower(F.col("query")), F.lit(False)
    for w in words:
        hit = hit | lowered.contains(w)
    return F.coalesce(hit, F.lit(False))


def dns_rules() -> list[Rule]:
    """Rules over the 18 DNS features."""
    length, spread, bits = num("query_length"), num("char_diversity"), num("query_entropy")
    ngram, vowels = num("ngram_score", 1.0), num("vowel_consonant_ratio")
    base64, hexed = num("has_base64_pattern") == 1, num("has_hex_pattern") == 1
    qtype, lab = F.coalesce(F.col("qtype_name"), F.lit("")), _names([TUNNEL_LAB])

    dga = (
        (ngram < 0.1) | ((spread > 0.8) & (vowels < 0.2)) | ((bits > 4.0) & (spread > 0.8) & (length > 25))
        | ((length > 30) & (spread > 0.8) & (ngram < 0.15))
        | ((length > 20) & (spread > 0.7) & (bits > 3.8) & (ngram < 0.2))
    ) & both() & ~lab & ~qtype.isin("TXT", "NULL") & (length > 10) & ~_names(DISCOVERY_NAMES + DIRECTORY_NAMES)

    signs = (
        (length > 50) | (bits > 3.2) | (base64 & hexed) | (qtype.isin("TXT", "NULL") & (length > 20)) | (spread > 0.65)
        | ((num("subdomain_count") > 3) & (bits > 3.0) & (length > 40))
        | (lab & ((bits > 3.0) | (length > 15) | base64)) | ((bits > 3.5) & base64)
    )
    generated = (
        ((F.col("rcode_name") == "NXDOMAIN") & (spread > 0.6) & (length > 15) & ~lab)
        | ((ngram < 0.2) & (spread > 0.6) & ~_names([ATTACKER_NAME]))
    )
    tunnel = signs & either() & ~F.coalesce(generated, F.lit(False)) & ~_names(DIRECTORY_NAMES) & ~_names(CLOUD_NAMES)

    plain = either() & ~(
        ((length > 20) & (spread > 0.7)) | (length > 50) | (bits > 3.2) | _names(DISCOVERY_NAMES + DIRECTORY_NAMES))

    covert = (
        ((qtype == "TXT") & base64) | (qtype == "NULL")
        | ((num("has_long_subdomain") == 1) & (num("suspicious_length") == 1))
        | ((bits > 3.5) & qtype.isin("CNAME", "MX", "TXT"))
    ) & both() & ~(qtype.isin("A", "AAAA") & (length < 50))

    return [
        Rule(DGA, DNS_PRIORITIES[DGA], dga, F.lit("Critical"), F.lit("AI Classified: Strong DGA Pattern Detection")),
        Rule(TUNNEL, DNS_PRIORITIES[TUNNEL], tunnel, F.when(both(), "Critical").otherwise("High"),
             F.when(both(), "AI Classified: Consensus DNS Tunneling").when(F.col("ae_anomaly"), "AI Classified: DNS Tunneling Pattern")
             .otherwise("AI Classified: DNS Anomaly Detection")),
        Rule(DNS_ANOMALY, DNS_PRIORITIES[DNS_ANOMALY], plain, F.when(both(), "Medium").otherwise("Low"),
             F.when(both(), "AI Classified: DNS Anomaly").otherwise("AI Classified: DNS Pattern Anomaly")),
        Rule(COVERT, DNS_PRIORITIES[COVERT], covert, F.lit("High"), F.lit("AI Classified: Consensus Covert Channel")),
    ]


def dns_fallback() -> list[Rule]:
    return [
        Rule("High-Confidence DNS Anomaly", 2, both(), F.lit("High"), F.lit("AI Classified: BOTH DNS Anomaly")),
        Rule("Suspicious DNS Behavior", 3, F.col("isof_anomaly"), F.lit("Medium"), F.lit("AI Classified: DNS IF Anomaly")),
        Rule("Unusual DNS Query Pattern", 3, F.col("ae_anomaly"), F.lit("Medium"), F.lit("AI Classified: DNS AE Anomaly")),
    ]


def classify(df: DataFrame, rules: Sequence[Rule], fallback: Sequence[Rule] = ()) -> DataFrame:
    """Adds matched_scenario, rule_priority, severity, detector and rule_matched;
    null where nothing matches. Order: priority, then place in the list."""
    ordered = [(r, True) for r in sorted(rules, key=lambda r: r.priority)] + [(r, False) for r in fallback]
    verdicts = [
        F.when(r.predicate, F.struct(
            F.lit(r.name).alias("matched_scenario"), F.lit(r.priority).alias("rule_priority"), r.severity.alias("severity"),
            r.detector.alias("detector"), F.lit(named).alias("rule_matched")))
        for r, named in ordered
    ]
    return df.withColumn("_verdict", F.coalesce(*verdicts)).select("*", "_verdict.*").drop("_verdict")


def dns_behavior() -> Column:
    name = F.col("matched_scenario")
    known = (F.when(name.contains("DGA"), "dns_dga").when(name.contains("Tunneling"), "dns_tunneling")
             .when(name.contains("Amplification"), "dns_amplification").otherwise("dns_anomaly"))
    return F.when(F.col("rule_matched"), known).otherwise("dns_tunneling")


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a dimension: a dozen rows whatever the data."""
    rows = [(n, "conn", p, CONN_SCORES[p], SEVERITIES[p], "rule_based") for n, p in CONN_PRIORITIES.items()]
    rows += [(n, "dns", p, DNS_SCORES[p], SEVERITIES[p], "dns_attack") for n, p in DNS_PRIORITIES.items()]
    return spark.createDataFrame(rows, "scenario string, log_type string, priority int, score int, severity string, category string")


def threat_key() -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(F.col("matched_scenario"), blank), F.nullif(F.col("behavior_type"), blank), F.nullif(F.col("type"), blank), F.lit("unknown"))


def with_threat(df: DataFrame) -> DataFrame:
    """Score, severity and category of an alert: from the rule of that name, else
    from its priority, else the lowest."""
    table = F.broadcast(rule_table(df.sparkSession).select(
        F.col("scenario").alias("threat_key"), F.col("score").alias("_score"), F.col("severity").alias("_severity"), F.col("category").alias("_category")))
    p = F.col("rule_priority")
    ranked = p.isNotNull() & (p != 0)

    def by_priority(values: dict, other) -> Column:
        chain = F.when(F.lit(False), F.lit(other))
        for k, v in values.items():
            if k:
                chain = chain.when(p == k, F.lit(v))
        return F.when(ranked, chain.otherwise(F.lit(other)))

    out = df.withColumn("threat_key", threat_key()).join(table, "threat_key", "left")
    return out.withColumns({
        "threat_score": F.coalesce("_score", by_priority(CONN_SCORES, 50), F.lit(10)),
        "threat_severity": F.coalesce("_severity", by_priority(SEVERITIES, "medium"), F.lit("low")),
        "threat_category": F.coalesce("_category", F.when(ranked, F.concat(F.lit("priority_"), p.cast("string"))), F.lit("unknown")),
    }).drop("_score", "_severity", "_category")


# --- risk scores -----------------------------------------------------------------

# fixed values
CONN_BASE, CONN_CAP = {1: 80, 2: 65, 3: 50, 4: 30}, {1: 95, 2: 85, 3: 70, 4: 55}
SEVERITY_BONUS = {"High": 10, "Medium": 6, "Low": 3}
DNS_BASE = {"High": 80, "Medium": 60}
RISKY_WORDS = ["malware", "c2", "botnet", "tunnel"]


def _lookup(value: Column, table: dict, other: int) -> Column:
    chain = F.when(F.lit(False), F.lit(other))
    for k, v in table.items():
        chain = chain.when(value == k, F.lit(v))
    return chain.otherwise(F.lit(other))


def risk_conn() -> Column:
    p = F.col("rule_priority")
    agreement = F.when(both(), 15).when(either(), 8).otherwise(0)
    return F.least(_lookup(p, CONN_BASE, 30) + _lookup(F.col("severity"), SEVERITY_BONUS, 0) + agreement, _lookup(p, CONN_CAP, 55))


def risk_dns() -> Column:
    q = F.coalesce(F.lower(F.col("query")), F.lit(""))
    size, dots = F.length(q), F.length(q) - F.length(F.replace(q, F.lit("."), F.lit("")))
    words = F.lit(False)
    for w in RISKY_WORDS:
        words = words | q.contains(w)
    bonus = F.when(words, 20).when(size > 100, 15).when(dots > 10, 10).otherwise(0)
    bonus = bonus + F.when(size > 50, 25).otherwise(0) + F.when(dots > 5, 15).otherwise(0) + F.when(q.rlike("[0-9]"), 10).otherwise(0)
    bonus = bonus + F.when(F.lower(F.col("qtype_name")).isin("txt", "mx", "aaaa"), 5).otherwise(0)
    bonus = bonus + F.when(num("query_entropy") > 4.0, 10).otherwise(0) + F.when(num("query_length") > 50, 5).otherwise(0)
    return F.least(F.lit(100), _lookup(F.col("severity"), DNS_BASE, 40) + bonus)
