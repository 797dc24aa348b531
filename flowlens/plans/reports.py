"""Reports over findings and their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.times import duration_text
from flowlens.operators.topk import best_row, category_rank, evidence_score

# --- fixed values ---------------------------------------------------------------
EXACT_NAMES = {
    "port_scan": "Port Scan", "data_exfiltration": "Data Exfiltration", "c2_beaconing": "C2 Beaconing", "connection_flood": "Connection Flood",
    "dns_tunneling": "DNS Tunneling", "icmp_tunneling": "ICMP Tunneling", "ssh brute-force attack": "Brute-Force Attack",
    "ssh brute force attack": "Brute-Force Attack", "brute-force attack": "Brute-Force Attack", "brute force attack": "Brute-Force Attack",
    "port scan / ddos attack": "Port Scan", "dns-based attack (tunneling/exfiltration)": "Data Exfiltration",
    "network authentication attack": "Suspicious Change in Connection Outcomes", "scan": "Port Scan", "brute": "Brute Force Attack",
    "flood": "Connection Flood", "exfil": "Data Exfiltration", "tunnel": "Tunneling Activity", "beacon": "C2 Beaconing", "ddos": "DDoS Attack",
    "malware": "Malware Activity",
}
UNPREFIXED = ["port_scan", "brute_force", "brute_force_attack"]
RISK_LEVELS = [(80, "Critical"), (60, "High"), (40, "Medium"), (20, "Low")]
# --------------------------------------------------------------------------------


def risk_level(score: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for floor, name in RISK_LEVELS:
        chain = chain.when(score >= floor, name)
    return chain.otherwise("Info")


def filter_findings(findings: DataFrame, *, evidence: DataFrame | None = None, source: str | None = None, level: str | None = None,
                    ip: str | None = None, at_least: int | None = None) -> DataFrame:
    """Findings by evidence source, risk level, address part or least risk."""
    if source is not None:
        findings = findings.join(evidence.filter(F.col("source") == source), "finding_id", "left_semi")
    if level is not None:
        findings = findings.filter(risk_level(F.col("risk_score")) == level)
    if ip is not None and ip.strip():
        findings = findings.filter(F.col("ip").contains(ip.strip()))
    return findings if at_least is None else findings.filter(F.col("risk_score") >= at_least)


def alerts_of(alerts: DataFrame, ip: str) -> DataFrame:
    return alerts.filter(F.col("src_ip") == ip)


def last_tunneling(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.filter(F.col("behavior_type") == "dns_tunneling").orderBy(F.desc("ts_us"), "alert_id").limit(n)


# --- evidence ---------------------------------------------------------------------


def category_name(text: Column) -> Column:
    low = F.lower(text)
    chain = F.when(text.isNull() | (text == ""), "Unknown Activity")
    for word, name in EXACT_NAMES.items():
        chain = chain.when(low == word, name)
    for word, name in EXACT_NAMES.items():
        chain = chain.when(low.contains(word), name)
    words = F.regexp_replace(F.trim(F.replace(low, F.lit("_"), F.lit(" "))), r"\s+", " ")
    return chain.otherwise(F.initcap(words))


def evidence_category() -> Column:
    scenario = F.trim(F.coalesce(F.col("matched_scenario"), F.lit("")))
    behavior = F.trim(F.coalesce(F.col("behavior_type"), F.lit("")))
    kind = F.trim(F.coalesce(F.col("type"), F.lit("")))
    from_models = kind.isin("ml_anomaly", "behavior_anomaly")
    connection = F.lit("Connection ")
    named = category_name(scenario)
    return (
        F.when((scenario != "") & F.lower(scenario).contains("dns"), F.when(named.startswith("DNS "), named).otherwise(F.concat(F.lit("DNS "), named)))
        .when((scenario != "") & from_models & ~scenario.isin(UNPREFIXED), F.concat(connection, named))
        .when(scenario != "", named)
        .when((behavior != "") & from_models, F.concat(connection, category_name(behavior)))
        .when(behavior != "", category_name(behavior))
        .when(kind == "ml_anomaly", F.concat(F.lit("Connection ML Anomaly - "), F.coalesce(F.col("severity"), F.lit("Low"))))
        .when(kind == "behavior_anomaly", "Connection Behavior Anomaly")
        .when(kind == "dns_tunneling", "DNS Tunneling")
        .when(kind == "suricata_alert", "Suricata Alert")
        .otherwise(category_name(kind))
    )


def evidence_categories(evidence: DataFrame) -> DataFrame:
    """Alerts per finding and category."""
    return evidence.groupBy("finding_id", evidence_category().alias("category")).agg(F.count("*").alias("n"))


def evidence_quality() -> Column:
    kind = F.when(F.col("type") == "behavior_anomaly", 20).when(
        F.col("type") == "ml_anomaly", F.when(F.col("severity") == "High", 25).when(F.col("severity") == "Medium", 15).otherwise(5)).otherwise(0)
    details = F.when(F.col("dst_ip").isNotNull(), 10).otherwise(0)
    return F.least(F.lit(100), F.lit(50) + kind + details + F.when(F.coalesce(F.col("matched_scenario"), F.lit("")) != "", 10).otherwise(0))


def timeline(evidence: DataFrame, keys: Sequence[str] = ("finding_id",)) -> DataFrame:
    rows = evidence.groupBy(*keys).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("total_events"), F.count("ts_us").alias("timed_events"))
    share = F.concat(F.col("timed_events").cast("string"), F.lit("/"), F.col("total_events").cast("string"), F.lit(" events"))
    return rows.withColumns({"duration": duration_text(F.col("first_us"), F.col("last_us")), "completeness": share})


def smallest_distinct(df: DataFrame, keys: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """The n smallest distinct values per group, in order. Values are made
    distinct first; the rank filter then cuts each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(value)
    cut = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return cut.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(out))


def patterns(evidence: DataFrame) -> DataFrame:
    """What the alerts of each finding and category connect to."""
    keys = ["finding_id", "category"]
    rows = evidence.withColumns({
        "category": evidence_category(), "dst_ip": F.when(~F.col("dst_ip").isin("", "-"), F.col("dst_ip")),
        "dst_port": F.when(F.col("dst_port") != 0, F.col("dst_port")), "proto": F.upper(F.when(~F.col("proto").isin("", "-"), F.col("proto")))})
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("total_connections"), F.countDistinct("dst_ip").alias("unique_destinations"), F.countDistinct("dst_port").alias("unique_ports"),
        F.countDistinct("service").alias("pattern_diversity"))
    states = rows.filter(~F.col("conn_state").isin("", "-")).groupBy(*keys, "conn_state").agg(F.count("*").alias("_n")).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("conn_state", "_n")))).alias("connection_states"))
    out = counts.join(states, keys, "left")
    for value, n, name in (("dst_ip", 5, "destination_ips"), ("dst_port", 10, "destination_ports")):
        out = out.join(smallest_distinct(rows, keys, value, n, name), keys, "left")
    protocols = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("proto")).alias("protocols"))
    return out.join(protocols, keys, "left")


def evidence_summary() -> Column:
    ml = F.concat(F.coalesce(F.col("detector"), F.lit("ML Model")), F.lit(" detected "), F.coalesce(F.col("matched_scenario"), F.lit("Anomalous behavior")),
                  F.lit(" with "), F.coalesce(F.col("severity"), F.lit("Unknown")), F.lit(" confidence"))
    return (F.when(F.col("type") == "ml_anomaly", ml)
            .when(F.col("type") == "behavior_anomaly", F.concat(F.lit("Behavioral anomaly: "), F.coalesce(F.nullif(F.col("behavior_type"), F.lit("")), F.lit("Unknown behavior"))))
            .otherwise(F.concat(F.lit("Security event: "), F.col("type"))))


def evidence_sequence(evidence: DataFrame, *, block_us: int = 300_000_000) -> DataFrame:
    """All evidence with its category, summary, connection and ``sequence_id``, its place
    from 1 in time order inside (finding, category). It is a table, not an array,
    because a finding has no upper size. Alerts without a time come first.

    Places are counted inside blocks of time and shifted by the blocks before, so no
    task sorts a whole finding.
    """
    keys = ["finding_id", "category", "_block"]
    block = F.coalesce(F.floor(F.col("ts_us") / block_us), F.lit(-1)).alias("_block")
    rows = evidence.select("*", evidence_category().alias("category"), block)
    earlier = Window.partitionBy("finding_id", "category").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ts_us", "alert_id"))
    connection = F.struct("src_ip", "dst_ip", "dst_port", "proto", "service", "conn_state").alias("connection")
    return rows.withColumn("_place", place).join(before, keys).select(
        "finding_id", "category", (F.col("_before") + F.col("_place")).alias("sequence_id"), "ts_us", "alert_id", "type", "matched_scenario", "detector",
        evidence_summary().alias("summary"), connection)


def connection_timelines(sequence: DataFrame) -> DataFrame:
    """First and last connection of each (finding, category) of a sequence, how many there are and how many services they use."""
    return sequence.groupBy("finding_id", "category").agg(
        F.min_by("connection", "sequence_id").alias("first_connection"), F.max_by("connection", "sequence_id").alias("last_connection"),
        F.count("*").alias("total_connections"), F.countDistinct(F.coalesce("connection.service", F.lit("unknown"))).alias("pattern_diversity"))


def pre_analysis(evidence: DataFrame, *, top: int = 10) -> DataFrame:
    """One row per finding and leading category: best evidence, its quality,
    connection pattern, category place, timeline and complexity of the finding."""
    keys = ["finding_id", "category"]
    rows = evidence.withColumn("category", evidence_category())
    best = best_row(rows, keys, evidence_score()).select(
        *keys, F.col("alert_id").alias("best_alert_id"), evidence_quality().alias("confidence_score"), evidence_summary().alias("best_summary"))
    counts = evidence_categories(evidence).withColumn("place", F.row_number().over(
        Window.partitionBy("finding_id").orderBy(category_rank(F.col("category")), F.desc("n"), "category")))
    details = counts.join(best, keys).join(patterns(evidence), keys)
    rank = F.row_number().over(Window.partitionBy("finding_id").orderBy(F.desc("confidence_score"), F.desc("n"), "category"))
    leading = details.withColumn("rank", rank).filter(F.col("rank") <= top)
    totals = timeline(evidence)
    complexity = F.when(F.col("total_events") > 10, "High").when(F.col("total_events") > 3, "Medium").otherwise("Low")
    heading = F.concat(F.col("category"), F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") > 1, " events)").otherwise(" event)"))
    return leading.join(totals, "finding_id").withColumns({"complexity": complexity, "summary": heading})


# --- findings ---------------------------------------------------------------------


#: Fields of the findings summary and how many values each shows (fixed values).
SUMMARY_LISTS = {"severity": None, "src_ip": 3, "finding_type": 3, "proto": 5}
SUMMARY_BUCKETS = 256


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts of all findings by severity, source, type and behaviour in one
    pass; rank 1 is the most frequent value of its field."""
    tall = findings.select("severity", F.col("ip").alias("source"), "finding_type").unpivot([], ["severity", "source", "finding_type"], "field", "value")
    counts = tall.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value")))


def summary_lists(rows: DataFrame) -> DataFrame:
    """The lists of the findings summary over one row a finding (:func:`compact` rows):
    all severities, the most frequent sources and types and protocols. A missing value
    counts as unknown.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in SUMMARY_LISTS]
    tall = rows.select(*fields).unpivot([], list(SUMMARY_LISTS), "field", "value")
    counts = tall.groupBy("field", "value").agg(F.count("*").alias("n"))
    most = F.create_map(*[F.lit(x) for name, n in SUMMARY_LISTS.items() if n for x in (name, n)])[F.col("field")]
    order = (F.desc("n"), "value")
    # every bucket of values hands on its own leaders, so no task ranks all sources
    bucket = F.pmod(F.xxhash64("value"), F.lit(SUMMARY_BUCKETS))
    led = counts.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(Window.partitionBy("field", "_bucket").orderBy(*order)))
    led = led.filter(most.isNull() | (F.col("_rank") <= most)).select("field", "value", "n")
    ranked = led.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(*order)))
    return ranked.filter(most.isNull() | (F.col("rank") <= most))


def summary_text(rows: DataFrame, window: str = "recent") -> DataFrame:
    """The findings summary as one sentence row: total, grave ones, most active source, main type."""
    lists = summary_lists(rows).filter("rank = 1 or field = 'severity'")

    def top(name):
        return F.max_by(F.struct("value", "n"), F.when(F.col("field") == name, -F.col("rank")))

    row = lists.agg(
        F.coalesce(F.sum(F.when(F.col("field") == "severity", F.col("n"))), F.lit(0)).alias("total_findings"),
        F.coalesce(F.sum(F.when((F.col("field") == "severity") & F.lower("value").isin("high", "critical"), F.col("n"))), F.lit(0)).alias("grave"),
        top("src_ip").alias("source"), top("finding_type").alias("kind"))
    total, grave = F.col("total_findings").cast("string"), F.col("grave").cast("string")
    parts = F.array_compact(F.array(
        F.concat(F.lit("Analyzed "), total, F.lit(f" security findings from {window} activity.")),
        F.when(F.col("grave") > 0, F.concat(grave, F.lit(" high/critical severity alerts require immediate attention."))),
        F.when(F.col("source.n") > 1, F.concat(F.lit("Most active source IP: "), F.col("source.value"), F.lit(" ("), F.col("source.n").cast("string"), F.lit(" alerts)"))),
        F.when(F.col("kind").isNotNull(), F.concat(F.lit("Primary threat type: "), F.col("kind.value"), F.lit(" ("), F.col("kind.n").cast("string"), F.lit(" occurrences)")))))
    none = F.lit("No security findings detected in the specified time window.")
    return row.select("total_findings", "grave", F.when(F.col("total_findings") > 0, F.array_join(parts, " ")).otherwise(none).alias("summary"))


def recommendations(alerts: DataFrame, by: str = "src_ip") -> DataFrame:
    """Advice per source from its alert counts."""
    n, b, m = F.count("*"), F.count_if(F.col("type") == "behavior_anomaly"), F.count_if(F.col("type") == "ml_anomaly")
    counts = alerts.groupBy(by).agg(n.alias("n"), b.alias("b"), m.alias("m"))
    advice = F.array_compact(F.array(
        F.when(F.col("b") > 5, "Monitor this IP for continued suspicious behavior"), F.when(F.col("b") > 5, "Consider rate limiting or temporary blocking"),
        F.when(F.col("m") > 3, "Review ML model predictions for false positives"), F.when(F.col("m") > 3, "Correlate with other security tools"),
        F.when(F.col("n") > 10, "Prioritize investigation of this IP"), F.when(F.col("n") > 10, "Check for lateral movement indicators")))
    default = F.array(F.lit("Continue monitoring"), F.lit("Document findings for future reference"))
    return counts.select(by, F.slice(F.when(F.size(advice) > 0, advice).otherwise(default), 1, 5).alias("recommendations"))


def fleet_recommendations(findings: DataFrame) -> DataFrame:
    """Advice over all findings: one row."""
    by_source = findings.groupBy("ip").agg(F.count("*").alias("n")).agg(F.max_by("ip", F.struct("n", "ip")).alias("ip"), F.max("n").alias("n"))
    by_type = findings.groupBy("finding_type").agg(F.count("*").alias("n")).agg(F.max_by("finding_type", F.struct("n", "finding_type")).alias("kind"))
    base = findings.agg(F.count("*").alias("total"), F.count_if(F.col("severity").isin("high", "critical")).alias("grave"))
    row = base.withColumns({"top": by_source.select(F.struct("ip", "n")).scalar(), "kind": by_type.scalar()})
    kind = F.lower(F.col("kind"))
    advice = F.array_compact(F.array(
        F.when(F.col("grave") > 0, F.concat(F.lit("Prioritize investigation of "), F.col("grave").cast("string"), F.lit(" high/critical severity alerts"))),
        F.when(F.col("top.n") > 3, F.concat(F.lit("Consider blocking/monitoring IP "), F.col("top.ip"), F.lit(" ("), F.col("top.n").cast("string"), F.lit(" alerts)"))),
        F.when(kind.contains("scan"), "Deploy network segmentation to limit scan impact").when(kind.contains("malware") | kind.contains("c2"), "Initiate malware investigation and endpoint isolation")
        .when(kind.contains("ddos"), "Activate DDoS mitigation and traffic filtering"),
        F.when(F.col("total") > 20, "High alert volume detected - consider tuning detection rules")))
    calm = F.array(F.lit("Continue monitoring - current threat level appears manageable"))
    return row.select(F.slice(F.when(F.size(advice) > 0, advice).otherwise(calm), 1, 5).alias("recommendations"))


def executive_summary(findings: DataFrame) -> DataFrame:
    """One row: total, grave ones, sources and the most frequent type."""
    kinds = findings.groupBy("finding_type").agg(F.count("*").alias("n"))
    top = kinds.agg(F.min_by("finding_type", F.struct(-F.col("n"), F.col("finding_type"))))
    return findings.agg(
        F.count("*").alias("total_findings"), F.count_if(F.col("severity").isin("critical", "high")).alias("grave"),
        F.countDistinct("ip").alias("sources")).withColumn("top_type", top.scalar())


def investigate(alerts: DataFrame, ip: str | None = None) -> DataFrame:
    """Totals, spread, time span and severity per source (or of one source)."""
    rows = alerts if ip is None else alerts_of(alerts, ip)
    host, port = F.when(~F.col("dst_ip").isin("", "-"), F.col("dst_ip")), F.when(F.col("dst_port") != 0, F.col("dst_port"))
    rows = rows.withColumns({"_host": host, "_port": port})
    base = rows.groupBy("src_ip").agg(
        F.count("*").alias("total_alerts"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.countDistinct("_host").alias("unique_destinations"),
        F.countDistinct("_port").alias("unique_ports"), F.count_if(F.col("type") == "behavior_anomaly").alias("_b"), F.count_if(F.col("type") == "ml_anomaly").alias("_m"))
    types = rows.groupBy("src_ip", "type").agg(F.count("*").alias("_n")).groupBy("src_ip").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "_n")))).alias("alert_type_counts"))
    severity = (F.when((F.col("_b") > 10) | (F.col("_m") > 5), "High").when(F.col("total_alerts") > 20, "Medium").when(F.col("total_alerts") > 5, "Low").otherwise("Informational"))
    out = base.join(types, "src_ip").join(smallest_distinct(rows, ["src_ip"], "_host", 10, "destinations"), "src_ip", "left")
    out = out.join(smallest_distinct(rows, ["src_ip"], "_port", 20, "ports"), "src_ip", "left")
    return out.withColumns({"duration": duration_text(F.col("first_us"), F.col("last_us")), "severity": severity}).drop("_b", "_m")


def ip_report(findings: DataFrame, ip: str | None = None) -> DataFrame:
    rows = findings if ip is None else findings.filter(F.col("ip") == ip)
    base = rows.groupBy("ip").agg(
        F.count("*").alias("findings"), F.avg("risk_score").alias("average_risk"), F.max("risk_score").alias("max_risk"), F.sum("evidence_count").alias("total_evidence"),
        F.min("start_us").alias("first_us"), F.max("last_us").alias("last_us"))
    types = rows.groupBy("ip", "finding_type").agg(F.count("*").alias("_n")).groupBy("ip").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("finding_type", "_n")))).alias("finding_types"))
    return base.join(types, "ip")


def board_totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "New").alias("new"), F.count_if(F.col("risk_score") >= 75).alias("high_risk"),
                        F.sum("evidence_count").alias("total_evidence"))


def session_counters(lines: DataFrame, alerts: DataFrame, findings: DataFrame) -> DataFrame:
    """Lines, alerts and findings seen, with alerts per line: one row."""
    row = lines.agg(F.count("*").alias("lines")).withColumns({
        "alerts": alerts.agg(F.count("*")).scalar(), "findings": findings.agg(F.count("*")).scalar()})
    return row.withColumn("alert_rate", F.when(F.col("lines") > 0, F.col("alerts") / F.col("lines")).otherwise(0.0))
