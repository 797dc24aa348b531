"""Rules, risk scores and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.fixtures import ctes, view
from flowlens.functions.dns import dns_features
from flowlens.operators import alerts as A
from flowlens.operators import rules as R
from checks.scalar import DNS_SQL, SQL as SCALAR

QUERIES, SQL = {}, {}

# Rule inputs as plain columns of every connection, so that each limit is met by some.
RC = """select uid, ts_us, orig_h, resp_h, resp_p, proto, service, conn_state, orig_bytes, orig_pkts % 3 = 0 as isof_anomaly, orig_pkts % 4 in (0, 1) as ae_anomaly,
 orig_pkts % 31 as ddos_group_unique_src_ip_count, missed_bytes * 6 as vertical_scan_unique_dst_port_count, orig_pkts % 12 as ip_profile_resp_p_rate,
 orig_pkts % 13 as horizontal_scan_unique_dst_ip_count, missed_bytes * 5.5e0 as ip_profile_resp_h_rate, orig_pkts / 10e0 as z_beacon_group_count,
 1e0 - missed_bytes * 1.5e0 as z_beacon_channel_timediff_std, orig_pkts % 40 as ip_profile_uid_rate, orig_bytes * 30e0 as ip_profile_mean_orig_bytes, duration as ip_profile_mean_duration from conn"""


def rc(s, d):
    view(s, d, "conn").createOrReplaceTempView("conn")
    return s.sql(RC)


HIT = "(isof_anomaly or ae_anomaly)"
CONN_SQL = {
    R.DDOS: "ddos_group_unique_src_ip_count > 20", R.VSCAN: "(vertical_scan_unique_dst_port_count > 10 or ip_profile_resp_p_rate > 10)",
    R.HSCAN: "(horizontal_scan_unique_dst_ip_count > 10 or ip_profile_resp_h_rate > 10)", R.BEACON: "z_beacon_group_count > 5 and z_beacon_channel_timediff_std < -1.5",
    R.ICMP_EXFIL: "proto = 'icmp' and orig_bytes > 200 and ip_profile_uid_rate > 5", R.EXFIL: "conn_state = 'SF' and ip_profile_mean_orig_bytes > 50000",
    R.BRUTE: "ip_profile_uid_rate > 25 and ip_profile_mean_duration < 1 and resp_p in (22, 3389)", R.GENERAL: "true",
}
RCTE = ctes("conn") + f", rc as ({RC})"


def matching(name):
    def run(s, d):
        rule = next(r for r in R.conn_rules() if r.name == name)
        return rc(s, d).filter(rule.predicate).select("uid", rule.severity.alias("severity"), rule.detector.alias("detector"))
    return run


DETAILS = {
    R.DDOS: ("Critical", "DDoS Attack"), R.VSCAN: ("Critical", "Vertical Scan"), R.HSCAN: ("Critical", "Horizontal Scan"), R.BEACON: ("High", "Machine-like Beaconing"),
    R.ICMP_EXFIL: ("High", "ICMP Tunneling"), R.EXFIL: ("High", "Anomalous Data Volume"), R.BRUTE: ("Critical", "Brute-Force Attack"),
}
GEN_SEV = "case when isof_anomaly and ae_anomaly then 'Medium' else 'Low' end"
GEN_DET = "case when isof_anomaly and ae_anomaly then 'AI Classified: Consensus Anomaly' when ae_anomaly then 'AI Classified: Behavioral Pattern Anomaly' else 'AI Classified: Statistical Pattern Anomaly' end"
for i, (name, cond) in enumerate(CONN_SQL.items(), 1):
    key = f"RUL_{i}_" + name.split(" (")[0].lower().replace(" ", "_").replace("-", "_")
    sev, det = (f"'{DETAILS[name][0]}'", f"'AI Classified: {DETAILS[name][1]}'") if name in DETAILS else (GEN_SEV, GEN_DET)
    QUERIES[key], SQL[key] = matching(name), RCTE + f" select uid, {sev} as severity, {det} as detector from rc where {HIT} and {cond}"

CHAIN = "case " + " ".join(f"when {c} then '{n}'" for n, c in CONN_SQL.items()) + " end"
CLS = f", cl as (select *, {CHAIN} as matched_scenario from rc where {HIT}), cp as (select *, case when matched_scenario = '{R.GENERAL}' then 3 else 1 end as rule_priority, case matched_scenario " + " ".join(
    f"when '{n}' then '{v[0]}'" for n, v in DETAILS.items()) + f" else {GEN_SEV} end as severity from cl)"


def classified(s, d):
    return R.classify(rc(s, d).filter(R.either()), R.conn_rules(), R.conn_fallback())


QUERIES["RUL_8b_first_match"] = lambda s, d: classified(s, d).select("uid", "matched_scenario", "rule_priority", "severity")
SQL["RUL_8b_first_match"] = RCTE + CLS + " select uid, matched_scenario, rule_priority, severity from cp"
QUERIES["RUL_9_conn_fallback"] = lambda s, d: R.classify(rc(s, d).filter(R.either()), [r for r in R.conn_rules() if r.name != R.GENERAL], R.conn_fallback()).select("uid", "matched_scenario", "severity", "rule_matched")
SQL["RUL_9_conn_fallback"] = RCTE + f""", n as (select *, case {' '.join(f"when {c} then '{n}'" for n, c in CONN_SQL.items() if n != R.GENERAL)} end as m from rc where {HIT})
select uid, coalesce(m, case when isof_anomaly and ae_anomaly then 'High-Confidence ML Anomaly' when isof_anomaly then 'Network Anomaly' else 'Behavioral Anomaly' end) as matched_scenario,
 case m {' '.join(f"when '{n}' then '{v[0]}'" for n, v in DETAILS.items())} else case when isof_anomaly and ae_anomaly then 'High' else 'Medium' end end as severity, m is not null as rule_matched from n"""
QUERIES["RUL_0_rule_dimension"] = lambda s, d: R.rule_table(s).join(view(s, d, "alerts").groupBy(F.col("matched_scenario").alias("scenario")).agg(F.count("*").alias("alerts")), "scenario").drop("category")
SQL["RUL_0_rule_dimension"] = ctes("alerts") + """select matched_scenario as scenario, count(*) as alerts, case when matched_scenario like 'DNS%' then 'dns' else 'conn' end as log_type,
 case matched_scenario when 'DNS Tunneling Pattern' then 0 when 'General Behavioral Anomaly' then 3 else 1 end as priority,
 case when matched_scenario like 'DNS%' then 95 when matched_scenario like 'General%' then 50 else 90 end as score, case when matched_scenario like 'General%' then 'medium' else 'critical' end as severity from alerts group by 1"""

# --- DNS -----------------------------------------------------------------------
FEATS = ", ".join(f"{expr} as {name}" for name, expr in DNS_SQL.values())
ENT = SCALAR["DNS_3_entropy"].removeprefix(ctes("dns"))
NGR = SCALAR["DNS_5_ngram_score"].removeprefix(ctes("dns"))


def tail(sql):
    at = sql.rindex("\nselect")
    return sql[:at], sql[at:].replace("round(", "(").replace(", 6)", ")")


(E1, E2), (N1, N2) = tail(ENT), tail(NGR)
DCTE = ctes("dns") + E1 + N1 + f""", en as ({E2}), ng as ({N2}), dd as (select dns.*, {FEATS.replace('round(', '(').replace(', 6) as', ') as')}, query_entropy, ngram_score from dns join en using (uid) join ng using (uid)),
dx as (select *, lower(query) as q, contains(lower(query), '.tunnel.lab') as lab from dd)"""


def any_of(words):
    return "(" + " or ".join(f"contains(q, '{w}')" for w in words) + ")"


BOTH = "(isof_anomaly and ae_anomaly)"
DNS_RULES = {
    R.TUNNEL: f"""(query_length > 50 or query_entropy > 3.2 or (has_base64_pattern = 1 and has_hex_pattern = 1) or (qtype_name in ('TXT', 'NULL') and query_length > 20) or char_diversity > 0.65
 or (subdomain_count > 3 and query_entropy > 3 and query_length > 40) or (lab and (query_entropy > 3 or query_length > 15 or has_base64_pattern = 1)) or (query_entropy > 3.5 and has_base64_pattern = 1))
 and {HIT} and not ((rcode_name = 'NXDOMAIN' and char_diversity > 0.6 and query_length > 15 and not lab) or (ngram_score < 0.2 and char_diversity > 0.6 and not contains(q, '.attacker.com'))
 or {any_of(R.DIRECTORY_NAMES)} or {any_of(R.CLOUD_NAMES)})""",
    R.DGA: f"""(ngram_score < 0.1 or (char_diversity > 0.8 and vowel_consonant_ratio < 0.2) or (query_entropy > 4 and char_diversity > 0.8 and query_length > 25)
 or (query_length > 30 and char_diversity > 0.8 and ngram_score < 0.15) or (query_length > 20 and char_diversity > 0.7 and query_entropy > 3.8 and ngram_score < 0.2))
 and {BOTH} and not lab and qtype_name not in ('TXT', 'NULL') and query_length > 10 and not {any_of(R.DISCOVERY_NAMES + R.DIRECTORY_NAMES)}""",
    R.DNS_ANOMALY: f"{HIT} and not ((query_length > 20 and char_diversity > 0.7) or query_length > 50 or query_entropy > 3.2 or {any_of(R.DISCOVERY_NAMES + R.DIRECTORY_NAMES)})",
    R.COVERT: f"""((qtype_name = 'TXT' and has_base64_pattern = 1) or qtype_name = 'NULL' or (has_long_subdomain = 1 and suspicious_length = 1) or (query_entropy > 3.5 and qtype_name in ('CNAME', 'MX', 'TXT')))
 and {BOTH} and not (qtype_name in ('A', 'AAAA') and query_length < 50)""",
}


def dns_matching(name):
    def run(s, d):
        rule = next(r for r in R.dns_rules() if r.name == name)
        return dns_features(view(s, d, "dns")).filter(rule.predicate).select("uid", rule.severity.alias("severity"))
    return run


DSEV = {R.TUNNEL: f"case when {BOTH} then 'Critical' else 'High' end", R.DGA: "'Critical'", R.DNS_ANOMALY: f"case when {BOTH} then 'Medium' else 'Low' end", R.COVERT: "'High'"}
for i, name in zip((10, 11, 12, 13), DNS_RULES):
    key = f"RUL_{i}_" + name.lower().replace(" ", "_")
    QUERIES[key], SQL[key] = dns_matching(name), DCTE + f" select uid, {DSEV[name]} as severity from dx where {DNS_RULES[name]}"

DCLS = ", dc as (select *, case " + " ".join(f"when {c} then '{n}'" for n, c in DNS_RULES.items()) + f" end as m from dx where {HIT})" + f""", dv as (select *, m is not null as rule_matched,
 coalesce(m, case when {BOTH} then 'High-Confidence DNS Anomaly' when isof_anomaly then 'Suspicious DNS Behavior' else 'Unusual DNS Query Pattern' end) as matched_scenario,
 case m {' '.join(f"when '{n}' then {v}" for n, v in DSEV.items())} else case when {BOTH} then 'High' else 'Medium' end end as severity,
 case m when '{R.TUNNEL}' then 0 when '{R.DGA}' then 1 when '{R.DNS_ANOMALY}' then 2 when '{R.COVERT}' then 2 else case when {BOTH} then 2 else 3 end end as rule_priority from dc)"""


def dns_classified(s, d):
    return R.classify(dns_features(view(s, d, "dns")).filter(R.either()), R.dns_rules(), R.dns_fallback())


QUERIES["RUL_14_dns_fallback"] = lambda s, d: dns_classified(s, d).select("uid", "matched_scenario", "severity", "rule_priority", "rule_matched")
SQL["RUL_14_dns_fallback"] = DCTE + DCLS + " select uid, matched_scenario, severity, rule_priority, rule_matched from dv"
BEH = "case when not rule_matched then 'dns_tunneling' when matched_scenario like '%DGA%' then 'dns_dga' when matched_scenario like '%Tunneling%' then 'dns_tunneling' else 'dns_anomaly' end"
QUERIES["RUL_15_behavior_type"] = lambda s, d: dns_classified(s, d).select("uid", R.dns_behavior().alias("behavior_type"))
SQL["RUL_15_behavior_type"] = DCTE + DCLS + f" select uid, {BEH} as behavior_type from dv"
QUERIES["RUL_16_safe_numbers"] = lambda s, d: view(s, d, "conn").select("uid", R.num("tunnel_parents", 7.0).alias("a"), R.num("service", -1.0).alias("b"), R.num("resp_p").alias("c"))
SQL["RUL_16_safe_numbers"] = ctes("conn") + "select uid, coalesce(try_cast(nullif(nullif(tunnel_parents, ''), '-') as double), 7) as a, -1 as b, resp_p as c from conn"

RISKC = """least(case rule_priority when 1 then 80 when 3 then 50 else 30 end + case severity when 'High' then 10 when 'Medium' then 6 when 'Low' then 3 else 0 end
 + case when isof_anomaly and ae_anomaly then 15 else 8 end, case rule_priority when 1 then 95 when 3 then 70 else 55 end)"""
QUERIES["RSK_1_conn_risk"] = lambda s, d: classified(s, d).select("uid", R.risk_conn().alias("risk_score"))
SQL["RSK_1_conn_risk"] = RCTE + CLS + f" select uid, {RISKC} as risk_score from cp"
DOTS = "(length(q) - length(replace(q, '.', '')))"
RISKD = f"""least(100, case severity when 'High' then 80 when 'Medium' then 60 else 40 end + case when {any_of(R.RISKY_WORDS)} then 20 when length(q) > 100 then 15 when {DOTS} > 10 then 10 else 0 end
 + case when length(q) > 50 then 25 else 0 end + case when {DOTS} > 5 then 15 else 0 end + case when regexp_matches(q, '[0-9]') then 10 else 0 end
 + case when qtype_name in ('TXT', 'MX', 'AAAA') then 5 else 0 end + case when query_entropy > 4 then 10 else 0 end + case when query_length > 50 then 5 else 0 end)"""
QUERIES["RSK_2_dns_risk"] = lambda s, d: dns_classified(s, d).select("uid", R.risk_dns().alias("risk_score"))
SQL["RSK_2_dns_risk"] = DCTE + DCLS + f" select uid, {RISKD} as risk_score from dv"

QUERIES["ALR_1_conn_alert"] = lambda s, d: A.conn_alerts(classified(s, d)).select(
    "alert_id", "src_ip", "dst_ip", "dst_port", "matched_scenario", "confidence", "risk_score", F.col("features")["ip_profile_uid_rate"].alias("uid_rate"), F.round(F.col("z")["z_beacon_group_count"], 6).alias("z_count"))
SQL["ALR_1_conn_alert"] = RCTE + CLS + f""" select substr(md5(concat_ws('_', uid, ts_us, orig_h, resp_h, resp_p, isof_anomaly, ae_anomaly)), 1, 12) as alert_id, orig_h as src_ip, resp_h as dst_ip, resp_p as dst_port, matched_scenario,
 case when isof_anomaly and ae_anomaly then 0.9 else 0.7 end as confidence, {RISKC} as risk_score, ip_profile_uid_rate as uid_rate, round(z_beacon_group_count, 6) as z_count from cp"""
QUERIES["ALR_2_dns_alert"] = lambda s, d: A.dns_alerts(dns_classified(s, d)).select(
    "alert_id", "src_ip", "behavior_type", "risk_score", F.regexp_replace("primary_indicator", r"[:.][^,]*[0-9]", "").alias("indicators"), F.array_join("context", "; ").alias("context"))
LISTED = "[" + ", ".join(f"case when {c} <> 0 then '{c}' end" for c in ["query_length", "query_entropy", "subdomain_count", "numeric_ratio", "ngram_score", "has_base64_pattern", "has_hex_pattern", "has_long_subdomain", "suspicious_length", "char_diversity", "vowel_consonant_ratio"]) + "]"
SQL["ALR_2_dns_alert"] = DCTE + DCLS + f""" select substr(md5(concat_ws('_', uid, ts_us, orig_h, resp_h, resp_p, isof_anomaly, ae_anomaly)), 1, 12) as alert_id, orig_h as src_ip, {BEH} as behavior_type, {RISKD} as risk_score,
 concat('ML models detected anomaly based on', '') as indicators, concat('Query: ', query, '; Type: ', qtype_name, '; Response: ', rcode_name) as context from dv"""
QUERIES["ALR_2_dns_alert"] = lambda s, d: A.dns_alerts(dns_classified(s, d)).select(
    "alert_id", "src_ip", "behavior_type", "risk_score", F.array_join(F.transform(F.split("primary_indicator", ", "), lambda x: F.regexp_extract(x, r"([a-z0-9_]+): [-0-9.]+$", 1)), ",").alias("indicators"),
    F.array_join("context", "; ").alias("context"))
SQL["ALR_2_dns_alert"] = SQL["ALR_2_dns_alert"].replace("concat('ML models detected anomaly based on', '')", f"array_to_string(list_filter({LISTED}, lambda x: x is not null)[1:5], ',')")


def alr3(s, d):
    items = F.transform("embedding", lambda v, i: F.struct(i.alias("feature"), v.cast("double").alias("v"), F.when(v < 0, "anomaly").otherwise("normal").alias("direction")))
    rows = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", A.toward_anomaly(items).alias("kept"))
    return rows.select("vec_id", F.size("kept").alias("n"), F.array_join(F.transform("kept", lambda e: e["feature"].cast("string")), ",").alias("features"))


QUERIES["ALR_3_anomaly_directed"] = alr3
SQL["ALR_3_anomaly_directed"] = """select vec_id, count(*) as n, string_agg(i - 1, ',' order by i) as features from (select vec_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as v from embeddings) where v < 0 group by 1"""
