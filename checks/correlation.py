"""Cooldown, correlation, findings, top-k and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.fixtures import WINDOW_US as W
from flowlens.fixtures import ctes, view
from flowlens.operators import anchored, correlate, quantiles, rules, tallies, topk
from flowlens.sources import sinks
from checks.windows import r6

QUERIES, SQL = {}, {}


def anchor_sql(keys, step, source="alerts", name="starts"):
    """Recursive chain of window starts; ``step`` is the smallest distance of two."""
    k = ", ".join(keys)
    return f""", {name}_p as materialized (select distinct {k}, ts_us from {source}),
{name}_n as materialized (select *, min(ts_us) over (partition by {k} order by ts_us range between {step} following and unbounded following) as nxt from {name}_p),
{name} as (select {k}, min(ts_us) as s from {name}_p group by {k} union all select {', '.join('c.' + x for x in keys)}, n.nxt from {name} c join {name}_n n on {' and '.join(f'n.{x} = c.{x}' for x in keys)} and n.ts_us = c.s where n.nxt is not null)"""


COR = anchor_sql(["src_ip"], W + 1) + f""", ev as (select a.*, s.s as start_us, concat('finding_', a.src_ip, '_', s.s // 1000000) as finding_id from alerts a join starts s on a.src_ip = s.src_ip and a.ts_us between s.s and s.s + {W})"""
THREAT = """, th as (select *, matched_scenario as threat_key,
 case when matched_scenario = 'General Behavioral Anomaly' then 50 when matched_scenario like 'DNS%' then 95 else 90 end as threat_score,
 case when matched_scenario = 'General Behavioral Anomaly' then 'medium' else 'critical' end as threat_severity,
 case when matched_scenario like 'DNS%' then 'dns_attack' else 'rule_based' end as threat_category from ev)"""
BASE = ctes("alerts") + COR


def evidence(s, d):
    return correlate.correlate(view(s, d, "alerts"), window_us=W)


QUERIES["COR_1_anchored_windows"] = lambda s, d: evidence(s, d).select("alert_id", "start_us")
SQL["COR_1_anchored_windows"] = BASE + " select alert_id, start_us from ev"

MID = 1704067200000000 + 12_960_000_000


def cor2(s, d):
    alerts = view(s, d, "alerts")
    old = correlate.correlate(alerts.filter(F.col("ts_us") < MID), window_us=W)
    opened = old.groupBy(F.col("src_ip").alias("ip")).agg(F.max("start_us").alias("start_us"))
    new = correlate.correlate(alerts.filter(F.col("ts_us") >= MID), window_us=W, open_findings=opened)
    return old.unionByName(new).select("alert_id", "finding_id")


QUERIES["COR_2_carry_open_findings"] = cor2
SQL["COR_2_carry_open_findings"] = BASE + " select alert_id, finding_id from ev"
QUERIES["COR_3_finding_id"] = lambda s, d: evidence(s, d).groupBy("finding_id", "src_ip").agg(F.count("*").alias("n"))
SQL["COR_3_finding_id"] = BASE + " select finding_id, src_ip, count(*) as n from ev group by 1, 2"
QUERIES["COR_4_threat_summary"] = lambda s, d: correlate.findings(evidence(s, d)).select(
    "finding_id", "risk_score", "severity", "evidence_count", F.array_join("behavior_types", "|").alias("behaviors"), F.array_join("alert_types", "|").alias("types"),
    F.array_join("threat_categories", "|").alias("categories"))
FIND = BASE + THREAT + """, fd as (select finding_id, src_ip as ip, start_us, max(ts_us) as last_us, count(*) as evidence_count, max(threat_score) as risk_score,
 arg_min(threat_severity, (-threat_score, ts_us, alert_id)) as severity, string_agg(distinct matched_scenario, '|' order by matched_scenario) as behaviors,
 string_agg(distinct type, '|' order by type) as types, string_agg(distinct threat_category, '|' order by threat_category) as categories from th group by 1, 2, 3)
, fc as (select *, case when behaviors like '%DNS%' and behaviors like '%Tunneling%' then 'dns_tunneling' when behaviors like '%DNS%' and behaviors like '%DGA%' then 'dns_dga'
 when behaviors like '%Port Scan%' then 'port_scan' when behaviors like '%Brute%' then 'brute_force' when behaviors like '%C2%' then 'c2_communication' else 'security_anomaly' end as finding_type from fd)"""
SQL["COR_4_threat_summary"] = FIND + " select finding_id, risk_score, severity, evidence_count, behaviors, types, categories from fd"
QUERIES["COR_5_finding_class"] = lambda s, d: correlate.findings(evidence(s, d)).select("finding_id", "finding_type", "subcategory")
SQL["COR_5_finding_class"] = FIND + """ select finding_id, finding_type, case finding_type when 'brute_force' then 'authentication_attack' when 'c2_communication' then 'command_control'
 when 'security_anomaly' then 'anomaly_detection' else finding_type end as subcategory from fc"""
QUERIES["COR_6_title"] = lambda s, d: correlate.findings(evidence(s, d)).select("finding_id", "title")
TITLE = """case when len(t) > 0 then concat(array_to_string(t[1:3], ' & '), ' from ', ip) else concat('Security Event from ', ip) end"""
SQL["COR_6_title"] = FIND + f""" select finding_id, {TITLE} as title from (select finding_id, ip, list_filter([
 case when behaviors like '%DNS Tunneling%' then 'DNS Tunneling' end, case when behaviors like '%DGA%' then 'DNS DGA Attack' end, case when behaviors like '%Port Scan%' then 'Port Scanning' end,
 case when behaviors like '%Brute%' then 'Brute Force' end, case when behaviors like '%C2%' then 'C2 Communication' end], lambda x: x is not null) as t from fd)"""


def pairs(m):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


QUERIES["COR_7_ip_profile"] = lambda s, d: correlate.ip_profile(evidence(s, d)).select(
    "finding_id", "connection_count", "unique_destinations", "unique_dest_ports", "first_us", "last_us", pairs("alert_type_counts").alias("types"), pairs("state_counts").alias("states"))
SQL["COR_7_ip_profile"] = BASE + """, b as (select finding_id, count(*) as connection_count, count(distinct dst_ip) as unique_destinations, count(distinct dst_port) as unique_dest_ports, min(ts_us) as first_us, max(ts_us) as last_us from ev group by 1),
t as (select finding_id, string_agg(concat(type, '=', n), ',' order by type) as types from (select finding_id, type, count(*) as n from ev group by 1, 2) group by 1),
c as (select finding_id, string_agg(concat(conn_state, '=', n), ',' order by conn_state) as states from (select finding_id, conn_state, count(*) as n from ev group by 1, 2) group by 1)
select * from b join t using (finding_id) join c using (finding_id)"""
QUERIES["COR_8_ip_risk"] = lambda s, d: correlate.ip_risk(evidence(s, d), ["finding_id"])
SQL["COR_8_ip_risk"] = BASE + THREAT + """, x as (select finding_id, count(*) as n, max(threat_score) as top, count(distinct dst_ip) as hosts, count(distinct dst_port) as ports, count(distinct threat_key) as kinds,
 avg(case when conn_state in ('REJ', 'S0') then 1.0 else 0 end) as f from th group by 1)
select finding_id, least(100, top + case when n > 100 or ports > 20 or hosts > 10 then 15 when n > 20 or ports > 5 or hosts > 3 then 8 when n > 5 then 3 else 0 end
 + case when f > 0.5 then 10 when f > 0.2 then 5 else 0 end + case when kinds >= 3 then 10 when kinds >= 2 then 5 else 0 end) as ip_risk_score from x"""
QUERIES["COR_9_finding_risk"] = lambda s, d: correlate.finding_risk(evidence(s, d))
SQL["COR_9_finding_risk"] = BASE + THREAT + " select finding_id, least(100, max(threat_score) + least(15, 5 * (count(distinct threat_key) - 1))) as finding_risk_score from th group by 1"


def states(s, d):
    """Findings as stored at half time and as found later."""
    ev = evidence(s, d)
    return correlate.findings(ev.filter(F.col("ts_us") < MID)), correlate.findings(ev.filter(F.col("ts_us") >= MID))


QUERIES["COR_10_finding_merge"] = lambda s, d: correlate.merge_findings(*states(s, d)).select(
    "finding_id", "evidence_count", "risk_score", "last_us", "finding_type", F.array_join("behavior_types", "|").alias("behaviors"))
SQL["COR_10_finding_merge"] = FIND + " select finding_id, evidence_count, risk_score, last_us, finding_type, behaviors from fc"


def z_maps(ev):
    zs = F.create_map(F.lit("z_a"), F.col("raw_score") - 20, F.lit("z_b"), F.lit(3.5) - F.col("dst_port"), F.lit("z_c"), F.lit(0.0), F.lit("z_d"), F.col("dst_port") / 8)
    return ev.withColumn("z", zs).withColumn("contributions", F.create_map(F.lit("query_length"), F.col("raw_score") / 7, F.lit("ttl"), F.lit(-1.25) + F.col("dst_port")))


QUERIES["COR_11_compact_alert"] = lambda s, d: correlate.compact(z_maps(evidence(s, d))).select(
    "finding_id", "timestamp_us", "finding_type", "src_ip", "dst_ip", "dst_port", "proto", "severity", "risk_score", "detector", "evidence_count", "first_ev_us",
    F.array_join(F.transform("sample_dst_ports", lambda p: p.cast("string")), ",").alias("ports"), "ai_explanation")
SQL["COR_11_compact_alert"] = FIND + """, w as (select *, case matched_scenario when 'C2 Beaconing' then 100 when 'DNS Tunneling Pattern' then 95 when 'DNS DGA Attack Pattern' then 90 when 'Vertical Port Scan' then 75
 when 'Brute-Force Attack' then 70 when 'General Behavioral Anomaly' then 10 else 0 end as weight from ev),
f1 as (select finding_id, arg_min(dst_ip, (ts_us, alert_id)) as dst_ip, arg_min(dst_port, (ts_us, alert_id)) as dst_port, arg_min(proto, (ts_us, alert_id)) as proto, arg_min(detector, (ts_us, alert_id)) as detector from ev group by 1),
hd as (select finding_id, dst_port, row_number() over (partition by finding_id order by ts_us, alert_id) as n from ev),
fp as (select finding_id, dst_port, min(n) as n from hd where n <= 10 group by 1, 2), ports as (select finding_id, string_agg(dst_port, ',' order by n) as ports from fp group by 1),
bc as (select finding_id, arg_min({'s': raw_score, 'p': dst_port}, (-weight, -risk_score, ts_us, alert_id)) as b from w where behavior_type = '' group by 1),
bd as (select finding_id, arg_min({'s': raw_score, 'p': dst_port}, (-weight, -risk_score, ts_us, alert_id)) as b from w where behavior_type <> '' group by 1),
ze as (select finding_id, unnest(['z_a', 'z_b', 'z_c', 'z_d']) as k, unnest([b.s - 20, 3.5 - b.p, 0, b.p / 8]) as v from bc),
zt as (select finding_id, string_agg(concat(k, '=', format('{:.3f}', v)), '; ' order by r) as z from (select *, row_number() over (partition by finding_id order by -abs(v), k) as r from ze where v <> 0) where r <= 3 group by 1),
se as (select finding_id, unnest(['query_length', 'ttl']) as k, unnest([b.s / 7, -1.25 + b.p]) as v from bd),
st as (select finding_id, string_agg(concat(k, '=', format('{:.3f}', v)), '; ' order by r) as z from (select *, row_number() over (partition by finding_id order by -abs(v), k) as r from se where v <> 0) where r <= 3 group by 1)
select fc.finding_id, last_us as timestamp_us, finding_type, ip as src_ip, f1.dst_ip, f1.dst_port, f1.proto, severity, risk_score, f1.detector, evidence_count, start_us as first_ev_us, ports,
 case when zt.z is null and st.z is null then 'No explanation available' else concat_ws(' | ', 'Behavioral: ' || zt.z, 'Content: ' || st.z) end as ai_explanation
 from fc join f1 using (finding_id) join ports using (finding_id) left join zt using (finding_id) left join st using (finding_id)"""

QUERIES["DED_2_cooldown"] = lambda s, d: anchored.cooldown(view(s, d, "alerts"), window_us=W).select("alert_id")
SQL["DED_2_cooldown"] = ctes("alerts") + anchor_sql(["matched_scenario", "src_ip"], W) + """ select min(alert_id) as alert_id from alerts a join starts s on a.matched_scenario = s.matched_scenario and a.src_ip = s.src_ip and a.ts_us = s.s
 group by a.matched_scenario, a.src_ip, a.ts_us"""
# every seventh port: alerts that have lost their time
UNTIMED = ctes("alerts") + ", lost as (select * replace (case when dst_port % 7 > 0 then ts_us end as ts_us) from alerts), timed as (select * from lost where ts_us is not null)"


def untimed(s, d):
    return view(s, d, "alerts").withColumn("ts_us", F.when(F.col("dst_port") % 7 > 0, F.col("ts_us")))


QUERIES["DED_2_cooldown_untimed"] = lambda s, d: anchored.cooldown(untimed(s, d), window_us=W).select("alert_id", "ts_us")
SQL["DED_2_cooldown_untimed"] = UNTIMED + anchor_sql(["matched_scenario", "src_ip"], W, "timed") + """ select min(alert_id) as alert_id, a.ts_us from timed a join starts s on a.matched_scenario = s.matched_scenario and a.src_ip = s.src_ip and a.ts_us = s.s
 group by a.matched_scenario, a.src_ip, a.ts_us union all select alert_id, null from lost where ts_us is null"""
QUERIES["COR_1_untimed_alerts"] = lambda s, d: correlate.correlate(untimed(s, d), window_us=W).select("alert_id", "start_us", "finding_id")
SQL["COR_1_untimed_alerts"] = UNTIMED + anchor_sql(["src_ip"], W + 1, "timed") + f""" select alert_id, s.s as start_us, concat('finding_', a.src_ip, '_', s.s // 1000000) as finding_id from timed a join starts s on a.src_ip = s.src_ip and a.ts_us between s.s and s.s + {W}
 union all select alert_id, null, concat('finding_', src_ip) from lost where ts_us is null"""
QUERIES["DED_3_alert_key_dedup"] = lambda s, d: correlate.first_per_alert_key(view(s, d, "alerts")).select("alert_id")
SQL["DED_3_alert_key_dedup"] = ctes("alerts") + "select arg_min(alert_id, (ts_us, alert_id)) as alert_id from alerts group by type, src_ip, matched_scenario, detector, dst_ip, dst_port"


def ded4(s, d):
    old, new = states(s, d)
    return correlate.one_row_per_finding(old.unionByName(new)).select("finding_id", "last_us", "evidence_count")


HALVES = BASE + f"""{THREAT}, st as (select finding_id, src_ip as ip, start_us, max(ts_us) as last_us, count(*) as evidence_count, max(threat_score) as risk_score, ts_us >= {MID} as later,
 arg_min(threat_severity, (-threat_score, ts_us, alert_id)) as severity, string_agg(distinct matched_scenario, '|' order by matched_scenario) as behaviors from th group by finding_id, src_ip, start_us, ts_us >= {MID})"""
QUERIES["DED_4_finding_dedup"] = ded4
SQL["DED_4_finding_dedup"] = HALVES + " select finding_id, max(last_us) as last_us, arg_max(evidence_count, (last_us, evidence_count)) as evidence_count from st group by 1"


def snk1(s, d):
    old, new = states(s, d)
    return sinks.upsert_findings(old, new, written_us=F.lit(7)).select("finding_id", "evidence_count", "risk_score", "last_us", "output_us")


QUERIES["SNK_1_findings_upsert"] = snk1
SQL["SNK_1_findings_upsert"] = HALVES + """ , o as (select * from st where not later), n as (select * from st where later), kd as (select *, 0 from st)
select coalesce(n.finding_id, o.finding_id) as finding_id, case when same then o.evidence_count else coalesce(n.evidence_count, o.evidence_count) end as evidence_count,
 case when same then o.risk_score else coalesce(n.risk_score, o.risk_score) end as risk_score, case when same then o.last_us else coalesce(n.last_us, o.last_us) end as last_us,
 case when same or n.finding_id is null then null else 7 end as output_us
 from o full join n on o.finding_id = n.finding_id, lateral (select coalesce(o.severity = n.severity and o.risk_score = n.risk_score and o.evidence_count = n.evidence_count
   and case when o.behaviors like '%DNS Tunneling%' then 1 when o.behaviors like '%DGA%' then 2 when o.behaviors like '%Port Scan%' then 3 when o.behaviors like '%Brute%' then 4 when o.behaviors like '%C2%' then 5 else 6 end
     = case when n.behaviors like '%DNS Tunneling%' then 1 when n.behaviors like '%DGA%' then 2 when n.behaviors like '%Port Scan%' then 3 when n.behaviors like '%Brute%' then 4 when n.behaviors like '%C2%' then 5 else 6 end, false) as same)"""
SQL["SNK_1_findings_upsert"] = SQL["SNK_1_findings_upsert"].replace(", kd as (select *, 0 from st)", "")
QUERIES["JON_5_findings_old_new"] = lambda s, d: sinks.match_findings(*states(s, d)).select("finding_id", "change")
SQL["JON_5_findings_old_new"] = SQL["SNK_1_findings_upsert"].replace("select coalesce(n.finding_id, o.finding_id) as finding_id,", "select coalesce(n.finding_id, o.finding_id) as finding_id, case when same then 'same' when o.finding_id is null then 'new' when n.finding_id is null then 'kept' else 'changed' end as change,")
SQL["JON_5_findings_old_new"] = "select finding_id, change from (" + SQL["JON_5_findings_old_new"] + ")"


def jon6(s, d):
    ev = evidence(s, d)
    merged = correlate.merge_evidence(ev.filter(F.col("ts_us") < MID), ev.filter(F.col("ts_us") >= MID))
    return merged.select("alert_id", "finding_id")


AK = "finding_id, type, src_ip, matched_scenario, detector, dst_ip, dst_port"
QUERIES["JON_6_merge_into_open"] = jon6
SQL["JON_6_merge_into_open"] = BASE + f""" select alert_id, finding_id from ev where ts_us < {MID} union all
 select arg_min(alert_id, (ts_us, alert_id)), finding_id from ev where ts_us >= {MID} and ({AK}) not in (select ({AK}) from ev where ts_us < {MID}) group by {AK}"""
QUERIES["JON_4_threat_lookup"] = lambda s, d: rules.with_threat(view(s, d, "alerts").withColumn(
    "matched_scenario", F.expr("case when dst_port % 5 = 0 then 'Own Rule' else matched_scenario end"))).select("alert_id", "threat_score", "threat_severity", "threat_category")
SQL["JON_4_threat_lookup"] = ctes("alerts") + """ select alert_id, case when dst_port % 5 = 0 then case rule_priority when 1 then 90 when 3 then 50 else 10 end
  when matched_scenario = 'General Behavioral Anomaly' then 50 when matched_scenario like 'DNS%' then 95 else 90 end as threat_score,
 case when dst_port % 5 = 0 then case rule_priority when 1 then 'critical' when 3 then 'medium' else 'low' end when matched_scenario = 'General Behavioral Anomaly' then 'medium' else 'critical' end as threat_severity,
 case when dst_port % 5 = 0 then case rule_priority when 0 then 'unknown' else concat('priority_', rule_priority) end when matched_scenario like 'DNS%' then 'dns_attack' else 'rule_based' end as threat_category from alerts"""

# --- top-k -------------------------------------------------------------------------
QUERIES["SRT_1_time_order"] = lambda s, d: view(s, d, "conn").groupBy("orig_h").agg(
    F.min_by("uid", F.struct("ts_us", "uid")).alias("first_uid"), F.max_by("uid", F.struct("ts_us", "uid")).alias("last_uid"))
SQL["SRT_1_time_order"] = ctes("conn") + "select orig_h, arg_min(uid, (ts_us, uid)) as first_uid, arg_max(uid, (ts_us, uid)) as last_uid from conn group by 1"
QUERIES["SRT_2_time_split"] = lambda s, d: quantiles.time_split(view(s, d, "conn"), 0.9).select("uid", "in_train")
SQL["SRT_2_time_split"] = ctes("conn") + "select uid, row_number() over (order by ts_us, uid) <= floor(0.9 * count(*) over ()) as in_train from conn"


def srt3(s, d):
    from checks.scalar import QUERIES as SCALAR
    scores = SCALAR["PRJ_15_triage_score"](s, d)
    times_ = view(s, d, "conn").selectExpr("uid", "'conn' as log_type", "ts_us as arrival").unionByName(view(s, d, "dns").selectExpr("uid", "'dns' as log_type", "ts_us as arrival"))
    return topk.triage(scores.join(times_, "uid"), 200).select("uid", "score", "log_type")


def srt3_sql():
    from checks.scalar import SQL as SCALAR
    return SCALAR["PRJ_15_triage_score"].replace("\nselect uid, least(100", "\n, sc as (select uid, least(100", 1) + """)
select uid, score, log_type from sc join (select uid, 'conn' as log_type, ts_us from conn union all select uid, 'dns', ts_us from dns) using (uid) order by score desc, log_type <> 'conn', ts_us, uid limit 200"""


QUERIES["SRT_3_triage_order"], SQL["SRT_3_triage_order"] = srt3, srt3_sql()
QUERIES["SRT_4_top_features"] = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(
    "vec_id", F.posexplode(topk.top_entries(F.transform("embedding", lambda x: x.cast("double")), 5)).alias("rank", "e")).select(
    "vec_id", "rank", F.col("e.position").alias("feature"), F.round("e.value", 6).alias("value"))
SQL["SRT_4_top_features"] = """select vec_id, r - 1 as rank, feature, round(v, 6) as value from (select vec_id, i - 1 as feature, v, row_number() over (partition by vec_id order by abs(v) desc, i) as r
 from (select vec_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as v from embeddings)) where r <= 5"""
QUERIES["SRT_5_findings_page"] = lambda s, d: topk.page(correlate.findings(evidence(s, d)), 2).select("finding_id", "last_us")
SQL["SRT_5_findings_page"] = FIND + " select finding_id, last_us from fd order by last_us desc, finding_id limit 10 offset 20"
QUERIES["SRT_6_latest_alerts"] = lambda s, d: topk.latest(view(s, d, "alerts"), 1000).select("alert_id", "ts_us")
SQL["SRT_6_latest_alerts"] = ctes("alerts") + "select alert_id, ts_us from alerts order by ts_us desc, alert_id limit 1000"
SCORE = "case severity when 'High' then 30 when 'Medium' then 20 else 10 end + case type when 'behavior_anomaly' then 20 else 15 end + 15"
QUERIES["SRT_7_best_evidence"] = lambda s, d: topk.best_row(evidence(s, d), ["finding_id", "matched_scenario"], topk.evidence_score()).select("finding_id", "matched_scenario", "alert_id")
SQL["SRT_7_best_evidence"] = BASE + f" select finding_id, matched_scenario, arg_min(alert_id, (-({SCORE}), ts_us, alert_id)) as alert_id from ev group by 1, 2"
QUERIES["SRT_8_gravest_evidence"] = lambda s, d: topk.best_row(evidence(s, d), ["finding_id"], topk.threat_weight()).select("finding_id", "alert_id")
SQL["SRT_8_gravest_evidence"] = BASE + """ select finding_id, arg_min(alert_id, (-(case type when 'behavior_anomaly' then 80 else 60 + case severity when 'High' then 20 when 'Medium' then 10 else 0 end end), ts_us, alert_id)) as alert_id from ev group by 1"""
QUERIES["SRT_9_first_ports"] = lambda s, d: correlate.first_ports(evidence(s, d)).select("finding_id", F.array_join(F.transform("sample_dst_ports", lambda p: p.cast("string")), ",").alias("ports"))
SQL["SRT_9_first_ports"] = BASE + """, hd as (select finding_id, dst_port, row_number() over (partition by finding_id order by ts_us, alert_id) as n from ev),
fp as (select finding_id, dst_port, min(n) as n from hd where n <= 10 group by 1, 2) select finding_id, string_agg(dst_port, ',' order by n) as ports from fp group by 1"""
QUERIES["SRT_10_category_order"] = lambda s, d: topk.ordered_categories(
    evidence(s, d).groupBy("finding_id", F.col("matched_scenario").alias("category")).agg(F.count("*").alias("n")), ["finding_id"])
SQL["SRT_10_category_order"] = BASE + """, c as (select finding_id, matched_scenario as category, count(*) as n from ev group by 1, 2)
select *, row_number() over (partition by finding_id order by case category when 'DNS DGA Attack Pattern' then 1 when 'DNS Tunneling Pattern' then 2 when 'Vertical Port Scan' then 4 when 'Brute-Force Attack' then 6
 when 'C2 Beaconing' then 8 else 12 end, n desc, category) as place from c"""
QUERIES["SET_1_union"] = lambda s, d: view(s, d, "conn").select("uid", "ts_us", "orig_h").unionByName(view(s, d, "dns").select("ts_us", "uid", "orig_h", "query"), allowMissingColumns=True)
SQL["SET_1_union"] = ctes("conn", "dns") + "select uid, ts_us, orig_h, null as query from conn union all select uid, ts_us, orig_h, query from dns"
QUERIES["SET_2_intersect_except"] = lambda s, d: (lambda c, n: c.intersect(n).withColumn("part", F.lit("both")).union(c.exceptAll(n).distinct().withColumn("part", F.lit("conn"))))(
    view(s, d, "conn").select("resp_h", "resp_p"), view(s, d, "alerts").select(F.col("dst_ip").alias("resp_h"), F.col("dst_port").cast("bigint").alias("resp_p")))
SQL["SET_2_intersect_except"] = ctes("conn", "alerts") + """select *, 'both' as part from (select resp_h, resp_p from conn intersect select dst_ip, dst_port from alerts)
 union all select *, 'conn' from (select distinct * from (select resp_h, resp_p from conn except all select dst_ip, dst_port from alerts))"""

# --- tallies -------------------------------------------------------------------------
QUERIES["AGG_10_top_services"] = lambda s, d: tallies.top_services(view(s, d, "conn"))
SQL["AGG_10_top_services"] = ctes("conn") + "select service, count(*) as n, row_number() over (order by count(*) desc, service) as rank from conn group by 1 order by rank limit 15"
QUERIES["AGG_11_value_counts"] = lambda s, d: tallies.value_counts(view(s, d, "conn"), ["service", "proto", "conn_state"])
SQL["AGG_11_value_counts"] = ctes("conn") + """select 'service' as field, service as value, count(*) as n from conn group by 2 union all select 'proto', proto, count(*) from conn group by 2
 union all select 'conn_state', conn_state, count(*) from conn group by 2"""
QUERIES["AGG_12_cardinalities"] = lambda s, d: tallies.cardinalities(view(s, d, "conn"), ["proto", "conn_state", "service", "orig_h", "resp_p"])
SQL["AGG_12_cardinalities"] = ctes("conn") + "select unnest(['proto', 'conn_state', 'service', 'orig_h', 'resp_p']) as field, unnest([count(distinct proto), count(distinct conn_state), count(distinct service), count(distinct orig_h), count(distinct resp_p)]) as n from conn"
QUERIES["AGG_13_score_summary"] = lambda s, d: tallies.score_summary(view(s, d, "alerts"), "raw_score", 15.0, ["matched_scenario"]).select(
    "matched_scenario", "shift", *r6("min", "max", "mean", "std", "low_percent"))
SQL["AGG_13_score_summary"] = ctes("alerts") + """select matched_scenario, case when p > 80 then 'severe' when p > 50 then 'moderate' else 'normal' end as shift, a as min, b as max, round(m, 6) as mean, round(sd, 6) as std, round(p, 6) as low_percent
 from (select matched_scenario, min(raw_score) as a, max(raw_score) as b, avg(raw_score) as m, stddev_pop(raw_score) as sd, avg(case when raw_score <= 15 then 1.0 else 0 end) * 100 as p from alerts group by 1)"""


def agg14(s, d):
    from checks.scalar import enveloped
    from flowlens.operators.filters import accepted_reason
    lines = enveloped(s, d).select(F.lit("conn").alias("log_type"), accepted_reason(F.col("value"), "conn").alias("reason"))
    out = tallies.ingest_counters(lines, by=["log_type", "reason"])
    return out.withColumn("accepted_percent", F.round("accepted_percent", 4))


QUERIES["AGG_14_ingest_counters"] = agg14
SQL["AGG_14_ingest_counters"] = ctes("conn") + """select 'conn' as log_type, reason, count(*) as total, count(*) filter (reason <> 'empty') as accepted, count(*) filter (reason = 'empty') as filtered,
 case when reason = 'empty' then 0 else 100 end as accepted_percent from (select case orig_pkts % 5 when 0 then 'empty' when 1 then 'source' when 2 then 'source' when 3 then 'json' else 'other' end as reason from conn) group by reason"""
QUERIES["AGG_15_label_distribution"] = lambda s, d: tallies.label_distribution(s.read.parquet(f"{d}/labels.parquet"), "toxic").withColumn("percent", F.round("percent", 6))
SQL["AGG_15_label_distribution"] = "select toxic, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from labels group by 1"
QUERIES["AGG_16_detection_rate"] = lambda s, d: tallies.detection_rate(view(s, d, "alerts"), "detector", F.col("isof_anomaly") & F.col("ae_anomaly")).withColumn("rate", F.round("rate", 6))
SQL["AGG_16_detection_rate"] = ctes("alerts") + "select detector, count(*) as lines, count(*) filter (isof_anomaly and ae_anomaly) as alerts, round(avg(case when isof_anomaly and ae_anomaly then 1.0 else 0 end), 6) as rate from alerts group by 1"
QUERIES["AGG_17_high_risk"] = lambda s, d: tallies.high_risk(view(s, d, "alerts"), ["src_ip"])
SQL["AGG_17_high_risk"] = ctes("alerts") + "select src_ip, count(*) as total, count(*) filter (risk_score >= 75) as high_risk from alerts group by 1"
