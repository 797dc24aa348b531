"""Reports, findings filters, exports, evaluation and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.fixtures import ctes, table, view
from flowlens.models import thresholds as T
from flowlens.models import transforms as M
from flowlens.operators import correlate, evaluation as E
from flowlens.plans import evaluate as V, reports as P
from flowlens.sources import sinks
from checks.correlation import BASE, FIND, SQL as CSQL, evidence, pairs, z_maps
from checks.windows import r6

QUERIES, SQL = {}, {}


def findings(s, d):
    return correlate.findings(evidence(s, d))


FC = FIND
LEVEL = "case when risk_score >= 80 then 'Critical' when risk_score >= 60 then 'High' when risk_score >= 40 then 'Medium' when risk_score >= 20 then 'Low' else 'Info' end"
QUERIES["FLT_7_findings_filter"] = lambda s, d: P.filter_findings(findings(s, d), evidence=evidence(s, d), source="dns_engine", level="Critical", ip="0.1").select("finding_id", P.risk_level(F.col("risk_score")).alias("level"))
SQL["FLT_7_findings_filter"] = FC + f" select finding_id, {LEVEL} as level from fc where risk_score >= 80 and ip like '%0.1%' and finding_id in (select finding_id from ev where source = 'dns_engine')"
QUERIES["FLT_8_alerts_of_source"] = lambda s, d: P.alerts_of(view(s, d, "alerts"), "10.0.0.7").select("alert_id")
SQL["FLT_8_alerts_of_source"] = ctes("alerts") + "select alert_id from alerts where src_ip = '10.0.0.7'"
QUERIES["FLT_9_last_tunneling"] = lambda s, d: P.last_tunneling(view(s, d, "alerts")).select("alert_id", "ts_us")
SQL["FLT_9_last_tunneling"] = ctes("alerts") + "select alert_id, ts_us from alerts where behavior_type = 'dns_tunneling' order by ts_us desc, alert_id limit 10"

CAT = """case matched_scenario when 'Vertical Port Scan' then 'Connection Port Scan' when 'C2 Beaconing' then 'Connection C2 Beaconing' when 'DNS Tunneling Pattern' then 'DNS Tunneling Activity'
 when 'Brute-Force Attack' then 'Connection Brute-Force Attack' when 'DNS DGA Attack Pattern' then 'DNS Dns Dga Attack Pattern' else 'Connection General Behavioral Anomaly' end"""
QUERIES["RPT_6_evidence_category"] = lambda s, d: P.evidence_categories(evidence(s, d))
SQL["RPT_6_evidence_category"] = BASE + f" select finding_id, {CAT} as category, count(*) as n from ev group by 1, 2"
MIXED = "case dst_port % 9 when 0 then '' when 1 then 'port_scan' when 2 then 'ICMP_tunneling' when 3 then 'odd  THING_here' when 4 then 'Malware x' else matched_scenario end"
QUERIES["RPT_6b_category_names"] = lambda s, d: view(s, d, "alerts").withColumn("matched_scenario", F.expr(MIXED)).select("alert_id", P.evidence_category().alias("category"))
SQL["RPT_6b_category_names"] = ctes("alerts") + f""" select alert_id, case dst_port % 9 when 0 then case behavior_type when 'dns_tunneling' then 'Connection DNS Tunneling' when 'dns_dga' then 'Connection Dns Dga' else concat('Connection ML Anomaly - ', severity) end
 when 1 then 'Port Scan' when 2 then 'Connection ICMP Tunneling' when 3 then 'Connection Odd Thing Here' when 4 then 'Connection Malware Activity' else {CAT} end as category from alerts"""
DUR = """case when u = 0 then '0 seconds (simultaneous events)' when u < 1000000 then concat(u // 1000, ' milliseconds') when u < 60000000 then concat((u + 50000) // 1000000, '.', (u + 50000) // 100000 % 10, ' seconds')
 when u < 3600000000 then concat(u // 60000000, 'm ', u // 1000000 % 60, 's') when u < 86400000000 then concat(u // 3600000000, 'h ', u // 60000000 % 60, 'm') else concat(u // 86400000000, 'd ', u // 3600000000 % 24, 'h') end"""
QUERIES["RPT_7_timeline"] = lambda s, d: P.timeline(evidence(s, d)).select("finding_id", "first_us", "last_us", "duration", "total_events", "completeness")
SQL["RPT_7_timeline"] = BASE + f""" select finding_id, first_us, last_us, {DUR} as duration, total_events, concat(total_events, '/', total_events, ' events') as completeness
 from (select finding_id, min(ts_us) as first_us, max(ts_us) as last_us, max(ts_us) - min(ts_us) as u, count(*) as total_events from ev group by 1)"""


def texts(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def flat_patterns(df):
    return df.withColumns({"destination_ips": F.array_join("destination_ips", ","), "destination_ports": texts("destination_ports"), "protocols": F.array_join("protocols", ","),
                           "connection_states": pairs("connection_states")})


QUERIES["RPT_8_connection_patterns"] = lambda s, d: flat_patterns(P.patterns(evidence(s, d)))
PAT = f""", c as (select *, {CAT} as category from ev), pt as (select finding_id, category, count(*) as total_connections, count(distinct dst_ip) as unique_destinations, count(distinct dst_port) as unique_ports, count(distinct service) as pattern_diversity,
 array_to_string(list_sort(list(distinct dst_ip))[1:5], ',') as destination_ips, array_to_string(list_sort(list(distinct dst_port))[1:10], ',') as destination_ports, array_to_string(list_sort(list(distinct upper(proto))), ',') as protocols from c group by 1, 2),
sc as (select finding_id, category, string_agg(concat(conn_state, '=', n), ',' order by conn_state) as connection_states from (select finding_id, category, conn_state, count(*) as n from c group by 1, 2, 3) group by 1, 2)"""
SQL["RPT_8_connection_patterns"] = BASE + PAT + " select * from pt join sc using (finding_id, category)"
QUAL = "least(100, 70 + case type when 'behavior_anomaly' then 20 else case severity when 'High' then 25 when 'Medium' then 15 else 5 end end)"
QUERIES["RPT_9_evidence_quality"] = lambda s, d: view(s, d, "alerts").select("alert_id", P.evidence_quality().alias("quality"))
SQL["RPT_9_evidence_quality"] = ctes("alerts") + f"select alert_id, {QUAL} as quality from alerts"
QUERIES["RPT_10_pre_analysis"] = lambda s, d: P.pre_analysis(evidence(s, d)).select(
    "finding_id", "category", "n", "place", "rank", "best_alert_id", "confidence_score", "unique_destinations", "complexity", "summary", "duration")
SCORE = "case severity when 'High' then 30 when 'Medium' then 20 else 10 end + case type when 'behavior_anomaly' then 20 else 15 end + 15"
SQL["RPT_10_pre_analysis"] = BASE + PAT + f""", bq as (select finding_id, category, arg_min(alert_id, (-({SCORE}), ts_us, alert_id)) as best_alert_id, arg_min({QUAL}, (-({SCORE}), ts_us, alert_id)) as confidence_score from c group by 1, 2),
tl as (select finding_id, count(*) as t, max(ts_us) - min(ts_us) as u from ev group by 1),
al as (select *, total_connections as n, row_number() over (partition by finding_id order by case category when 'Nothing' then 1 else 16 end, total_connections desc, category) as place,
 row_number() over (partition by finding_id order by confidence_score desc, total_connections desc, category) as rank from pt join bq using (finding_id, category))
select finding_id, category, n, place, rank, best_alert_id, confidence_score, unique_destinations, case when t > 10 then 'High' when t > 3 then 'Medium' else 'Low' end as complexity,
 concat(category, ' (', n, case when n > 1 then ' events)' else ' event)' end) as summary, {DUR} as duration from al join tl using (finding_id) where rank <= 10"""

QUERIES["RPT_10b_evidence_sequence"] = lambda s, d: P.evidence_sequence(evidence(s, d)).select("finding_id", "category", "sequence_id", "alert_id", "matched_scenario", "connection.dst_port")
SQL["RPT_10b_evidence_sequence"] = BASE + PAT + " select finding_id, category, row_number() over (partition by finding_id, category order by ts_us, alert_id) as sequence_id, alert_id, matched_scenario, dst_port from c"
QUERIES["RPT_10c_connection_timelines"] = lambda s, d: P.connection_timelines(P.evidence_sequence(evidence(s, d))).select(
    "finding_id", "category", "total_connections", "pattern_diversity", F.col("first_connection.dst_ip").alias("first_ip"), F.col("last_connection.dst_port").alias("last_port"))
SQL["RPT_10c_connection_timelines"] = BASE + PAT + """ select finding_id, category, count(*) as total_connections, count(distinct coalesce(service, 'unknown')) as pattern_diversity,
 arg_min(dst_ip, (ts_us, alert_id)) as first_ip, arg_max(dst_port, (ts_us, alert_id)) as last_port from c group by 1, 2"""


def compact_rows(s, d):
    return correlate.compact(z_maps(evidence(s, d)))


LISTS = """, pr as (select finding_id, arg_min(proto, (ts_us, alert_id)) as proto from ev group by 1), hd as (select * from fc join pr using (finding_id)),
cn as (select 'severity' as field, severity as value, count(*) as n, 1000000 as most from hd group by 2 union all select 'src_ip', ip, count(*), 3 from hd group by 2
 union all select 'finding_type', finding_type, count(*), 3 from hd group by 2 union all select 'proto', proto, count(*), 5 from hd group by 2),
rk as (select *, row_number() over (partition by field order by n desc, value) as rank from cn)"""
QUERIES["RPT_1b_summary_lists"] = lambda s, d: P.summary_lists(compact_rows(s, d))
SQL["RPT_1b_summary_lists"] = FC + LISTS + " select field, value, n, rank from rk where rank <= most"
QUERIES["RPT_1c_summary_text"] = lambda s, d: P.summary_text(compact_rows(s, d))
SQL["RPT_1c_summary_text"] = FC + LISTS + """, t as (select (select count(*) from hd) as total_findings, (select count(*) from hd where lower(severity) in ('high', 'critical')) as grave)
select total_findings, grave, concat('Analyzed ', total_findings, ' security findings from recent activity.', case when grave > 0 then concat(' ', grave, ' high/critical severity alerts require immediate attention.') else '' end,
 (select case when n > 1 then concat(' Most active source IP: ', value, ' (', n, ' alerts)') else '' end from rk where field = 'src_ip' and rank = 1),
 (select concat(' Primary threat type: ', value, ' (', n, ' occurrences)') from rk where field = 'finding_type' and rank = 1)) as summary from t"""
QUERIES["RPT_1_findings_summary"] = lambda s, d: P.findings_summary(findings(s, d))
SQL["RPT_1_findings_summary"] = FC + """, hd as (select * from fc), cn as (select 'severity' as field, severity as value, count(*) as n from hd group by 2
 union all select 'source', ip, count(*) from hd group by 2 union all select 'finding_type', finding_type, count(*) from hd group by 2)
select *, row_number() over (partition by field order by n desc, value) as rank from cn"""
QUERIES["RPT_2_recommendations"] = lambda s, d: P.recommendations(view(s, d, "alerts").withColumn("src_ip", F.col("dst_ip"))).select("src_ip", F.array_join("recommendations", "; ").alias("advice"))
SQL["RPT_2_recommendations"] = ctes("alerts") + """, c as (select dst_ip as src_ip, count(*) as n, count(*) filter (type = 'behavior_anomaly') as b, count(*) filter (type = 'ml_anomaly') as m from alerts group by 1),
a as (select src_ip, list_filter([case when b > 5 then 'Monitor this IP for continued suspicious behavior' end, case when b > 5 then 'Consider rate limiting or temporary blocking' end,
 case when m > 3 then 'Review ML model predictions for false positives' end, case when m > 3 then 'Correlate with other security tools' end,
 case when n > 10 then 'Prioritize investigation of this IP' end, case when n > 10 then 'Check for lateral movement indicators' end], lambda x: x is not null) as l from c)
select src_ip, case when len(l) = 0 then 'Continue monitoring; Document findings for future reference' else array_to_string(l[1:5], '; ') end as advice from a"""
QUERIES["RPT_2b_fleet_recommendations"] = lambda s, d: P.fleet_recommendations(findings(s, d)).select(F.array_join("recommendations", "; ").alias("advice"))
SQL["RPT_2b_fleet_recommendations"] = FC + """, ti as (select arg_max(ip, (n, ip)) as ip, max(n) as n from (select ip, count(*) as n from fc group by 1)), tt as (select arg_max(finding_type, (n, finding_type)) as k from (select finding_type, count(*) as n from fc group by 1)),
g as (select count(*) as t, count(*) filter (severity in ('high', 'critical')) as gr from fc)
select array_to_string(list_filter([case when gr > 0 then concat('Prioritize investigation of ', gr, ' high/critical severity alerts') end, case when n > 3 then concat('Consider blocking/monitoring IP ', ip, ' (', n, ' alerts)') end,
 case when k like '%scan%' then 'Deploy network segmentation to limit scan impact' when k like '%c2%' then 'Initiate malware investigation and endpoint isolation' end,
 case when t > 20 then 'High alert volume detected - consider tuning detection rules' end], lambda x: x is not null), '; ') as advice from ti, tt, g"""
QUERIES["RPT_3_executive_summary"] = lambda s, d: P.executive_summary(findings(s, d))
SQL["RPT_3_executive_summary"] = FC + """ select count(*) as total_findings, count(*) filter (severity in ('critical', 'high')) as grave, count(distinct ip) as sources,
 (select arg_min(finding_type, (-n, finding_type)) from (select finding_type, count(*) as n from fc group by 1)) as top_type from fc"""
QUERIES["RPT_4_investigation"] = lambda s, d: (lambda r: r.withColumns({"destinations": F.array_join("destinations", ","), "ports": texts("ports"), "alert_type_counts": pairs("alert_type_counts")}))(P.investigate(view(s, d, "alerts")))
SQL["RPT_4_investigation"] = ctes("alerts") + f""", b as (select src_ip, count(*) as total_alerts, min(ts_us) as first_us, max(ts_us) as last_us, count(distinct dst_ip) as unique_destinations, count(distinct dst_port) as unique_ports,
 array_to_string(list_sort(list(distinct dst_ip))[1:10], ',') as destinations, array_to_string(list_sort(list(distinct dst_port))[1:20], ',') as ports,
 case when count(*) filter (type = 'behavior_anomaly') > 10 or count(*) filter (type = 'ml_anomaly') > 5 then 'High' when count(*) > 20 then 'Medium' when count(*) > 5 then 'Low' else 'Informational' end as severity from alerts group by 1),
t as (select src_ip, string_agg(concat(type, '=', n), ',' order by type) as alert_type_counts from (select src_ip, type, count(*) as n from alerts group by 1, 2) group by 1)
select * exclude (u), {DUR} as duration from (select *, last_us - first_us as u from b join t using (src_ip))"""
QUERIES["RPT_5_source_report"] = lambda s, d: P.ip_report(findings(s, d)).withColumns({"average_risk": F.round("average_risk", 6), "finding_types": pairs("finding_types")})
SQL["RPT_5_source_report"] = FC + """, b as (select ip, count(*) as findings, round(avg(risk_score), 6) as average_risk, max(risk_score) as max_risk, sum(evidence_count) as total_evidence, min(start_us) as first_us, max(last_us) as last_us from fc group by 1),
t as (select ip, string_agg(concat(finding_type, '=', n), ',' order by finding_type) as finding_types from (select ip, finding_type, count(*) as n from fc group by 1, 2) group by 1) select * from b join t using (ip)"""
QUERIES["RPT_11_session_counters"] = lambda s, d: P.session_counters(view(s, d, "conn"), view(s, d, "alerts"), findings(s, d)).withColumn("alert_rate", F.round("alert_rate", 6))
SQL["RPT_11_session_counters"] = FC + " select (select count(*) from events) as lines, (select count(*) from alerts) as alerts, (select count(*) from fc) as findings, 1.0 as alert_rate"
QUERIES["RPT_12_board_totals"] = lambda s, d: P.board_totals(findings(s, d))
SQL["RPT_12_board_totals"] = FC + ' select count(*) as total, count(*) as "new", count(*) filter (risk_score >= 75) as high_risk, sum(evidence_count) as total_evidence from fc'


def snk2(s, d):
    ev = z_maps(evidence(s, d))
    from checks.correlation import MID
    old, new = correlate.compact(ev.filter(F.col("ts_us") < MID)), correlate.compact(ev.filter(F.col("ts_us") >= MID))
    return sinks.append_compact(old, new).select("timestamp_us", "finding_id", "evidence_count")


QUERIES["SNK_2_compact_append"] = snk2
SQL["SNK_2_compact_append"] = CSQL["DED_4_finding_dedup"].split(" select finding_id, max(last_us)")[0] + " select last_us as timestamp_us, finding_id, evidence_count from st"
QUERIES["SNK_3_daily_log"] = lambda s, d: sinks.with_alert_date(view(s, d, "alerts").withColumn("ts_us", F.col("ts_us") + F.col("dst_port") * 3_600_000_000)).groupBy(F.col("alert_date").cast("string").alias("alert_date"), "version").agg(F.count("*").alias("n"))
SQL["SNK_3_daily_log"] = ctes("alerts") + "select cast(cast(make_timestamp(ts_us + dst_port * 3600000000) as date) as varchar) as alert_date, '1.0' as version, count(*) as n from alerts group by 1"
QUERIES["SNK_4_feedback"] = lambda s, d: sinks.feedback_rows(view(s, d, "alerts"), F.expr("case when dst_port % 3 = 0 then 'TP' when dst_port % 3 = 1 then 'FP' else 'skip' end")).select("alert_id", "feedback")
SQL["SNK_4_feedback"] = ctes("alerts") + "select alert_id, case dst_port % 3 when 0 then 'TP' else 'FP' end as feedback from alerts where dst_port % 3 < 2"
QUERIES["SNK_5_export_counts"] = lambda s, d: sinks.export_counts(findings(s, d))
SQL["SNK_5_export_counts"] = FC + " select count(*) as total_findings, sum(evidence_count) as total_events, count(distinct ip) as sources, count(*) filter (severity = 'critical') as critical from fc"

# --- evaluation ----------------------------------------------------------------------


def judged(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select("doc_id", F.col("toxic").alias("y"), F.col("n_chars").cast("double").alias("score"), "quality")
    return rows.withColumns({"iso": (F.col("score") > 800).cast("int"), "ae": (F.col("quality") == 0).cast("int")}).withColumn("ensemble", F.greatest("iso", "ae"))


J = "with j as (select doc_id, toxic as y, n_chars::double as score, case when n_chars > 800 then 1 else 0 end as iso, case when quality = 0 then 1 else 0 end as ae, greatest(case when n_chars > 800 then 1 else 0 end, case when quality = 0 then 1 else 0 end) as ensemble from labels join documents using (doc_id))"
METRICS = ["accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy"]


def metric_sql(yhat):
    return f"""select tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(tp / (tp + fn), 6) as recall,
 round(tn / (tn + fp), 6) as specificity, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy
 from (select count(*) filter (y = 1 and {yhat} = 1) as tp, count(*) filter (y = 0 and {yhat} = 1) as fp, count(*) filter (y = 1 and {yhat} = 0) as fn, count(*) filter (y = 0 and {yhat} = 0) as tn from j)"""


QUERIES["EVAL_1_binary_metrics"] = lambda s, d: E.binary_metrics(judged(s, d), "y", "iso").select("tp", "fp", "fn", "tn", *r6(*METRICS))
SQL["EVAL_1_binary_metrics"] = J + metric_sql("iso")
QUERIES["EVAL_2_roc_auc"] = lambda s, d: E.roc_auc(judged(s, d), "y", "score").select(F.round("roc_auc", 8).alias("roc_auc"))
SQL["EVAL_2_roc_auc"] = J + ", r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from j) select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 8) as roc_auc from r"
QUERIES["EVAL_2b_pr_auc"] = lambda s, d: E.pr_auc(judged(s, d), "y", "score").select(F.round("pr_auc", 8).alias("pr_auc"))
SQL["EVAL_2b_pr_auc"] = J + """, g as (select score, sum(y) as p, count(*) as n from j group by 1), c as (select score, sum(p) over w as tp, sum(n) over w as k, sum(p) over () as tot from g window w as (order by score desc)),
l as (select *, coalesce(lag(tp / k) over (order by score desc), 1) as p0, coalesce(lag(tp) over (order by score desc), 0) as tp0 from c) select round(sum((tp - tp0) / tot * (p0 + tp / k) / 2), 8) as pr_auc from l"""
QUERIES["EVAL_3_confusion_shares"] = lambda s, d: E.confusion_shares(judged(s, d), "y", "iso").withColumn("share", F.round("share", 6))
SQL["EVAL_3_confusion_shares"] = J + " select y as truth, iso as predicted, count(*) as n, round(count(*) / sum(count(*)) over (partition by y), 6) as share from j group by 1, 2"
QUERIES["EVAL_4_score_histogram"] = lambda s, d: E.histogram(judged(s, d), "y", "score")
SQL["EVAL_4_score_histogram"] = J + ", r as (select min(score) as lo, (max(score) - min(score)) / 50 as w from j) select y as truth, least(49, cast(floor((score - lo) / w) as int)) as bin, count(*) as n from j, r group by 1, 2"
QUERIES["EVAL_5_model_comparison"] = lambda s, d: E.compare_models(judged(s, d), "y", ["iso", "ae", "ensemble"]).select("model", "tp", "fp", "fn", "tn", *r6(*METRICS))
SQL["EVAL_5_model_comparison"] = J + " union all ".join(metric_sql(m).replace("select tp,", f"select '{m}' as model, tp,", 1) for m in ("iso", "ae", "ensemble"))

# --- model arithmetic ---------------------------------------------------------------
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber"]


def lines(s, d):
    return table(s, d, "lineitem").select(*KEY, *[F.col(c).cast("double").alias(c) for c in NUM], "l_returnflag", "l_linestatus")


QUERIES["ML_1_log_transform"] = lambda s, d: M.log_columns(lines(s, d), NUM).select(*KEY, *r6(*NUM))
SQL["ML_1_log_transform"] = "select l_orderkey, l_linenumber, " + ", ".join(f"round(ln(1 + abs({c}::double)), 6) as {c}" for c in NUM) + " from lineitem"
QUERIES["ML_2_selective_log"] = lambda s, d: M.log_columns(lines(s, d), ["l_quantity", "l_extendedprice"]).select(*KEY, *r6(*NUM))
SQL["ML_2_selective_log"] = "select l_orderkey, l_linenumber, round(ln(1 + l_quantity::double), 6) as l_quantity, round(ln(1 + l_extendedprice::double), 6) as l_extendedprice, round(l_discount::double, 6) as l_discount, round(l_tax::double, 6) as l_tax from lineitem"
QUERIES["ML_3_robust_scaling"] = lambda s, d: M.RobustScale(NUM).fit(lines(s, d)).transform(lines(s, d)).select(*KEY, *r6(*NUM))
SQL["ML_3_robust_scaling"] = "with q as (select " + ", ".join(f"quantile_cont({c}::double, 0.5) as {c}_m, quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25) as {c}_r" for c in NUM) + " from lineitem) select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c}::double - {c}_m) / case when {c}_r = 0 then 1 else {c}_r end, 6) as {c}" for c in NUM) + " from lineitem, q"
QUERIES["ML_4_standard_scaling"] = lambda s, d: M.StandardScale(NUM).fit(lines(s, d)).transform(lines(s, d)).select(*KEY, *r6(*NUM))
SQL["ML_4_standard_scaling"] = "with q as (select " + ", ".join(f"avg({c}::double) as {c}_m, stddev_pop({c}::double) as {c}_s" for c in NUM) + " from lineitem) select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c}::double - {c}_m) / case when {c}_s = 0 then 1 else {c}_s end, 6) as {c}" for c in NUM) + " from lineitem, q"
HOLED = {"l_quantity": "case when l_linenumber = 2 then null when l_linenumber = 3 then cast('NaN' as double) else l_quantity end"}
QUERIES["ML_5_imputation"] = lambda s, d: M.impute(lines(s, d).withColumn("l_quantity", F.expr(HOLED["l_quantity"])), ["l_quantity"]).select(*KEY, "l_quantity")
SQL["ML_5_imputation"] = "select l_orderkey, l_linenumber, case when l_linenumber in (2, 3) then 0 else l_quantity::double end as l_quantity from lineitem"


def ml6(s, d):
    train = lines(s, d).filter("l_returnflag <> 'N'")
    model = M.OneHot(["l_returnflag", "l_linestatus"]).fit(train)
    return model.transform(lines(s, d)).select(*KEY, *model.feature_names())


QUERIES["ML_6_one_hot"] = ml6
SQL["ML_6_one_hot"] = """select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1 else 0 end as "l_returnflag_R" , case when l_linestatus = 'O' then 1 else 0 end as "l_linestatus_O" from lineitem"""
PCTS = {"p1": 0.01, "p5": 0.05, "p10": 0.10, "p99": 0.99}
QUERIES["ML_13_threshold_calibration"] = lambda s, d: T.calibrate(lines(s, d), "l_extendedprice", PCTS).select("policy", F.round("value", 6).alias("value"))
SQL["ML_13_threshold_calibration"] = " union all ".join(f"select '{n}' as policy, round(quantile_cont(l_extendedprice::double, {p}), 6) as value from lineitem" for n, p in PCTS.items()) + " union all select 'zero', 0"


def with_policy(policy):
    def run(s, d):
        found = T.as_dict(T.calibrate(lines(s, d), "l_extendedprice", PCTS))
        return lines(s, d).select(*KEY, T.low_flag(F.col("l_extendedprice"), T.pick(found, policy)).alias("flag"))
    return run


QUERIES["ML_14_threshold_policy"] = with_policy("p10")
SQL["ML_14_threshold_policy"] = "select l_orderkey, l_linenumber, l_extendedprice::double < (select quantile_cont(l_extendedprice::double, 0.10) from lineitem) as flag from lineitem"


def flags(s, d):
    found = T.as_dict(T.calibrate(lines(s, d), "l_extendedprice", PCTS))
    return lines(s, d).withColumns({"isof_anomaly": T.low_flag(F.col("l_extendedprice"), found["p5"]), "ae_anomaly": T.high_flag(F.col("l_extendedprice") * F.col("l_quantity"), 100_000.0)})


FL = "with f as (select l_orderkey, l_linenumber, l_extendedprice::double < (select quantile_cont(l_extendedprice::double, 0.05) from lineitem) as isof_anomaly, l_extendedprice::double * l_quantity::double > 100000 as ae_anomaly from lineitem)"
QUERIES["ML_15_flags"] = lambda s, d: flags(s, d).select(*KEY, "isof_anomaly", "ae_anomaly")
SQL["ML_15_flags"] = FL + " select * from f"
QUERIES["ML_16_ensemble"] = lambda s, d: flags(s, d).select(*KEY, T.ensemble().alias("is_anomaly"), T.consensus().alias("both"))
SQL["ML_16_ensemble"] = FL + ' select l_orderkey, l_linenumber, isof_anomaly or ae_anomaly as is_anomaly, isof_anomaly and ae_anomaly as "both" from f'
SWEEP = {"offset": 20000.0, "five": 30000.0, "one": 5000.0, "zero": 0.0}
QUERIES["ML_17_threshold_sweep"] = lambda s, d: E.threshold_sweep(lines(s, d), "l_extendedprice", SWEEP)
SQL["ML_17_threshold_sweep"] = " union all ".join(f"select count(*) as total, '{n}' as policy, count(*) filter (l_extendedprice::double <= {t}) as flagged from lineitem" for n, t in SWEEP.items())


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


QUERIES["ML_19_reconstruction_attribution"] = lambda s, d: M.error_attribution(
    vectors(s, d).withColumn("r", F.transform("x", lambda v: F.round(v, 1))), "x", "r", top_n=5).select("vec_id", F.posexplode("top_features").alias("rank", "e")).select(
    "vec_id", "rank", F.col("e.position").alias("feature"), F.round("e.error", 9).alias("error"), F.round("e.percent", 6).alias("percent"))
SQL["ML_19_reconstruction_attribution"] = """with e as (select vec_id, i - 1 as feature, (v - round(v, 1)) * (v - round(v, 1)) as err from (select vec_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as v from embeddings)),
t as (select *, sum(err) over (partition by vec_id) as tot, row_number() over (partition by vec_id order by err desc, feature) - 1 as rank from e)
select vec_id, rank, feature, round(err, 9) as error, round(err / tot * 100, 6) as percent from t where rank < 5"""


def importances(s, d):
    long = vectors(s, d).select("label", F.posexplode("x").alias("feature", "v"))
    return [long.filter(F.col("label") % 2 == k).groupBy("feature").agg(F.round(F.avg(F.abs("v")), 9).alias("importance")) for k in (0, 1)]


QUERIES["ML_21_importance_overlap"] = lambda s, d: M.importance_overlap(*importances(s, d), top=20)
IMP = """with l as (select label % 2 as k, unnest(range(1, len(embedding) + 1)) - 1 as feature, unnest(embedding)::double as v from embeddings), i as (select k, feature, round(avg(abs(v)), 9) as m from l group by 1, 2),
r as (select *, row_number() over (partition by k order by m desc, feature) as r from i), a as (select feature from r where k = 0 and r <= 20), b as (select feature from r where k = 1 and r <= 20)"""
SQL["ML_21_importance_overlap"] = IMP + " select coalesce(a.feature, b.feature) as feature, case when b.feature is null then 'only_first' when a.feature is null then 'only_second' else 'common' end as part from a full join b on a.feature = b.feature"
QUERIES["JON_7_feature_overlap"] = lambda s, d: M.importance_overlap(*importances(s, d), top=10)
SQL["JON_7_feature_overlap"] = SQL["ML_21_importance_overlap"].replace("r <= 20", "r <= 10")


def judged_rows(s, d):
    rows = judged(s, d).join(table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("group")), "doc_id")
    return rows.select("group", "y", F.col("score").alias("isof_score"), (F.col("quality") * -1.0).alias("ae_error"), F.col("iso").alias("isof"), "ae", "ensemble")


QUERIES["AGG_16b_rates_by_file"] = lambda s, d: V.rates(judged_rows(s, d)).withColumn("rate", F.round("rate", 6))
SQL["AGG_16b_rates_by_file"] = J + ", g as (select coalesce(source, '') as \"group\", j.* from j join documents using (doc_id))" + " union all ".join(
    f" select \"group\", '{m}' as model, count(*) as lines, sum({c})::bigint as alerts, round(avg({c}), 6) as rate from g group by 1" for m, c in (("isof", "iso"), ("ae", "ae"), ("ensemble", "ensemble")))
QUERIES["EVAL_6_confusion_of_models"] = lambda s, d: V.confusion_table(judged_rows(s, d)).withColumn("share", F.round("share", 6))
SQL["EVAL_6_confusion_of_models"] = J + " union all ".join(
    f" select '{m}' as model, y as truth, {c} as predicted, count(*) as n, round(count(*) / sum(count(*)) over (partition by y), 6) as share from j group by 2, 3" for m, c in (("isof", "iso"), ("ae", "ae"), ("ensemble", "ensemble")))
