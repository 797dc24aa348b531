"""Projections, cleaning, DNS text features and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.fixtures import ctes, view
from flowlens.functions import conn as C
from flowlens.functions import dns as D
from flowlens.functions import times
from flowlens.operators import clean, filters
from checks.windows import r6

QUERIES, SQL = {}, {}

# Untidy text columns derived from every connection.
DIRTY = """select uid, case orig_p % 5 when 0 then '-' when 1 then concat('-', orig_bytes) when 2 then concat(orig_bytes, '.75') when 3 then 'x' else concat(orig_bytes, '') end as orig_bytes,
 case orig_p % 4 when 0 then '-' when 1 then 'bad' else concat(orig_pkts, '.5') end as duration,
 case orig_p % 6 when 0 then '-' when 1 then '' when 2 then 'None' when 3 then 'nan' when 4 then proto end as proto,
 case orig_p % 7 when 0 then 'T' when 1 then 'true' when 2 then '1' when 3 then 'F' when 4 then '-' when 5 then 'yes' end as local_orig,
 concat(resp_p, '') as resp_p, ts_us from conn"""


def dirty(s, d):
    view(s, d, "conn").createOrReplaceTempView("conn")
    return s.sql(DIRTY)


def dsql(select):
    return ctes("conn") + f", dirty as ({DIRTY}) {select}"


def on(name, cols):
    return lambda s, d: view(s, d, name).select("uid", *[c.alias(n) for n, c in cols().items()])


def prj1(s, d):
    out = clean.align_schema(view(s, d, "conn").drop("proto", "service", "tunnel_parents"))
    return out.select("uid", "orig_h", "proto", "service", "tunnel_parents", "local_orig", "ts", "orig_bytes")


QUERIES["PRJ_1_schema_align"] = prj1
SQL["PRJ_1_schema_align"] = ctes("conn") + """select uid, orig_h, 'unknown' as proto, 'unknown' as service, 'none' as tunnel_parents, false as local_orig, 0 as ts, orig_bytes from conn"""
QUERIES["PRJ_2_numeric_coerce"] = lambda s, d: clean.numeric_columns(dirty(s, d)).select("uid", "orig_bytes", "duration", "resp_p")
SQL["PRJ_2_numeric_coerce"] = dsql("""select uid, abs(coalesce(cast(trunc(try_cast(orig_bytes as double)) as bigint), 0)) as orig_bytes, coalesce(try_cast(duration as double), 0) as duration,
 cast(resp_p as bigint) as resp_p from dirty""")
QUERIES["PRJ_3_categorical_coerce"] = lambda s, d: clean.category_columns(dirty(s, d)).select("uid", "proto")
SQL["PRJ_3_categorical_coerce"] = dsql("select uid, case when proto is null or proto in ('-', 'nan', 'None', '') then 'unknown' else proto end as proto from dirty")
QUERIES["PRJ_4_boolean_coerce"] = lambda s, d: clean.boolean_columns(dirty(s, d)).select("uid", "local_orig")
SQL["PRJ_4_boolean_coerce"] = dsql("select uid, coalesce(lower(local_orig) in ('t', 'true', '1'), false) as local_orig from dirty")
QUERIES["PRJ_5_serve_cast"] = lambda s, d: clean.cast_conn(dirty(s, d).withColumn("ts", (F.col("ts_us") / 1e6).cast("string")).drop("ts_us")).select("uid", "orig_bytes", "proto", "local_orig", r6("duration")[0])
SQL["PRJ_5_serve_cast"] = dsql("""select uid, coalesce(cast(trunc(try_cast(orig_bytes as double)) as bigint), 0) as orig_bytes, case when proto = '-' then '' else proto end as proto,
 coalesce(lower(local_orig) in ('t', 'true', '1'), false) as local_orig, round(coalesce(try_cast(duration as double), 0), 6) as duration from dirty""")
QUERIES["PRJ_6_extra_features"] = lambda s, d: clean.coerce_numeric(dirty(s, d), ["orig_bytes", "duration"]).select("uid", "orig_bytes_num", "duration_num")
SQL["PRJ_6_extra_features"] = dsql("""select uid, case when orig_bytes like '%.%' then try_cast(orig_bytes as double) else try_cast(orig_bytes as bigint)::double end as orig_bytes_num,
 case when duration like '%.%' then try_cast(duration as double) else try_cast(duration as bigint)::double end as duration_num from dirty""")
QUERIES["PRJ_7_empty_row_drop"] = lambda s, d: clean.drop_empty_rows(dirty(s, d).selectExpr("nullif(proto, '-') as proto", "local_orig", "case when duration <> '-' then uid end as uid"))
SQL["PRJ_7_empty_row_drop"] = dsql("""select * from (select nullif(proto, '-') as proto, local_orig, case when duration <> '-' then uid end as uid from dirty)
 where proto is not null or local_orig is not null or uid is not null""")
QUERIES["PRJ_8_service_inference"] = on("conn", lambda: {"service": C.infer_service()})
SQL["PRJ_8_service_inference"] = ctes("conn") + """select uid, case proto when 'icmp' then 'icmp' when 'tcp' then case
 when resp_p in (80, 8080) then 'http' when resp_p in (443, 8443) then 'https' when resp_p = 22 then 'ssh' when resp_p = 21 then 'ftp' when resp_p = 25 then 'smtp'
 when resp_p = 110 then 'pop3' when resp_p = 143 then 'imap' when resp_p = 53 then 'dns' when resp_p = 23 then 'telnet'
 when resp_p <= 1023 then 'well_known_tcp' else 'dynamic_tcp' end when 'udp' then case when resp_p = 53 then 'dns' when resp_p in (67, 68) then 'dhcp'
 when resp_p = 123 then 'ntp' when resp_p in (161, 162) then 'snmp' when resp_p <= 1023 then 'well_known_udp' else 'dynamic_udp' end else 'unknown' end as service from conn"""
QUERIES["PRJ_9_history_features"] = on("conn", C.history_features)
SQL["PRJ_9_history_features"] = ctes("conn") + """select uid, length(history) as hist_len, len(regexp_extract_all(history, '[Rr]')) as hist_R_count,
 case when regexp_matches(history, '[Tt]') then 1 else 0 end as "hist_has_T" from conn"""
QUERIES["PRJ_10_failed_flag"] = on("conn", lambda: {"is_failed_connection": C.failed_connection()})
SQL["PRJ_10_failed_flag"] = ctes("conn") + "select uid, case when conn_state in ('REJ','S0','RSTO','RSTR','RSTOS0','RSTRH','SH','SHR') then 1 else 0 end as is_failed_connection from conn"
QUERIES["PRJ_11_tunneled_flag"] = on("conn", lambda: {"is_tunneled_connection": C.tunneled_connection()})
SQL["PRJ_11_tunneled_flag"] = ctes("conn") + "select uid, case when tunnel_parents not in ('', '-', 'none') then 1 else 0 end as is_tunneled_connection from conn"
QUERIES["PRJ_12_port_bins"] = on("conn", lambda: {"orig_port_binned": C.port_bin("orig_p"), "resp_port_binned": C.port_bin("resp_p")})
BIN = "case when {p} is null or {p} <= 1023 then 'low' when {p} <= 49151 then 'medium' when {p} <= 65535 then 'high' else 'very_high' end"
SQL["PRJ_12_port_bins"] = ctes("conn") + f"select uid, {BIN.format(p='orig_p')} as orig_port_binned, {BIN.format(p='resp_p')} as resp_port_binned from conn"


def top_services(s, d):
    from flowlens.operators.tallies import top_services as top
    conn = view(s, d, "conn").withColumn("service", C.infer_service())
    return conn, [r["service"] for r in top(conn).orderBy("rank").collect()]


def prj13(s, d):
    conn, names = top_services(s, d)
    return conn.select("uid", C.service_bin(names).alias("service_binned"))


INFERRED = SQL["PRJ_8_service_inference"].removeprefix(ctes("conn"))
QUERIES["PRJ_13_service_bins"] = prj13
SQL["PRJ_13_service_bins"] = ctes("conn") + f""", sv as ({INFERRED}),
top as (select service, row_number() over (order by count(*) desc, service) as r from sv group by service)
select uid, case when service = 'unknown' then 'rare' when r <= 5 then 'common' when r <= 15 then 'uncommon' else 'rare' end as service_binned from sv join top using (service)"""

# Addresses from every class, one per connection.
ADDRESS = """case orig_p % 10 when 0 then orig_h when 1 then resp_h when 2 then concat('172.', orig_p % 40, '.0.1') when 3 then '127.0.0.1' when 4 then concat('8.8.', orig_p % 250, '.8')
 when 5 then 'fe80::1' when 6 then concat('169.', 250 + orig_p % 6, '.1.1') when 7 then '2606:4700::1111' when 8 then 'fd00::1' else 'not an address' end"""
QUERIES["PRJ_14_private_address"] = lambda s, d: view(s, d, "conn").withColumn("address", F.expr(ADDRESS)).select("uid", "address", C.private_ip(F.col("address")).alias("is_private"))
SQL["PRJ_14_private_address"] = ctes("conn") + f"""select uid, address, address like '10.%' or address like '192.168.%' or address like '127.%' or address like '169.254.%' or address in ('fe80::1', 'fd00::1')
 or (address like '172.%' and try_cast(split_part(address, '.', 2) as int) between 16 and 31) as is_private
 from (select uid, {ADDRESS} as address from conn)"""

LINE = "concat(uid, ' ', orig_h, ':', orig_p, ' ', resp_h, ':', resp_p, ' ', proto, ' ', conn_state, ' ', history)"
DLINE = "concat(uid, ' ', query, ' ', qtype_name, ' ', rcode_name)"


def hits(line, tokens, weight):
    return " + ".join(f"case when contains({line}, '{t}') then {weight} else 0 end" for t in tokens)


QUERIES["PRJ_15_triage_score"] = lambda s, d: view(s, d, "conn").select("uid", C.triage_score(F.expr(LINE), "conn").alias("score")).unionByName(
    view(s, d, "dns").select("uid", C.triage_score(F.expr(DLINE), "dns").alias("score")))
SQL["PRJ_15_triage_score"] = ctes("conn", "dns") + f"""
select uid, least(100, {hits('l', C.CRITICAL_TOKENS, 25)} + {hits('l', C.SUSPICIOUS_TOKENS, 10)} + {hits('l', C.NORMAL_TOKENS, 1)}
 + case when contains(l, ':22') or contains(l, ':23') or contains(l, ':3389') then 15 when contains(l, ':80') or contains(l, ':443') then 5 else 0 end) as score
 from (select uid, {LINE} as l from conn)
union all select uid, least(100, {hits('l', C.COVERT_RECORDS, 30)} + {hits('l', C.COMMON_RECORDS, 2)}
 + case when contains(lower(l), 'dga') or contains(lower(l), 'tunnel') then 25 else 0 end) from (select uid, {DLINE} as l from dns)"""
QUERIES["PRJ_16_alert_id"] = lambda s, d: view(s, d, "alerts").select("alert_id", C.alert_id(
    F.col("ts_us"), F.col("src_ip"), F.col("dst_ip"), F.col("dst_port"), F.col("isof_anomaly"), F.col("ae_anomaly")).alias("digest"))
SQL["PRJ_16_alert_id"] = ctes("alerts") + "select alert_id, substr(md5(concat_ws('_', ts_us, src_ip, dst_ip, dst_port, isof_anomaly, ae_anomaly)), 1, 12) as digest from alerts"
LABEL = "case event_id % 7 when 0 then 'BENIGN' when 1 then 'Attack' when 2 then 'PortScan' when 3 then 'unknown' when 4 then 'C&C' when 5 then 'weird' else 'DDoS' end"
QUERIES["PRJ_18_label_normalise"] = lambda s, d: s.read.parquet(f"{d}/events.parquet").withColumn("label", F.expr(LABEL)).select("event_id", C.normal_label(F.col("label")).alias("is_attack"))
SQL["PRJ_18_label_normalise"] = f"select event_id, case when {LABEL} in ('Attack', 'PortScan', 'C&C', 'DDoS') then 1 else 0 end as is_attack from events"
STAMP = """case ts_us % 4 when 0 then concat(cast(ts_us {div} 1000000 as varchar(20)), '') when 1 then concat('2024-01-0', 1 + ts_us % 7, 'T05:06:07Z') when 2 then concat('2024-01-0', 1 + ts_us % 7, 'T05:06:07.250+02:00')
 else 'soon' end"""
QUERIES["PRJ_19_time_parse"] = lambda s, d: view(s, d, "alerts").withColumn("stamp", F.expr(STAMP.format(div="div"))).select(
    "alert_id", F.unix_micros(times.parse_time(F.col("stamp"))).alias("parsed_us"))
SQL["PRJ_19_time_parse"] = ctes("alerts") + f"""select alert_id, case when regexp_matches(stamp, '^[0-9]+$') then cast(stamp as bigint) * 1000000 else epoch_us(try_cast(stamp as timestamptz)) end as parsed_us
 from (select alert_id, {STAMP.format(div='//')} as stamp from alerts)"""
SPAN = "case orig_p % 7 when 0 then 0 when 1 then 250000 when 2 then orig_bytes * 1000 when 3 then orig_bytes * 100000 when 4 then orig_bytes * 10000000 when 5 then orig_bytes * 100000000 else -1500000 end"
QUERIES["PRJ_20_duration_text"] = lambda s, d: view(s, d, "conn").withColumn("span", F.expr(SPAN)).select(
    "uid", times.duration_text(F.col("ts_us"), F.col("ts_us") + F.col("span")).alias("text"))
SQL["PRJ_20_duration_text"] = ctes("conn") + f"""select uid, case when u = 0 then '0 seconds (simultaneous events)' when u < 0 then concat('Invalid duration (', format('{{:.3f}}', u / 1e6), 's - negative)')
 when u < 1000000 then concat(u // 1000, ' milliseconds') when u < 60000000 then concat((u + 50000) // 1000000, '.', (u + 50000) // 100000 % 10, ' seconds')
 when u < 3600000000 then concat(u // 60000000, 'm ', u // 1000000 % 60, 's') when u < 86400000000 then concat(u // 3600000000, 'h ', u // 60000000 % 60, 'm')
 else concat(u // 86400000000, 'd ', u // 3600000000 % 24, 'h') end as text from (select uid, {SPAN} as u from conn)"""
NOW = 1704067200000000 + 20 * 3600 * 300_000
QUERIES["PRJ_21_time_quality"] = lambda s, d: clean.time_quality(view(s, d, "conn"), now_us=F.lit(NOW)).groupBy("future_ts").agg(
    F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
SQL["PRJ_21_time_quality"] = ctes("conn") + f"select ts_us > {NOW} as future_ts, count(*) as n, min(ts_us) as first_us, max(ts_us) as last_us from conn group by 1"
EV = ["orig_bytes", "duration", "proto", "resp_p"]
QUERIES["PRJ_22_evidence"] = lambda s, d: dirty(s, d).withColumn("e", C.evidence(EV)).select("uid", *[F.round(F.col("e")[n], 6).alias(n) for n in EV])
SQL["PRJ_22_evidence"] = dsql("""select uid, round(coalesce(try_cast(orig_bytes as double), 0), 6) as orig_bytes, round(coalesce(try_cast(duration as double), 0), 6) as duration, 0 as proto,
 cast(resp_p as double) as resp_p from (select * replace (nullif(orig_bytes, 'nan') as orig_bytes) from dirty)""")

# --- DNS -----------------------------------------------------------------------
DNS_SQL = {
    "DNS_1_length": ("query_length", "length(query)"),
    "DNS_2_subdomains": ("subdomain_count", "length(query) - length(replace(query, '.', ''))"),
    "DNS_4_numeric_ratio": ("numeric_ratio", "round(len(regexp_extract_all(query, '[0-9]')) / length(query), 6)"),
    "DNS_6_base64": ("has_base64_pattern", "case when regexp_matches(lower(query), '[a-zA-Z0-9+/]{20,}') then 1 else 0 end"),
    "DNS_7_hex": ("has_hex_pattern", "case when regexp_matches(lower(query), '[0-9a-f]{16,}') then 1 else 0 end"),
    "DNS_8_long_label": ("has_long_subdomain", "case when list_max(list_transform(string_split(query, '.'), lambda x: length(x))) > 20 then 1 else 0 end"),
    "DNS_9_suspicious_length": ("suspicious_length", "case when length(query) > 50 then 1 else 0 end"),
    "DNS_10_char_diversity": ("char_diversity", "round(len(list_distinct(string_split(replace(lower(query), '.', ''), ''))) / length(replace(query, '.', '')), 6)"),
    "DNS_11_vowel_consonant": ("vowel_consonant_ratio", "round(case when len(regexp_extract_all(lower(query), '[a-z]')) > len(regexp_extract_all(lower(query), '[aeiou]')) then least(10, len(regexp_extract_all(lower(query), '[aeiou]')) / (len(regexp_extract_all(lower(query), '[a-z]')) - len(regexp_extract_all(lower(query), '[aeiou]')))) else 0 end, 6)"),
    "DNS_12_repeats": ("compressed_pattern", "case when " + " or ".join(f"contains(lower(query), repeat('{c}', 4))" for c in "abcdefghijklmnopqrstuvwxyz0123456789") + " then 1 else 0 end"),
    "DNS_13_unusual_tld": ("unusual_tld", "case when " + " or ".join(f"contains(lower(query), '{t}')" for t in D.UNUSUAL_TLDS) + " then 1 else 0 end"),
}
for key, (name, expr) in DNS_SQL.items():
    QUERIES[key] = (lambda n: lambda s, d: view(s, d, "dns").select("uid", (F.round(D.dns_columns()[n], 6) if n in ("numeric_ratio", "char_diversity", "vowel_consonant_ratio") else D.dns_columns()[n]).alias(n)))(name)
    SQL[key] = ctes("dns") + f"select uid, {expr} as {name} from dns"
QUERIES["DNS_3_entropy"] = lambda s, d: view(s, d, "dns").select("uid", F.round(D.entropy(F.col("query")), 6).alias("query_entropy"))
SQL["DNS_3_entropy"] = ctes("dns") + """, ch as (select uid, length(query) as n, unnest(string_split(query, '')) as c from dns), pc as (select uid, n, c, count(*) / n as p from ch group by uid, n, c)
select uid, round(-sum(p * log2(p)), 6) as query_entropy from pc group by uid"""


def gram_case(weights):
    return "case g " + " ".join(f"when '{g}' then {w}" for g, w in weights.items()) + " else 0 end"


QUERIES["DNS_5_ngram_score"] = lambda s, d: view(s, d, "dns").select("uid", F.round(D.ngram_score(F.col("query")), 6).alias("ngram_score"))
SQL["DNS_5_ngram_score"] = ctes("dns") + f""", b as (select uid, regexp_replace(lower(query), '\\.[^.]*$', '') as t from dns),
bi as (select uid, sum({gram_case(D.BIGRAMS)}) / (count(*) * 100) as s from (select uid, substr(t, unnest(range(1, length(t))), 2) as g from b) group by uid),
tri as (select uid, sum({gram_case(D.TRIGRAMS)}) / (count(*) * 100) as s from (select uid, substr(t, unnest(range(1, length(t) - 1)), 3) as g from b) group by uid)
select uid, round(least(1, 0.3 * coalesce(bi.s, 0) + 0.7 * coalesce(tri.s, 0)), 6) as ngram_score from b left join bi using (uid) left join tri using (uid)"""
TTL = "case when ts_us % 7 = 0 then '' when ts_us % 7 = 1 then '60, x' when ts_us % 7 = 2 then '30,-, 90' else \"TTLs\" end"
QUERIES["DNS_14_ttl"] = lambda s, d: view(s, d, "dns").withColumn("TTLs", F.expr(TTL.replace('"', "`"))).select(
    "uid", F.round(D.avg_ttl(F.col("TTLs")), 6).alias("avg_ttl"), D.min_ttl(F.col("TTLs")).alias("min_ttl"))
SQL["DNS_14_ttl"] = ctes("dns") + f""", t as (select uid, list_filter(list_transform(string_split({TTL}, ','), lambda x: trim(x)), lambda x: x not in ('', '-')) as p from dns),
n as (select uid, len(p) as k, list_transform(p, lambda x: try_cast(x as double)) as v from t)
select uid, case when k = 0 or len(list_filter(v, lambda x: x is null)) > 0 then 300 else round(list_avg(v), 6) end as avg_ttl,
 case when k = 0 or len(list_filter(v, lambda x: x is null)) > 0 then 300 else list_min(v) end as min_ttl from n"""
QUERIES["DNS_15_type_flags"] = lambda s, d: view(s, d, "dns").select("uid", *[D.dns_columns()[n].alias(n) for n in ("is_qtype_txt", "is_qtype_null", "is_nxdomain")])
SQL["DNS_15_type_flags"] = ctes("dns") + """select uid, case when qtype_name = 'TXT' then 1 else 0 end as is_qtype_txt, case when qtype_name = 'NULL' then 1 else 0 end as is_qtype_null,
 case when rcode_name = 'NXDOMAIN' then 1 else 0 end as is_nxdomain from dns"""
QUERIES["DNS_16_missing_columns"] = lambda s, d: D.dns_features(view(s, d, "dns").drop("TTLs", "rcode_name").withColumn(
    "query", F.expr("case when ts_us % 5 = 0 then null when ts_us % 5 = 1 then '' else query end"))).select("uid", "query_length", "subdomain_count", "has_hex_pattern", "avg_ttl", "is_nxdomain", *r6("numeric_ratio"))
SQL["DNS_16_missing_columns"] = ctes("dns") + """, q as (select uid, case when ts_us % 5 = 0 then null when ts_us % 5 = 1 then '' else query end as query from dns)
select uid, coalesce(length(query), 0) as query_length, coalesce(length(query) - length(replace(query, '.', '')), 0) as subdomain_count,
 case when regexp_matches(lower(query), '[0-9a-f]{16,}') then 1 else 0 end as has_hex_pattern, 300 as avg_ttl, 0 as is_nxdomain,
 case when length(query) > 0 then round(len(regexp_extract_all(query, '[0-9]')) / length(query), 6) else 0 end as numeric_ratio from q"""

# --- filters ---------------------------------------------------------------------
NOISY = """select uid, proto, case orig_p % 9 when 0 then '127.0.0.1' when 1 then 'fe80::9' when 2 then '192.168.1.7' else orig_h end as orig_h,
 case orig_p % 11 when 0 then '224.0.0.251' when 1 then '239.255.255.250' when 2 then '10.0.0.3' when 3 then '::1' else resp_h end as resp_h,
 case orig_p % 6 when 0 then 5353 when 1 then 68 else orig_p end as orig_p, case orig_p % 12 when 1 then 67 else resp_p end as resp_p from conn"""


def noisy(s, d):
    view(s, d, "conn").createOrReplaceTempView("conn")
    return s.sql(NOISY)


QUERIES["FLT_1_conn_veto"] = lambda s, d: filters.drop_noise_conn(noisy(s, d), monitored_host="10.0.0.5").select("uid", "orig_h", "resp_h", "resp_p")
SQL["FLT_1_conn_veto"] = ctes("conn") + f""", n as ({NOISY}) select uid, orig_h, resp_h, resp_p from n where not (orig_h in ('127.0.0.1', '::1') or resp_h in ('127.0.0.1', '::1')
 or orig_h like 'fe80::%' or resp_h like 'fe80::%' or orig_h like 'ff02::%' or resp_h like 'ff02::%' or resp_h like '224.0.0.%' or resp_h like '239.255.255.%'
 or (proto = 'udp' and resp_p in (67, 68, 123)) or (((orig_h like '192.168.%' and resp_h like '192.168.%') or (orig_h like '172.16.%' and resp_h like '172.16.%')
 or (orig_h like '10.%' and resp_h like '10.%')) and resp_p in (137, 138, 139, 445)) or (orig_h = '10.0.0.5' and resp_p = 53))"""
NOISY_DNS = """select uid, case ts_us % 9 when 0 then '::1' when 1 then 'fe80:1' else orig_h end as orig_h,
 case ts_us % 7 when 0 then '224.0.0.252' when 1 then 'ff02::1:2' when 2 then '224.9.9.9' else resp_h end as resp_h,
 case ts_us % 5 when 0 then '*' when 1 then concat('Desktop-', uid) else query end as query from dns"""


def noisy_dns(s, d):
    view(s, d, "dns").createOrReplaceTempView("dns")
    return s.sql(NOISY_DNS)


QUERIES["FLT_2_dns_noise"] = lambda s, d: filters.drop_noise_dns(noisy_dns(s, d))
SQL["FLT_2_dns_noise"] = ctes("dns") + f""", n as ({NOISY_DNS}) select * from n where not (resp_h like '224.%' or resp_h like 'fe80:%' or orig_h like 'fe80:%' or resp_h like 'ff02:%' or orig_h like 'ff02:%'
 or resp_h in ('127.0.0.1', '::1') or orig_h in ('127.0.0.1', '::1') or regexp_matches(lower(query), '^(desktop|laptop|pc|workstation|server)-[a-zA-Z0-9]+$') or trim(query) = '*')"""
QUERIES["FLT_3_chatter"] = lambda s, d: filters.drop_chatter(noisy(s, d)).select("uid", "proto", "orig_p", "resp_p")
SQL["FLT_3_chatter"] = ctes("conn") + f""", n as ({NOISY}) select uid, proto, orig_p, resp_p from n where not ((proto = 'udp' and (resp_p in (5353, 5355, 1900, 123) or orig_p in (5353, 5355, 1900, 123)
 or (orig_p = 68 and resp_p = 67))) or proto = 'icmp')"""
BLANKED = "select uid, case when orig_pkts % 3 = 0 then '  ' when orig_pkts % 5 = 0 then '' else concat(uid, ' ', orig_h) end as value from conn"


def blanked(s, d):
    view(s, d, "conn").createOrReplaceTempView("conn")
    return s.sql(BLANKED)


QUERIES["FLT_4_empty_lines"] = lambda s, d: filters.drop_empty_lines(blanked(s, d))
SQL["FLT_4_empty_lines"] = ctes("conn") + f"select * from ({BLANKED}) where trim(value) <> ''"
ENVELOPED = """select uid, case orig_pkts % 5 when 0 then '' when 1 then concat('{"pipeline":"conn","m":"', uid, '"}') when 2 then concat('{"log":{"file":{"path":"/var/CONN.log"}},"m":"', uid, '"}')
 when 3 then concat('{"m":"', uid, '"}') else uid end as value from conn"""


def enveloped(s, d):
    view(s, d, "conn").createOrReplaceTempView("conn")
    return s.sql(ENVELOPED)


QUERIES["FLT_5_line_acceptance"] = lambda s, d: enveloped(s, d).select("uid", filters.accepted_reason(F.col("value"), "conn").alias("reason"))
SQL["FLT_5_line_acceptance"] = ctes("conn") + "select uid, case orig_pkts % 5 when 0 then 'empty' when 1 then 'source' when 2 then 'source' when 3 then 'json' else 'other' end as reason from conn"
QUERIES["FLT_6_anomaly_gate"] = lambda s, d: filters.anomalies(view(s, d, "alerts")).select("alert_id")
SQL["FLT_6_anomaly_gate"] = ctes("alerts") + "select alert_id from alerts where isof_anomaly or ae_anomaly"
QUERIES["FLT_10_untimed_rows"] = lambda s, d: clean.drop_untimed(view(s, d, "conn").selectExpr("uid", "case when orig_pkts % 4 > 0 then ts_us end as ts"))
SQL["FLT_10_untimed_rows"] = ctes("conn") + "select uid, ts_us as ts from conn where orig_pkts % 4 > 0"
QUERIES["DED_1_line_dedup"] = lambda s, d: filters.dedup_lines(view(s, d, "conn").select(F.concat_ws(" ", "orig_h", "resp_h", "resp_p", "proto").alias("value")))
SQL["DED_1_line_dedup"] = ctes("conn") + "select distinct concat_ws(' ', orig_h, resp_h, resp_p, proto) as value from conn"


def prj17(s, d):
    rows = view(s, d, "conn").withColumns({"hist_len": F.length("history"), "is_failed_connection": C.failed_connection()})
    return C.require(rows, ["hist_len", "is_failed_connection"]).select("uid", "hist_len", "is_failed_connection")


QUERIES["PRJ_17_required_columns"] = prj17
SQL["PRJ_17_required_columns"] = ctes("conn") + "select uid, length(history) as hist_len, case when conn_state in ('REJ','S0','RSTO','RSTR','RSTOS0','RSTRH','SH','SHR') then 1 else 0 end as is_failed_connection from conn"
