"""Log-shaped views over the generic test tables, for checks and benchmarks.

Each view has a Spark form and a DuckDB form of the same SELECT; only the two
dialect macros differ. Event time is compressed a hundredfold so that 300 s
windows hold several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WINDOW_US = 300_000_000

_MACROS = {
    "spark": {
        "TS_US": "1704067200000000 + (unix_micros(cast(ts as timestamp)) - 1704067200000000) div 100",
        "K": "cast(get_json_object(props, '$.k') as bigint)",
        "HOST": "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))",
    },
    "duckdb": {
        "TS_US": "1704067200000000 + (epoch_us(ts) - 1704067200000000) // 100",
        "K": "cast(json_extract_string(props, '$.k') as bigint)",
        "HOST": "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))",
    },
}

_CONN = """
select ts_us, concat('C', event_id) as uid,
  concat('10.0.0.', user_id % 20) as orig_h,
  40000 + event_id % 20000 as orig_p,
  concat('192.168.1.', k % 40) as resp_h,
  case k % 8 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 53
    when 4 then 3389 when 5 then 445 when 6 then 123 else 1024 + event_id % 500 end as resp_p,
  case when k % 8 in (3, 6) then 'udp' when k % 17 = 0 then 'icmp' else 'tcp' end as proto,
  case k % 5 when 0 then 'http' when 1 then 'dns' when 2 then '-' else '' end as service,
  case event_type when 'error' then 'REJ' when 'signup' then 'S0'
    when 'purchase' then 'RSTO' else 'SF' end as conn_state,
  case event_type when 'error' then 'Sr' when 'signup' then 'S'
    when 'purchase' then 'ShADadR' when 'view' then 'ShADadfFT' else '' end as history,
  value / 10e0 as duration,
  cast(floor(value * 100) as bigint) as orig_bytes,
  cast(floor(value * 37) as bigint) as resp_bytes,
  k % 3 as missed_bytes, k as orig_pkts, k + 1 as resp_pkts,
  cast(floor(value * 101) as bigint) as orig_ip_bytes,
  cast(floor(value * 39) as bigint) as resp_ip_bytes,
  case when k % 13 = 0 then concat('T', k) when k % 7 = 0 then '-' else '' end as tunnel_parents
from (select event_id, user_id, event_type, value, {TS_US} as ts_us, {K} as k from events) e
"""

_DNS = """
select ts_us, concat('D', event_id) as uid,
  concat('10.0.0.', user_id % 20) as orig_h, '10.0.0.53' as resp_h, 53 as resp_p, 'udp' as proto,
  case event_id % 6
    when 0 then concat(h, '.', host)
    when 1 then concat(substr(h, 1, 12), '.', substr(h, 13, 12), '.tk')
    when 2 then concat('aaaa', substr(h, 1, 4), '.', host)
    when 3 then concat(h, h, '.x.', host)
    else host end as query,
  case event_type when 'signup' then 'TXT' when 'purchase' then 'NULL'
    when 'click' then 'AAAA' when 'error' then 'MX' else 'A' end as qtype_name,
  case when k % 9 = 0 then 'NXDOMAIN' else 'NOERROR' end as rcode_name,
  case when k % 11 = 0 then '-' else concat(k, ',', k * 3) end as TTLs,
  event_type in ('error', 'purchase', 'view') as isof_anomaly, k % 3 = 0 as ae_anomaly
from (select event_id, user_id, event_type, {TS_US} as ts_us, {K} as k,
        event_id % (select count(*) from pages) as page_id from events) e
join (select page_id, {HOST} as host, md5(url) as h from pages) p using (page_id)
"""

_ALERTS = """
select concat('A', event_id) as alert_id, ts_us,
  concat('10.0.0.', user_id % 20) as src_ip,
  concat('192.168.1.', k % 40) as dst_ip, 1 + k % 50 as dst_port,
  case when k % 17 = 0 then 'icmp' when k % 8 in (3, 6) then 'udp' else 'tcp' end as proto,
  case k % 4 when 0 then 'http' when 1 then 'dns' else 'ssh' end as service,
  case event_type when 'error' then 'REJ' when 'signup' then 'S0'
    when 'purchase' then 'RSTO' else 'SF' end as conn_state,
  case k % 6 when 0 then 'Vertical Port Scan' when 1 then 'C2 Beaconing'
    when 2 then 'DNS Tunneling Pattern' when 3 then 'Brute-Force Attack'
    when 4 then 'DNS DGA Attack Pattern' else 'General Behavioral Anomaly' end as matched_scenario,
  cast(case k % 6 when 2 then 0 when 5 then 3 else 1 end as int) as rule_priority,
  case when k % 6 in (2, 4) then 'behavior_anomaly' else 'ml_anomaly' end as type,
  case k % 6 when 2 then 'dns_tunneling' when 4 then 'dns_dga' else '' end as behavior_type,
  case k % 3 when 0 then 'High' when 1 then 'Medium' else 'Low' end as severity,
  case when k % 6 in (2, 4) then 'dns_engine' else 'connection_engine' end as source,
  case event_type when 'error' then 'IF' else 'AE' end as detector,
  event_type in ('error', 'purchase') as isof_anomaly, k % 3 = 0 as ae_anomaly,
  cast(40 + k % 60 as int) as risk_score, value as raw_score
from (select event_id, user_id, event_type, value, {TS_US} as ts_us, {K} as k from events) e
"""


def sql(view: str, dialect: str) -> str:
    text = {"conn": _CONN, "dns": _DNS, "alerts": _ALERTS}[view]
    for name, form in _MACROS[dialect].items():
        text = text.replace("{" + name + "}", form)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``conn``, ``dns``, ``alerts`` over the tables of ``sf_dir``."""
    text = sql(name, "spark")
    for source in ("events", "pages"):
        if f"from {source}" in text:
            table(spark, sf_dir, source).createOrReplaceTempView(f"flowlens_{source}")
            text = text.replace(f"from {source}", f"from flowlens_{source}")
    return spark.sql(text)


def ctes(*views: str) -> str:
    """``with`` clause that defines the views for DuckDB."""
    return "with recursive " + ", ".join(f"{v} as ({sql(v, 'duckdb')})" for v in views) + " "
