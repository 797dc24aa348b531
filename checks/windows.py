"""Sliding windows and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.fixtures import WINDOW_US as W
from flowlens.fixtures import ctes, view
from flowlens.operators import groups, profiles

QUERIES, SQL = {}, {}


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


QUERIES["WIN_1_profile_rate"] = lambda s, d: profiles.ip_profile(view(s, d, "conn"), window_us=W).select("uid", "ip_profile_uid_rate")
SQL["WIN_1_profile_rate"] = ctes("conn") + f"""
select uid, count(*) over (partition by orig_h order by ts_us range between {W} preceding and current row) as ip_profile_uid_rate from conn"""

QUERIES["WIN_2_profile_distinct"] = lambda s, d: profiles.ip_profile(view(s, d, "conn"), window_us=W).select(
    "uid", "ip_profile_resp_p_rate", "ip_profile_resp_h_rate", "ip_profile_conn_state_diversity")
SQL["WIN_2_profile_distinct"] = ctes("conn") + f"""
select uid, count(distinct resp_p) over w as ip_profile_resp_p_rate, count(distinct resp_h) over w as ip_profile_resp_h_rate,
 count(distinct conn_state) over w as ip_profile_conn_state_diversity
from conn window w as (partition by orig_h order by ts_us range between {W} preceding and current row)"""

QUERIES["WIN_3_profile_means"] = lambda s, d: profiles.ip_profile(view(s, d, "conn"), window_us=W).select(
    "uid", *r6("ip_profile_mean_duration", "ip_profile_mean_orig_bytes"))
SQL["WIN_3_profile_means"] = ctes("conn") + f"""
select uid, round(avg(duration) over w, 6) as ip_profile_mean_duration, round(avg(orig_bytes) over w, 6) as ip_profile_mean_orig_bytes
from conn window w as (partition by orig_h order by ts_us range between {W} preceding and current row)"""


def win4(s, d):
    # a missing source: hosts ending in 7 lose their address
    conn = view(s, d, "conn").withColumn("orig_h", F.when(~F.col("orig_h").endswith("7"), F.col("orig_h")))
    out = profiles.ip_profile(conn, window_us=W)
    return out.select("uid", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in profiles.PROFILE if c.startswith("ip_")])


QUERIES["WIN_4_profile_default"] = win4
SQL["WIN_4_profile_default"] = ctes("conn") + f"""
select uid, case when orig_h like '%7' then 1.0 else count(*) over w end as ip_profile_uid_rate,
 case when orig_h like '%7' then 1.0 else count(distinct resp_p) over w end as ip_profile_resp_p_rate,
 case when orig_h like '%7' then 1.0 else count(distinct resp_h) over w end as ip_profile_resp_h_rate,
 case when orig_h like '%7' then 1.0 else count(distinct conn_state) over w end as ip_profile_conn_state_diversity,
 round(case when orig_h like '%7' then duration else avg(duration) over w end, 6) as ip_profile_mean_duration,
 round(case when orig_h like '%7' then orig_bytes else avg(orig_bytes) over w end, 6) as ip_profile_mean_orig_bytes
from conn window w as (partition by orig_h order by ts_us range between {W} preceding and current row)"""

QUERIES["WIN_5_profile_snapshot"] = lambda s, d: profiles.ip_profile_snapshot(view(s, d, "conn"), window_us=W).select(
    "uid", "ip_profile_uid_rate", "ip_profile_resp_p_rate", "ip_profile_resp_h_rate", "ip_profile_conn_state_diversity",
    *r6("ip_profile_mean_duration", "ip_profile_mean_orig_bytes"))
SQL["WIN_5_profile_snapshot"] = ctes("conn") + f"""
, e as (select orig_h, max(ts_us) as last from conn group by 1),
f as (select orig_h, count(*) as ip_profile_uid_rate, count(distinct resp_p) as ip_profile_resp_p_rate, count(distinct resp_h) as ip_profile_resp_h_rate,
  count(distinct conn_state) as ip_profile_conn_state_diversity, round(avg(duration), 6) as ip_profile_mean_duration, round(avg(orig_bytes), 6) as ip_profile_mean_orig_bytes
  from conn join e using (orig_h) where ts_us >= last - {W} group by 1)
select uid, f.* exclude (orig_h) from conn join f using (orig_h)"""

QUERIES["WIN_6_concurrency"] = lambda s, d: profiles.concurrency(view(s, d, "conn")).select("uid", "concurrent_connections")
SQL["WIN_6_concurrency"] = ctes("conn") + """
, e as (select ts_us as t, 1 as step from conn union all select ts_us + cast(round(duration * 1e6) as bigint) + 1, -1 from conn),
r as (select t, sum(sum(step)) over (order by t) as c from e group by t)
select uid, c as concurrent_connections from conn join r on r.t = ts_us"""

QUERIES["WIN_7_concurrency_active"] = lambda s, d: profiles.concurrency_active(
    view(s, d, "conn").withColumn("duration", F.col("duration") * 100), window_us=W).select("uid", "concurrent_connections")
SQL["WIN_7_concurrency_active"] = ctes("conn") + f"""
, e as (select ts_us as t, 1 as step from conn union all select ts_us + least({W}, cast(round(duration * 100 * 1e6) as bigint)) + 1, -1 from conn),
r as (select t, sum(sum(step)) over (order by t) as c from e group by t)
select uid, c as concurrent_connections from conn join r on r.t = ts_us"""

G = f"range between {W} preceding and 1 preceding"
FAILED = "case when conn_state in ('REJ','S0','RSTO','RSTR','RSTOS0','RSTRH','SH','SHR') then 1 else 0 end"
# Beacon groups of the fixture are sparse, so these queries look back an hour.
WB = 3_600_000_000
QUERIES["WIN_8_beacon"] = lambda s, d: groups.beacon(view(s, d, "conn"), window_us=WB).select(
    "uid", "beacon_group_count", F.round(F.col("beacon_interval_mean") + 1e-8, 6).alias("beacon_interval_mean"), *r6("beacon_interval_std", "beacon_group_cv", "beacon_duration_std", "beacon_orig_bytes_std"))
SQL["WIN_8_beacon"] = ctes("conn") + f"""
, g as (select a.uid, b.ts_us as bt, b.duration as bd, b.orig_bytes as bo,
    b.ts_us - lag(b.ts_us) over (partition by a.uid order by b.ts_us) as gap
  from conn a left join conn b on a.orig_h = b.orig_h and a.resp_h = b.resp_h and a.resp_p = b.resp_p and a.proto = b.proto
    and b.ts_us between a.ts_us - {WB} and a.ts_us - 1),
s as (select uid, count(bt) as n, coalesce(avg(gap) / 1e6, 0) as m, coalesce(stddev_samp(gap) / 1e6, 0) as sd,
  coalesce(stddev_samp(bd), 0) as dd, coalesce(stddev_samp(bo), 0) as od from g group by uid)
select uid, n as beacon_group_count, round(m + 1e-8, 6) as beacon_interval_mean, round(sd, 6) as beacon_interval_std,
 round(case when m > 0 then sd / m else 0 end, 6) as beacon_group_cv, round(dd, 6) as beacon_duration_std, round(od, 6) as beacon_orig_bytes_std from s"""

QUERIES["WIN_9_horizontal"] = lambda s, d: groups.horizontal(view(s, d, "conn"), window_us=W).select(
    "uid", "horizontal_scan_unique_dst_ip_count", *r6("horizontal_ratio"))
SQL["WIN_9_horizontal"] = ctes("conn") + f"""
select uid, count(distinct resp_h) over w as horizontal_scan_unique_dst_ip_count, round(coalesce(avg({FAILED}) over w, 0), 6) as horizontal_ratio
from conn window w as (partition by orig_h, resp_p order by ts_us {G})"""

QUERIES["WIN_10_vertical"] = lambda s, d: groups.vertical(view(s, d, "conn"), window_us=W).select(
    "uid", "vertical_scan_unique_dst_port_count", *r6("vertical_ratio"))
SQL["WIN_10_vertical"] = ctes("conn") + f"""
select uid, count(distinct resp_p) over w as vertical_scan_unique_dst_port_count, round(coalesce(avg({FAILED}) over w, 0), 6) as vertical_ratio
from conn window w as (partition by orig_h, resp_h order by ts_us {G})"""

QUERIES["WIN_11_ddos"] = lambda s, d: groups.ddos(view(s, d, "conn"), window_us=W).select("uid", "ddos_group_unique_src_ip_count")
SQL["WIN_11_ddos"] = ctes("conn") + f"""
select uid, count(distinct orig_h) over (partition by resp_h, resp_p order by ts_us {G}) as ddos_group_unique_src_ip_count from conn"""

QUERIES["WIN_12_live_environment"] = lambda s, d: groups.env_live(
    view(s, d, "conn"), window_us=W, env={"problematic_ratio": 0.25, "duration_std": 2.0, "orig_bytes_std": 9.0}).select(
    "uid", *r6("env_problematic_ratio", "env_duration_std", "env_orig_bytes_std"))
SQL["WIN_12_live_environment"] = ctes("conn") + f"""
select uid, round(coalesce(avg({FAILED}) over w, 0.25), 6) as env_problematic_ratio, round(coalesce(stddev_pop(duration) over w, 2.0), 6) as env_duration_std,
 round(coalesce(stddev_pop(orig_bytes) over w, 9.0), 6) as env_orig_bytes_std from conn window w as (order by ts_us {G})"""
