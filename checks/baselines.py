"""Fit statistics, baselines, blending and z-scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.fixtures import WINDOW_US as W
from flowlens.fixtures import ctes, view
from flowlens.operators import baselines, groups, profiles
from checks.windows import FAILED, G, r6

QUERIES, SQL = {}, {}
BK = "orig_h, resp_h, resp_p, proto"

STEPS = f"""
, pt as (select distinct {BK}, ts_us from conn),
steps as (select * from (select *, ts_us - lag(ts_us) over (partition by {BK} order by ts_us) as step from pt) where step is not null)"""
BEACON_FIT = STEPS + f"""
, gaps as (select {BK}, ts_us, uid, coalesce(ts_us - lag(ts_us) over (partition by {BK} order by ts_us, uid), 0) / 1e6 as gap, duration, orig_bytes from conn),
bfit as (select {BK}, count(*) as n, sum(cast(round(gap * 1e6) as bigint)) / count(*) / 1e6 as m, coalesce(stddev_samp(gap), 0) as sd, avg(duration) as dm, coalesce(stddev_samp(duration), 0) as dd,
  avg(orig_bytes) as om, coalesce(stddev_samp(orig_bytes), 0) as od from gaps group by all)"""
ENV = BEACON_FIT + f"""
, hfit as (select orig_h, resp_p, count(distinct resp_h) as n, avg({FAILED}) as r from conn group by all),
vfit as (select orig_h, resp_h, count(distinct resp_p) as n, avg({FAILED}) as r from conn group by all),
dfit as (select resp_h, resp_p, count(distinct orig_h) as n from conn group by all),
sd1 as (select stddev_samp(step / 1e6) as s from steps),
env as (select (select avg({FAILED}) from conn) as problematic_ratio, (select stddev_samp(duration) from conn) as duration_std,
  (select stddev_samp(orig_bytes) from conn) as orig_bytes_std,
  (select case when s > 0 then s else 30 end from sd1) as beacon_channel_timediff_std_mean,
  (select case when s > 0 then s / 2 else 15 end from sd1) as beacon_channel_timediff_std_std,
  (select case when stddev_samp(n) > 0 then stddev_samp(n) else 1 end from hfit) as std_horizontal_unique_dst_ip_count,
  (select case when stddev_samp(r) > 0 then stddev_samp(r) else 1 end from hfit) as std_horizontal_problematic_ratio,
  (select case when stddev_samp(n) > 0 then stddev_samp(n) else 1 end from vfit) as std_vertical_unique_dst_port_count,
  (select case when stddev_samp(r) > 0 then stddev_samp(r) else 1 end from vfit) as std_vertical_problematic_ratio,
  (select case when stddev_samp(n) > 0 then stddev_samp(n) else 1 end from bfit) as std_beacon_group_count,
  (select case when stddev_samp(n) > 0 then stddev_samp(n) else 1 end from dfit) as std_ddos_unique_src_ip_count,
  (select median(n) from hfit) as median_horizontal_unique_dst_ip_count, (select median(n) from vfit) as median_vertical_unique_dst_port_count,
  (select median(n) from bfit) as median_beacon_group_count, (select median(n) from dfit) as median_ddos_unique_src_ip_count)"""
BUCKETS = f"""
, bk as (select orig_h, ts_us // {W} as bucket, count(distinct resp_h) as horizontal_unique_dst_ip_count, count(distinct resp_p) as vertical_unique_dst_port_count,
  avg({FAILED}) as problematic_ratio, coalesce(stddev_samp(duration), 0) as duration_std, coalesce(stddev_samp(orig_bytes), 0) as orig_bytes_std
  from conn group by all)"""


def _entity_sql():
    cols = ", ".join(
        f"avg({c}) as {c}_mean, case when stddev_samp({c}) > 0 then stddev_samp({c}) else 1 end as {c}_std" for c in baselines.ENTITY_METRICS)
    return f"""{BUCKETS}
, ent0 as (select orig_h, {cols} from bk group by 1),
eg as (select orig_h, coalesce(stddev_samp(step / 1e6), 0) as s from steps group by 1),
ent as (select ent0.*, coalesce(s, 0) as beacon_channel_timediff_std_mean, case when s is null then 1 else greatest(s / 2, 1) end as beacon_channel_timediff_std_std
  from ent0 left join eg using (orig_h))"""


ENTITY = _entity_sql()
RAW = f"""
, g as (select a.uid, b.ts_us - lag(b.ts_us) over (partition by a.uid order by b.ts_us) as gap, b.duration as bd, b.orig_bytes as bo, b.ts_us as bt
  from conn a left join conn b on a.orig_h = b.orig_h and a.resp_h = b.resp_h and a.resp_p = b.resp_p and a.proto = b.proto
    and b.ts_us between a.ts_us - {W} and a.ts_us - 1),
bs as (select uid, count(bt) as bn, coalesce(avg(gap) / 1e6, 0) as bm, coalesce(stddev_samp(gap) / 1e6, 0) as bsd,
  coalesce(stddev_samp(bd), 0) as bdd, coalesce(stddev_samp(bo), 0) as bod from g group by uid),
ws as (select uid, orig_h, count(distinct resp_h) over wh as hn, coalesce(avg({FAILED}) over wh, 0) as hr, count(*) over wh as hc,
  count(distinct resp_p) over wv as vn, coalesce(avg({FAILED}) over wv, 0) as vr, count(*) over wv as vc,
  count(distinct orig_h) over wd as dn,
  coalesce(avg({FAILED}) over we, (select problematic_ratio from env)) as er,
  coalesce(stddev_pop(duration) over we, (select duration_std from env)) as ed,
  coalesce(stddev_pop(orig_bytes) over we, (select orig_bytes_std from env)) as eo
  from conn window wh as (partition by orig_h, resp_p order by ts_us {G}), wv as (partition by orig_h, resp_h order by ts_us {G}),
  wd as (partition by resp_h, resp_p order by ts_us {G}), we as (order by ts_us {G})),
raw as (select uid, orig_h, hn as horizontal_scan_unique_dst_ip_count, least(hc / 3.0, 1) * hr + (1 - least(hc / 3.0, 1)) * er as horizontal_scan_problematic_ratio,
  vn as vertical_scan_unique_dst_port_count, least(vc / 3.0, 1) * vr + (1 - least(vc / 3.0, 1)) * er as vertical_scan_problematic_ratio,
  bn as beacon_group_count, case when bm > 0 then bsd / bm else 0 end as beacon_group_cv,
  case when bsd > 0 and bn >= 4 then least((bn - 1) / 3.0, 1) * least(bsd, greatest(1, 10 * greatest(beacon_channel_timediff_std_mean, 1e-6)))
    + (1 - least((bn - 1) / 3.0, 1)) * beacon_channel_timediff_std_mean else beacon_channel_timediff_std_mean end as beacon_channel_timediff_std,
  case when bn >= 2 then least(bn / 3.0, 1) * least(bdd, greatest(1, 10 * greatest(ed, 1e-6))) + (1 - least(bn / 3.0, 1)) * ed else ed end as beacon_channel_duration_std,
  case when bn >= 2 then least(bn / 3.0, 1) * least(bod, greatest(1, 10 * greatest(eo, 1e-6))) + (1 - least(bn / 3.0, 1)) * eo else eo end as beacon_channel_orig_bytes_std,
  dn as ddos_group_unique_src_ip_count
  from ws join bs using (uid), env)"""


def zsql(name):
    value, entity, mean, std = baselines._Z[name]
    if entity:
        m, s = f"coalesce(ent.{entity}_mean, env.{mean})", f"coalesce(ent.{entity}_std, env.{std})"
        body = f"case when abs(raw.{value}) < 1e-9 and abs({m}) < 1e-9 then 0 else (raw.{value} - {m}) / case when {s} <= 0 then 1 else greatest({s}, 1e-9) end end"
    else:
        body = f"(raw.{value} - env.{mean}) / greatest(env.{std}, 1e-9)"
    return f"round(greatest(least({body}, 8), -8), 5) as {name}"


QUERIES["AGG_1_beacon_fit"] = lambda s, d: baselines.beacon_fit(view(s, d, "conn")).select(
    "orig_h", "resp_h", "resp_p", "proto", "beacon_group_count",
    F.round(F.col("beacon_group_mean_interval") + 1e-8, 6).alias("beacon_group_mean_interval"), F.round(F.col("beacon_group_mean_duration") + 1e-8, 6).alias("beacon_group_mean_duration"), *r6("beacon_group_cv", "beacon_channel_timediff_std",
        "beacon_channel_duration_std", "beacon_group_mean_orig_bytes", "beacon_channel_orig_bytes_std"))
SQL["AGG_1_beacon_fit"] = ctes("conn") + BEACON_FIT + f"""
select {BK}, n as beacon_group_count, round(m + 1e-8, 6) as beacon_group_mean_interval, round(case when m > 0 then sd / m else 0 end, 6) as beacon_group_cv,
 round(sd, 6) as beacon_channel_timediff_std, round(dm + 1e-8, 6) as beacon_group_mean_duration, round(dd, 6) as beacon_channel_duration_std,
 round(om, 6) as beacon_group_mean_orig_bytes, round(od, 6) as beacon_channel_orig_bytes_std from bfit"""

QUERIES["AGG_2_horizontal_fit"] = lambda s, d: baselines.horizontal_fit(view(s, d, "conn")).select(
    "orig_h", "resp_p", "horizontal_scan_unique_dst_ip_count", *r6("horizontal_scan_problematic_ratio"))
SQL["AGG_2_horizontal_fit"] = ctes("conn") + f"""select orig_h, resp_p, count(distinct resp_h) as horizontal_scan_unique_dst_ip_count,
 round(avg({FAILED}), 6) as horizontal_scan_problematic_ratio from conn group by 1, 2"""
QUERIES["AGG_3_vertical_fit"] = lambda s, d: baselines.vertical_fit(view(s, d, "conn")).select(
    "orig_h", "resp_h", "vertical_scan_unique_dst_port_count", *r6("vertical_scan_problematic_ratio"))
SQL["AGG_3_vertical_fit"] = ctes("conn") + f"""select orig_h, resp_h, count(distinct resp_p) as vertical_scan_unique_dst_port_count,
 round(avg({FAILED}), 6) as vertical_scan_problematic_ratio from conn group by 1, 2"""
QUERIES["AGG_4_ddos_fit"] = lambda s, d: baselines.ddos_fit(view(s, d, "conn"))
SQL["AGG_4_ddos_fit"] = ctes("conn") + "select resp_h, resp_p, count(distinct orig_h) as ddos_group_unique_src_ip_count from conn group by 1, 2"

QUERIES["AGG_5_environment_baseline"] = lambda s, d: baselines.env_fit(view(s, d, "conn")).select("name", F.round("value", 5).alias("value"))
SQL["AGG_5_environment_baseline"] = ctes("conn") + ENV + "select name, round(value, 5) as value from (unpivot (select columns(*)::double from env) on columns(*) into name name value value)"


def agg6(s, d):
    env = baselines.env_fit(view(s, d, "conn"))
    manual = F.create_map(*[F.lit(x) for kv in baselines.EXPERT_BEACON.items() for x in kv])
    default = F.create_map(*[F.lit(x) for kv in baselines.ENV_DEFAULTS.items() for x in kv])
    chosen = F.coalesce(F.try_element_at(manual, F.col("name")), F.col("value"), F.try_element_at(default, F.col("name")))
    return env.select("name", F.round(chosen, 5).alias("value"))


QUERIES["AGG_6_manual_baseline"] = agg6
SQL["AGG_6_manual_baseline"] = ctes("conn") + ENV + """
select name, round(case name when 'median_beacon_group_count' then 2 when 'std_beacon_group_count' then 5 when 'beacon_channel_timediff_std_mean' then 30
 when 'beacon_channel_timediff_std_std' then 15 else value end, 5) as value
from (unpivot (select columns(*)::double from env) on columns(*) into name name value value)"""

QUERIES["AGG_7_entity_buckets"] = lambda s, d: baselines.entity_buckets(view(s, d, "conn"), window_us=W).select(
    "orig_h", "bucket", "horizontal_unique_dst_ip_count", "vertical_unique_dst_port_count", *r6("problematic_ratio", "duration_std", "orig_bytes_std"))
SQL["AGG_7_entity_buckets"] = ctes("conn") + BUCKETS + """
select * replace (round(problematic_ratio, 6) as problematic_ratio, round(duration_std, 6) as duration_std, round(orig_bytes_std, 6) as orig_bytes_std) from bk"""

QUERIES["AGG_8_entity_baseline"] = lambda s, d: baselines.entity_fit(view(s, d, "conn"), window_us=W).select(
    "orig_h", *r6(*[f"{c}_{k}" for c in [*baselines.ENTITY_METRICS, "beacon_channel_timediff_std"] for k in ("mean", "std")]))
SQL["AGG_8_entity_baseline"] = ctes("conn") + STEPS + ENTITY + " select orig_h, round(columns(* exclude (orig_h)), 6) from ent"

QUERIES["AGG_9_entity_gap"] = lambda s, d: baselines.entity_gap(view(s, d, "conn")).select(
    "orig_h", *r6("beacon_channel_timediff_std_mean", "beacon_channel_timediff_std_std"))
SQL["AGG_9_entity_gap"] = ctes("conn") + STEPS + """
select orig_h, round(coalesce(stddev_samp(step / 1e6), 0), 6) as beacon_channel_timediff_std_mean,
 round(greatest(coalesce(stddev_samp(step / 1e6), 0) / 2, 1), 6) as beacon_channel_timediff_std_std from steps group by 1"""


def fitted_env(s, d):
    return baselines.merge_env({r["name"]: r["value"] for r in baselines.env_fit(view(s, d, "conn")).collect()})


def raw_features(*cols):
    return lambda s, d: groups.group_features(view(s, d, "conn"), fitted_env(s, d), window_us=W).select("uid", *r6(*cols))


def raw_sql(*cols):
    return ctes("conn") + ENV + RAW + "select uid, " + ", ".join(f"round({c}, 6) as {c}" for c in cols) + " from raw"


for key, cols in {
    "WIN_13_sparse_blend": ("horizontal_scan_problematic_ratio", "vertical_scan_problematic_ratio"),
    "WIN_14_capped_channels": ("beacon_channel_duration_std", "beacon_channel_orig_bytes_std"),
    "WIN_15_beacon_channel": ("beacon_group_cv", "beacon_channel_timediff_std"),
}.items():
    QUERIES[key], SQL[key] = raw_features(*cols), raw_sql(*cols)


def win16(s, d):
    conn = view(s, d, "conn")
    model = baselines.GroupBaseline(W).fit(conn)
    return model.transform(conn).select("uid", *[F.round(c, 5).alias(c) for c in baselines.Z_COLUMNS])


QUERIES["WIN_16_z_scores"] = win16
SQL["WIN_16_z_scores"] = ctes("conn") + ENV + RAW + ENTITY + "select uid, " + ", ".join(map(zsql, baselines.Z_COLUMNS)) + " from raw left join ent using (orig_h), env"

QUERIES["WIN_17_arrival_gap"] = lambda s, d: profiles.arrival_gap(view(s, d, "conn"), baselines.BEACON).select("uid", "gap_us")
SQL["WIN_17_arrival_gap"] = ctes("conn") + f"select uid, coalesce(ts_us - lag(ts_us) over (partition by {BK} order by ts_us, uid), 0) as gap_us from conn"

HOLE = "(history = '' or tunnel_parents = '-')"


def win18(s, d):
    holes = view(s, d, "conn").withColumns({c: F.expr(f"case when not {HOLE} then {c} end") for c in ("duration", "orig_bytes")})
    return profiles.backfill(holes, ["duration", "orig_bytes"]).select("uid", "orig_bytes", *r6("duration"))


QUERIES["WIN_18_backfill"] = win18
SQL["WIN_18_backfill"] = ctes("conn") + f"""
, h as (select uid, orig_h, ts_us, case when not {HOLE} then duration end as d, case when not {HOLE} then orig_bytes end as o from conn)
select uid, round(coalesce(first_value(d ignore nulls) over w, 0), 6) as duration, coalesce(first_value(o ignore nulls) over w, 0) as orig_bytes
from h window w as (partition by orig_h order by ts_us, uid rows between current row and unbounded following)"""

JOIN3 = ("horizontal_unique_dst_ip_count_mean", "problematic_ratio_std")


def jon3(s, d):
    conn, env = view(s, d, "conn"), fitted_env(s, d)
    # hosts ending in 3 were never seen in training
    entity = baselines.entity_fit(conn.filter(~F.col("orig_h").endswith("3")), window_us=W)
    out = baselines.with_entity(conn, entity)
    return out.select("uid", F.round(F.coalesce(f"ent_{JOIN3[0]}", F.lit(env["median_horizontal_unique_dst_ip_count"])), 5).alias("h_mean"),
                      F.round(F.coalesce(f"ent_{JOIN3[1]}", F.lit(env["std_horizontal_problematic_ratio"])), 5).alias("pr_std"))


QUERIES["JON_3_entity_lookup"] = jon3
SQL["JON_3_entity_lookup"] = ctes("conn") + ENV + ENTITY + f"""
, e2 as (select * from ent where orig_h not like '%3')
select uid, round(coalesce({JOIN3[0]}, median_horizontal_unique_dst_ip_count), 5) as h_mean, round(coalesce({JOIN3[1]}, std_horizontal_problematic_ratio), 5) as pr_std
from conn left join e2 using (orig_h), env"""


def win20(s, d):
    conn = view(s, d, "conn")
    model = baselines.GroupBaseline(W, warm_up_rows=200).fit(conn)
    env = model.env if model.ready else baselines.ENV_DEFAULTS
    seen = conn.groupBy("orig_h").agg(F.count("*").alias("rows"))
    base = F.when(F.lit(model.ready) & (F.col("rows") >= 200), env["problematic_ratio"]).otherwise(baselines.ENV_DEFAULTS["problematic_ratio"])
    return seen.select("orig_h", (F.col("rows") >= 200).alias("baseline_ready"), F.round(base, 6).alias("problematic_ratio"))


QUERIES["WIN_20_warm_up"] = win20
SQL["WIN_20_warm_up"] = ctes("conn") + f"""select orig_h, count(*) >= 200 as baseline_ready,
 round(case when count(*) >= 200 then (select avg({FAILED}) from conn) else 0 end, 6) as problematic_ratio from conn group by 1"""

QUERIES["JON_1_profile_on_row"] = lambda s, d: profiles.ip_profile(view(s, d, "conn"), window_us=W).groupBy("orig_h").agg(
    F.count("*").alias("rows"), F.countDistinct("uid").alias("uids"))
SQL["JON_1_profile_on_row"] = ctes("conn") + "select orig_h, count(*) as rows, count(distinct uid) as uids from conn group by 1"
QUERIES["JON_2_group_features_on_row"] = lambda s, d: groups.group_features(view(s, d, "conn"), baselines.ENV_DEFAULTS, window_us=W).groupBy("resp_h").agg(
    F.count("*").alias("rows"), F.countDistinct("uid").alias("uids"))
SQL["JON_2_group_features_on_row"] = ctes("conn") + "select resp_h, count(*) as rows, count(distinct uid) as uids from conn group by 1"
