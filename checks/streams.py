"""State of streams, fed slice by slice the way a stream's batches arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.correlation import FIND
from flowlens.fixtures import WINDOW_US as W
from flowlens.fixtures import ctes, view
from flowlens.operators import groups, profiles
from flowlens.operators.sliding import slide
from flowlens.session import checkpoint_dir
from flowlens.streaming.findings import FindingsStore
from flowlens.streaming.windows import FRESH, WindowState

QUERIES, SQL = {}, {}
START, THIRD = 1704067200000000, 8_640_000_000  # the fixture's day is a hundredth of its months
LATE = 60_000_000


def folder(s):
    return f"{checkpoint_dir(s)}/flowlens-{uuid.uuid4().hex}"


def slices(df):
    return [df.filter(F.floor((F.col("ts_us") - START) / THIRD) == i) for i in (0, 1)] + [df.filter(F.col("ts_us") >= START + 2 * THIRD)]


def str3(s, d):
    path = folder(s)
    state = WindowState(s, path, window_us=W)
    families = [groups.beacon_group(), groups.horizontal_group(), groups.vertical_group(), groups.ddos_group(), groups.env_group(), profiles.profile_group(), profiles.concurrency_group()]
    measures = {**groups.measures(), **profiles.profile_measures()}
    for number, part in enumerate(slices(view(s, d, "conn"))):
        rows = slide(state.advance(part, number, "check"), families, window_us=W, measures=measures).filter(FRESH)
        rows.select("uid", "beacon__n", "horizontal__hosts", "horizontal__failed", "vertical__ports", "ddos__sources", "env__n", "profile__n", "profile__hosts", "open__n").write.mode(
            "overwrite").parquet(f"{path}/out/batch={number}")
    return s.read.parquet(f"{path}/out").drop("batch")


QUERIES["STR_3_stream_windows"] = str3
SQL["STR_3_stream_windows"] = ctes("conn") + f"""
, e as (select ts_us as t, 1 as step from conn union all select ts_us + cast(round(duration * 1e6) as bigint) + 1, -1 from conn),
r as (select t, sum(sum(step)) over (order by t) as c from e group by t)
select uid, count(*) over (partition by orig_h, resp_h, resp_p, proto order by ts_us range between {W} preceding and 1 preceding) as beacon__n,
 count(distinct resp_h) over h as horizontal__hosts,
 coalesce(sum(case when conn_state in ('REJ','S0','RSTO','RSTR','RSTOS0','RSTRH','SH','SHR') then 1 else 0 end) over h, 0) as horizontal__failed,
 count(distinct resp_p) over (partition by orig_h, resp_h order by ts_us range between {W} preceding and 1 preceding) as vertical__ports,
 count(distinct orig_h) over (partition by resp_h, resp_p order by ts_us range between {W} preceding and 1 preceding) as ddos__sources,
 count(*) over (order by ts_us range between {W} preceding and 1 preceding) as env__n,
 count(*) over p as profile__n, count(distinct resp_h) over p as profile__hosts, c as open__n
from conn join r on t = ts_us
window h as (partition by orig_h, resp_p order by ts_us range between {W} preceding and 1 preceding),
 p as (partition by orig_h order by ts_us range between {W} preceding and current row)"""


def str7(s, d):
    alerts = view(s, d, "alerts")
    store = FindingsStore(s, folder(s), window_us=W, lateness_us=LATE)
    parts = slices(alerts)
    for number, part in enumerate(parts):
        store.add(part, number, "first")
    store.add(parts[2], 2, "first")  # replayed
    store.add(alerts, 0, "second")  # a lost checkpoint brings everything once more
    return store.findings().select("finding_id", "risk_score", "severity", "evidence_count")


QUERIES["STR_7_incremental_findings"] = str7
SQL["STR_7_incremental_findings"] = FIND + " select finding_id, risk_score, severity, evidence_count from fd"


def str2(s, d):
    # the last third of the day comes before the second
    path = folder(s)
    state = WindowState(s, path, window_us=W, lateness_us=LATE)
    first, second, third = slices(view(s, d, "conn").select("ts_us", "uid", "orig_h"))
    for number, part in enumerate((first, third, second)):
        state.advance(part, number, "check").filter(FRESH).select("uid").write.parquet(f"{path}/out/batch={number}")
    return s.read.parquet(f"{path}/out").agg(F.count("*").alias("on_time")).withColumn("late", F.lit(state.late()).cast("bigint"))


QUERIES["STR_2_late_rows"] = str2
SQL["STR_2_late_rows"] = ctes("conn") + f"""
, m as (select max(ts_us) - {LATE} as h from conn),
f as (select ts_us >= {START + THIRD} and ts_us < {START + 2 * THIRD} and ts_us < h as late from conn, m)
select count(*) filter (not late) as on_time, count(*) filter (late) as late from f"""
