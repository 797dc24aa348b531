"""Window, silence and findings state of streams: stream = batch, replays, lost checkpoints, late rows."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from flowlens.fixtures import view
from flowlens.operators import anchored, correlate, groups, profiles
from flowlens.streaming.findings import FindingsStore
from flowlens.streaming.run import start
from flowlens.streaming.windows import FRESH, QuietState, WindowState

W = 300_000_000
FAMILIES = ["beacon", "horizontal", "vertical", "ddos", "env", "profile", "open"]


def totals(conn):
    """Totals of every family for every row."""
    families = [groups.beacon_group(), groups.horizontal_group(), groups.vertical_group(), groups.ddos_group(), groups.env_group(), profiles.profile_group(), profiles.concurrency_group()]
    measures = {**groups.measures(), **profiles.profile_measures()}
    return groups.slide(conn, families, window_us=W, measures=measures)


def by_uid(df):
    names = sorted(c for c in df.columns if "__" in c)
    return names, {r["uid"]: tuple(r[n] for n in names) for r in df.select("uid", *names).collect()}


@pytest.fixture(scope="module")
def conn(spark, sf_dir, tmp_path_factory):
    rows = view(spark, sf_dir, "conn").select("ts_us", "uid", "orig_h", "resp_h", "resp_p", "proto", "conn_state", "duration", "orig_bytes")
    # some connections stay open for longer than a window
    rows = rows.withColumn("duration", F.when(F.col("resp_p") % 5 == 0, F.col("duration") * 100).otherwise(F.col("duration"))).orderBy("ts_us", "uid").limit(400)
    path = str(tmp_path_factory.mktemp("conn"))
    rows.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def whole(conn):
    return by_uid(totals(conn))


def parts(spark, df, n, order):
    rows = sorted(df.collect(), key=order)
    step = -(-len(rows) // n)
    return [spark.createDataFrame(rows[i:i + step], df.schema) for i in range(0, len(rows), step)]


def test_every_family_of_a_stream_equals_the_batch(spark, conn, whole, tmp_path):
    for i, part in enumerate(parts(spark, conn, 3, lambda r: (r.ts_us, r.uid))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    state, got, ids = WindowState(spark, str(tmp_path / "state"), window_us=W, lateness_us=0), {}, set()

    def each_batch(batch, number):
        rows = state.advance(batch, number)
        ids.update(state.log.latest()["runs"])
        got.update(by_uid(totals(rows).filter(FRESH))[1])

    stream = spark.readStream.schema(conn.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = start(stream, each_batch, str(tmp_path / "ck"))
    query.awaitTermination(300)
    assert query.exception() is None
    assert ids == {query.id}
    names, want = whole
    for family in FAMILIES:
        mine = [i for i, n in enumerate(names) if n.startswith(f"{family}__")]
        assert mine
        assert {k: [v[i] for i in mine] for k, v in got.items()} == {k: [v[i] for i in mine] for k, v in want.items()}, family
    high = conn.agg(F.max("ts_us")).first()[0]
    kept = state.rest()
    assert 0 < kept.count() < conn.count()
    assert kept.filter((F.col("ts_us") + W < high) & (F.col("ts_us") + profiles.duration_us() < high)).count() == 0


def test_held_rows_do_not_depend_on_the_order_of_arrival(spark, conn, whole, tmp_path):
    rng, late = random.Random(1), 600_000_000
    state, got = WindowState(spark, str(tmp_path / "s"), window_us=W, lateness_us=late, wait=True), {}
    for number, part in enumerate(parts(spark, conn, 3, lambda r: r.ts_us + rng.randint(0, late))):
        out = state.advance(part, number, "run")
        fresh = by_uid(totals(out).filter(FRESH))[1]
        assert not set(fresh) & set(got)
        got.update(fresh)
    got.update(by_uid(totals(state.rest()).filter(FRESH))[1])
    assert state.late() == 0
    assert got == whole[1]


def test_replayed_and_restarted_window_state(spark, conn, tmp_path):
    first, second = parts(spark, conn, 2, lambda r: (r.ts_us, r.uid))
    state = WindowState(spark, str(tmp_path / "s"), window_us=W, lateness_us=100_000_000)
    shape = lambda df: sorted(map(tuple, df.select("uid", FRESH).collect()))
    state.advance(first, 0, "a")
    once = shape(state.advance(second, 1, "a"))
    version = state.log.latest()["version"]
    assert shape(state.advance(second, 1, "a")) == once and state.log.latest()["version"] == version
    # the checkpoint is lost: another query brings all rows once more
    again = state.advance(conn, 0, "b")
    uids = [r.uid for r in again.collect()]
    assert len(uids) == len(set(uids)) and again.filter(FRESH).count() == 0
    high = conn.agg(F.max("ts_us")).first()[0]
    assert state.late() == conn.filter(F.col("ts_us") < high - 100_000_000).count() > 0
    new = conn.limit(1).withColumns({"ts_us": F.lit(high + 5), "uid": F.lit("new")})
    assert [r.uid for r in state.advance(new, 1, "b").filter(FRESH).collect()] == ["new"]
    untimed = conn.limit(1).withColumn("ts_us", F.lit(None).cast("long"))
    before = state.late()
    assert state.advance(untimed, 2, "b").filter(FRESH).count() == 0 and state.late() == before + 1
    assert state.advance(conn.filter("false"), 3, "b").filter(FRESH).count() == 0


def test_cooldown_across_triggers(spark, sf_dir, tmp_path):
    alerts = view(spark, sf_dir, "alerts").orderBy("ts_us", "alert_id").limit(600)
    want = {r.alert_id for r in anchored.cooldown(alerts, window_us=W).collect()}
    quiet, got = QuietState(spark, str(tmp_path / "q"), window_us=W), []
    for number, part in enumerate(parts(spark, alerts, 4, lambda r: (r.ts_us, r.alert_id))):
        passed = [r.alert_id for r in quiet.let_through(part, number, "a").collect()]
        if number == 2:
            assert sorted(passed) == sorted(r.alert_id for r in quiet.let_through(part, number, "a").collect())
        got += passed
    assert len(got) == len(set(got)) and set(got) == want


def state_of(df):
    return sorted((r.finding_id, r.ip, r.start_us, r.last_us, r.evidence_count, r.risk_score, r.title) for r in df.collect())


@pytest.fixture(scope="module")
def alerts(spark, sf_dir):
    return view(spark, sf_dir, "alerts")


def test_incremental_findings_equal_one_batch(spark, alerts, tmp_path):
    want = correlate.findings(correlate.correlate(alerts, window_us=W))
    rng, late = random.Random(2), 900_000_000
    store = FindingsStore(spark, str(tmp_path / "f"), window_us=W, lateness_us=late, buckets=8)
    given = parts(spark, alerts, 5, lambda r: r.ts_us + rng.randint(0, late))
    for number, part in enumerate(given):
        assert store.add(part, number, "a")
        assert not store.add(part, number, "a")  # replayed
    assert store.late() == 0
    assert state_of(store.findings()) == state_of(want)
    assert sorted(r.alert_id for r in store.evidence().collect()) == sorted(r.alert_id for r in alerts.collect())
    entry = store.log.latest()
    assert entry["version"] == 5 and entry["closed"]
    # the checkpoint is lost: everything comes again, nothing doubles and nothing is lost
    for number, part in enumerate(given):
        assert store.add(part, number, "b")
    assert state_of(store.findings()) == state_of(want)
    assert store.evidence().count() == alerts.count()
    assert store.late() > 0


def test_a_batch_touches_its_buckets_only(spark, alerts, tmp_path):
    store = FindingsStore(spark, str(tmp_path / "f"), window_us=W, buckets=16)
    store.add(alerts, 0, "a")
    stamps = {r.finding_id: r.output_us for r in store.findings().collect()}
    before = store.log.latest()
    high = before["high_us"]["alerts"]
    one = alerts.limit(1).withColumns({"ts_us": F.lit(high + 1), "alert_id": F.lit("later"), "src_ip": F.lit("10.9.9.9")})
    store.add(one, 1, "a")
    after = store.log.latest()
    changed = {k for k in {**before["parts"], **after["parts"]} if before["parts"].get(k) != after["parts"].get(k)}
    assert len(changed) == 1
    found = {r.finding_id: r for r in store.findings().collect()}
    assert {k: v.output_us for k, v in found.items() if k in stamps} == stamps
    assert [r.evidence_count for k, r in found.items() if k not in stamps] == [1]
    # one more alert of the same finding changes that row alone
    store.add(one.withColumns({"ts_us": F.lit(high + 2), "alert_id": F.lit("more")}), 2, "a")
    assert [r.evidence_count for r in store.findings().filter("ip = '10.9.9.9'").collect()] == [2]
    store.add(one.withColumns({"src_ip": F.lit(None).cast("string"), "alert_id": F.lit("x")}), 3, "a")
    store.add(one.withColumns({"ts_us": F.lit(None).cast("long"), "alert_id": F.lit("y")}), 4, "a")
    store.add(alerts.filter("false"), 5, "a")
    assert store.late() == 1 and store.findings().count() == len(found)


def test_an_empty_store_has_no_findings(spark, tmp_path):
    store = FindingsStore(spark, str(tmp_path / "f"), window_us=W)
    assert store.findings() is None and store.late() == 0


def log_lines(rows, fields, path, n):
    """Rows as tab-separated log files, oldest first."""
    from flowlens import schema as S

    text = [F.format_string("%.6f", F.col("ts_us") / 1e6) if f == "ts" else F.coalesce(F.col(S.flat(f)).cast("string"), F.lit("-")) if S.flat(f) in rows.columns else F.lit("-") for f in fields]
    lines = [r.line for r in rows.select("ts_us", "uid", F.concat_ws("\t", *text).alias("line")).orderBy("ts_us", "uid").collect()]
    path.mkdir()
    step = -(-len(lines) // n)
    for i in range(n):
        (path / f"{i}.log").write_text("\n".join(["#fields", *lines[i * step:(i + 1) * step]]) + "\n")
        os.utime(path / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))  # streams take older files first


def test_connection_and_dns_jobs_share_a_findings_table(spark, sf_dir, tmp_path):
    """Both jobs at once, from log lines to findings; the same as one batch over all lines."""
    from flowlens import schema as S
    from flowlens.plans import flows
    from flowlens.sources.zeek import split_lines, typed
    from flowlens.streaming.run import run_conn, run_dns

    conn, dns = view(spark, sf_dir, "conn"), view(spark, sf_dir, "dns")
    log_lines(conn, S.CONN_FIELDS, tmp_path / "conn", 2)
    log_lines(dns, S.DNS_FIELDS, tmp_path / "dns", 3)
    read = lambda kind: typed(split_lines(spark.read.text(str(tmp_path / kind)), kind), kind).cache()
    conn, dns = read("conn"), read("dns")
    flows.train_conn(conn, window_us=W, trees=8, code=4).save(spark, str(tmp_path / "conn_model"))
    flows.train_dns(dns, trees=8, code=4).save(spark, str(tmp_path / "dns_model"))
    conn_detector, dns_detector = (flows.Detector.load(spark, str(tmp_path / f"{k}_model")) for k in ("conn", "dns"))

    quiet_us = flows.COOLDOWN_US
    store = FindingsStore(spark, str(tmp_path / "f"), window_us=W, buckets=4, feeds=("conn", "dns"))
    state, quiet = WindowState(spark, str(tmp_path / "s"), window_us=W), QuietState(spark, str(tmp_path / "q"), window_us=quiet_us)
    jobs = [run_conn(spark, str(tmp_path / "conn"), store, state, quiet, str(tmp_path / "c1"), conn_detector, max_files=1),
            run_dns(spark, str(tmp_path / "dns"), store, str(tmp_path / "c2"), dns_detector, max_files=1)]
    for job in jobs:
        assert job.awaitTermination(200), job.lastProgress
        assert job.exception() is None
    want = flows.detect_conn(conn, conn_detector, explain=False, quiet_us=quiet_us).unionByName(flows.detect_dns(dns, dns_detector, explain=False), allowMissingColumns=True)
    want.write.parquet(str(tmp_path / "want"))  # settled: correlation reads alerts several times
    want = spark.read.parquet(str(tmp_path / "want"))
    assert store.late() == 0 and state.late() == 0
    assert state_of(store.findings()) == state_of(correlate.findings(correlate.correlate(want, window_us=W)))
    assert {s for r in store.evidence().select("source").distinct().collect() for s in r} == {"connection_engine", "dns_engine"}
