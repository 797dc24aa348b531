"""Window operators against a plain replay, with frame edges, ties and gaps."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowlens.operators import anchored, groups, profiles
from flowlens.operators.anchored import block_outcomes, window_starts

W = 1_000
COLUMNS = "ts_us bigint, uid string, orig_h string, resp_h string, resp_p bigint, proto string, conn_state string, duration double, orig_bytes bigint"


def make_rows(n=180, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = rng.choice([0, 1, W, W + 1, 2 * W, rng.randrange(1, 6 * W)]) + 5_000
        rows.append((ts, f"u{i}", rng.choice("abc"), rng.choice("xyz"), rng.choice([22, 80, 443]), rng.choice(["tcp", "udp"]),
                     rng.choice(["SF", "REJ"]), rng.choice([0.0, 0.25, 1.5]), rng.choice([0, 100, 7_000_000])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def conn(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_profile_includes_row_peers_and_left_edge(conn, rows):
    got = {r["uid"]: r for r in profiles.ip_profile(conn, window_us=W).collect()}
    assert len(got) == len(rows)
    for ts, uid, src, *_ in rows:
        frame = [r for r in rows if r[2] == src and ts - W <= r[0] <= ts]
        assert got[uid]["ip_profile_uid_rate"] == len(frame)
        assert got[uid]["ip_profile_resp_p_rate"] == len({r[4] for r in frame})
        assert got[uid]["ip_profile_mean_orig_bytes"] == pytest.approx(sum(r[8] for r in frame) / len(frame))


def test_groups_exclude_row_and_peers(conn, rows):
    got = {r["uid"]: r for r in groups.group_features(conn, {"beacon_channel_timediff_std_mean": 30.0}, window_us=W).collect()}
    assert len(got) == len(rows)
    for ts, uid, src, dst, port, proto, *_ in rows:
        frame = [r for r in rows if ts - W <= r[0] < ts]
        hosts = {r[3] for r in frame if r[2] == src and r[4] == port}
        beacon = [r for r in frame if r[2:6] == (src, dst, port, proto)]
        assert got[uid]["horizontal_scan_unique_dst_ip_count"] == len(hosts)
        assert got[uid]["ddos_group_unique_src_ip_count"] == len({r[2] for r in frame if r[3] == dst and r[4] == port})
        assert got[uid]["beacon_group_count"] == len(beacon)


def test_beacon_spread(conn, rows):
    got = {r["uid"]: r for r in groups.beacon(conn, window_us=W).collect()}
    for ts, uid, *key in rows:
        frame = sorted(r for r in rows if ts - W <= r[0] < ts and list(r[2:6]) == key[:4])
        steps = [(b[0] - a[0]) / 1e6 for a, b in zip(frame, frame[1:])]
        want = statistics.stdev(steps) if len(steps) >= 2 else 0.0
        assert got[uid]["beacon_interval_std"] == pytest.approx(want, abs=1e-9)
        sizes = [r[8] for r in frame]
        assert got[uid]["beacon_orig_bytes_std"] == pytest.approx(statistics.stdev(sizes) if len(sizes) >= 2 else 0.0)


def test_slot_length_does_not_matter(conn):
    from flowlens.operators.sliding import slide
    wide, narrow = (
        slide(conn, [groups.horizontal_group()], window_us=W, measures=groups.measures(), slot_us=s).select("uid", "horizontal__hosts", "horizontal__n").collect()
        for s in (10_000_000, 7))
    assert sorted(wide) == sorted(narrow)


def test_concurrency(conn, rows):
    timed = conn.withColumn("duration", F.col("orig_bytes") % 97 / 1e4)
    ends = {r["uid"]: r["ts_us"] + round(r["duration"] * 1e6) for r in timed.collect()}
    got = {r["uid"]: r["concurrent_connections"] for r in profiles.concurrency(timed).collect()}
    for ts, uid, *_ in rows:
        assert got[uid] == sum(r[0] <= ts for r in rows) - sum(e < ts for e in ends.values())


def test_window_starts_and_blocks_agree():
    import numpy as np
    rng = random.Random(5)
    for _ in range(200):
        times = np.array(sorted(rng.sample(range(0, 400), 40)), dtype=np.int64)
        free = rng.randrange(-5, 21)
        rows = block_outcomes(times, 20, 0)
        want = window_starts(times, 20, free)
        if times[-1] >= free:
            hit = next(last for above, up_to, last in rows if above < free <= up_to)
            assert hit == want[-1]


def test_anchored_windows_over_blocks(spark):
    rng = random.Random(9)
    rows = [(rng.choice("pq"), rng.randrange(0, 40_000)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, ts_us bigint")
    got = sorted((r["k"], r["ts_us"], r["start_us"]) for r in anchored.anchor_windows(df, ["k"], span_us=100, block_spans=3).collect())
    want = []
    for k in "pq":
        start = None
        for t in sorted(t for key, t in rows if key == k):
            start = t if start is None or t >= start + 100 else start
            want.append((k, t, start))
    assert got == sorted(want)


def test_composed_blocks_equal_their_parts():
    import numpy as np
    rng = random.Random(11)
    for _ in range(300):
        span, size = 20, 20 * rng.choice([1, 2, 5])
        kept = [(b, sorted(rng.sample(range(b * size, (b + 1) * size), rng.choice([1, 3, 9])))) for b in range(6) if rng.random() < 0.7]
        if not kept:
            continue
        parts = []
        for b, times in kept:
            _, up_to, last = zip(*block_outcomes(np.array(times), span, b * size))
            parts.append((np.array(up_to), np.array(last)))
        up_to, last = anchored.compose(parts, span, 0)
        assert len(up_to) <= len(parts[0][0]) + 1
        ends = np.arange(-3, span + 1)
        want = ends
        for one_up_to, one_last in parts:
            want = anchored.leaves_at(one_up_to, one_last, span, want)
        assert anchored.leaves_at(up_to, last, span, ends).tolist() == want.tolist()


@pytest.mark.parametrize("fan", [2, 512])
def test_evenly_spaced_times_over_many_levels(spark, fan, monkeypatch):
    """Chains that never fall together: spacing and span share no divisor. Times lie on both sides of 0."""
    monkeypatch.setattr(anchored, "LONGEST_US", 40_000)
    assert anchored.levels_of(300, 2) == 8
    df = spark.range(-900, 900).selectExpr("'k' as k", "id * 37 as ts_us")
    got = sorted((r["ts_us"], r["start_us"]) for r in anchored.anchor_windows(df, ["k"], span_us=100, block_spans=3, fan=fan).collect())
    want, start = [], None
    for t in range(-900 * 37, 900 * 37, 37):
        start = t if start is None or t >= start + 100 else start
        want.append((t, start))
    assert got == want


def test_cooldown_lets_keyless_alerts_pass(spark):
    rows = [("a", 0, "S", "1"), ("b", 99, "S", "1"), ("c", 100, "S", "1"), ("d", 150, "S", "1"), ("e", 1, "", "1"), ("f", 2, "S", None), ("g", 100, "S", "1")]
    df = spark.createDataFrame(rows, "alert_id string, ts_us bigint, matched_scenario string, src_ip string")
    assert sorted(r[0] for r in anchored.cooldown(df, window_us=100).select("alert_id").collect()) == ["a", "c", "e", "f"]


def test_running_totals_read_one_shuffle(spark, conn):
    """Both levels of the totals take the same shuffle, whatever the families below it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (groups.group_features(conn, {}, window_us=W), profiles.ip_profile(conn, window_us=W), profiles.concurrency(conn)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan.splitlines()) == 1
            assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" in line for line in plan.splitlines()) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
