"""What runs leave on the disks, and what the sliding families move."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from flowlens.operators import groups, profiles
from flowlens.operators.sliding import BLOCK_WINDOWS, Group, slide
from flowlens.session import cut_lineage, release

W = 1_000
COLUMNS = "ts_us bigint, uid string, orig_h string, resp_h string, resp_p bigint, proto string, conn_state string, duration double, orig_bytes bigint"


def all_families():
    return [groups.beacon_group(), groups.horizontal_group(), groups.vertical_group(), groups.ddos_group(), groups.env_group(),
            profiles.profile_group(), profiles.concurrency_group()]


def all_measures():
    return {**groups.measures(), **profiles.profile_measures()}


def rows_over_blocks(n=400, seed=11):
    """Times on and beside the ends of windows and blocks, before 0 too; ties, nulls and equal rows."""
    rng, block = random.Random(seed), BLOCK_WINDOWS * W
    rows = []
    for i in range(n):
        near = rng.choice([0, W, block - W, block]) + rng.choice([-1, 0, 1])
        ts = rng.choice([rng.randrange(-2 * block, 4 * block), near + block * rng.randrange(-2, 3)])
        rows.append((ts if rng.random() > 0.03 else None, f"u{i}", rng.choice(["a", "b", "", None]), rng.choice(["x", "y", "", None]), rng.choice([22, 80, None]),
                     rng.choice(["tcp", "udp", None]), rng.choice(["SF", "REJ", None]), rng.choice([0.0, 0.0015, 0.009, -1.0, None]), rng.choice([0, 100, 7_000_000, None])))
    return rows + rows[:20]


def shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return sum(files.apply(i).getName().endswith(".data") for i in range(files.size()))


@pytest.fixture(scope="module")
def conn(spark):
    return spark.createDataFrame(rows_over_blocks(), COLUMNS)


def test_families_together_equal_each_alone(conn):
    """Several families go by blocks, one alone by slots and totals."""
    families = [*all_families(), Group("recent", ("resp_h",), include_current=True, measures=("n", "ob_sq"), distinct={"ports": "resp_p"}, gaps=True)]
    together = slide(conn, families, window_us=W, measures=all_measures())
    assert together.columns == [*conn.columns, *[f"{g.name}__{o}" for g in families for o in g.outputs()]]
    for g in families:
        outs = [f"{g.name}__{o}" for o in g.outputs()]
        alone = slide(conn, [g], window_us=W, measures=all_measures())
        assert alone.select(*conn.columns, *outs).dtypes == together.select(*conn.columns, *outs).dtypes
        got, want = (sorted(map(repr, d.select(*conn.columns, *outs).collect())) for d in (together, alone))
        assert got == want


def test_families_take_few_shuffles(spark, conn):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = slide(conn, all_families(), window_us=W, measures=all_measures())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) <= 10


def test_settled_frames_leave_no_shuffles(spark, conn):
    counted = conn.groupBy("orig_h").agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    settled = cut_lineage(counted)
    for _ in range(40):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.25)
    assert shuffle_files(spark) <= before
    assert sorted(r["n"] for r in settled.collect()) == sorted(r["n"] for r in counted.collect())


def test_released_frames_leave_the_disk(conn):
    settled = cut_lineage(conn)
    path = settled._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    release(settled)
    assert not os.path.exists(path)
