"""Exact selection with small brackets, ordered totals in many ranges, and the writers."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.fixtures import view
from flowlens.models.transforms import OneHot
from flowlens.operators import correlate, quantiles
from flowlens.sources import sinks, zeek


@pytest.mark.parametrize("bracket_rows", [3, 100_000])
def test_selection_from_skewed_columns(spark, bracket_rows):
    rng = random.Random(bracket_rows)
    n = 30_000
    a = [rng.lognormvariate(0, 4) for _ in range(n)]
    b = [7.0 if rng.random() < 0.6 else rng.choice([6.999999, 7.000001, rng.random() * 1e9, -1e9]) for _ in range(n)]
    c = [rng.randint(0, 3) for _ in range(n)]
    d = [1.0] * n
    d[5] = None
    df = spark.createDataFrame(list(zip(a, b, c, d)), "a double, b double, c int, d double")
    places = lambda m: [0, 1, m // 100, m // 3, m // 2, m - 2, m - 1]
    found = quantiles.order_statistics(df, list("abcd"), places, bracket_rows=bracket_rows)
    for name, values in zip("abcd", (a, b, c, d)):
        values = sorted(v for v in values if v is not None)
        assert found[name] == (len(values), {r: float(values[r]) for r in places(len(values))}), name


def test_ordered_totals_over_many_ranges(spark):
    rng = random.Random(9)
    keys = rng.sample(range(10_000), 500)
    rows = [(k, rng.randint(0, 5)) for k in keys]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    for descending in (False, True):
        got = {r.k: r.before_v for r in quantiles.ordered_totals(df, "k", ["v"], range_rows=20, descending=descending).collect()}
        total, want = 0, {}
        for k, v in sorted(rows, reverse=descending):
            want[k], total = total, total + v
        assert got == want
    assert quantiles.ordered_totals(df.filter("false"), "k", ["v"]).count() == 0


def test_too_many_categories_are_named(spark):
    df = spark.range(12).select(F.col("id").cast("string").alias("p"), F.lit("x").alias("q"))
    assert len(OneHot(["p", "q"], most=12).fit(df).feature_names()) == 13
    with pytest.raises(ValueError, match="'p': 12"):
        OneHot(["p", "q"], most=11).fit(df)


def test_daily_alerts_and_feedback_can_be_written_again(spark, sf_dir, tmp_path):
    alerts = view(spark, sf_dir, "alerts")
    for batch, part in (("a", alerts.filter("dst_port % 2 = 0")), ("b", alerts.filter("dst_port % 2 = 1")), ("b", alerts.filter("dst_port % 2 = 1"))):
        sinks.append_daily(part, str(tmp_path / "daily"), batch)
        sinks.append_feedback(sinks.feedback_rows(part, F.when(F.col("dst_port") % 3 == 0, "TP").when(F.col("dst_port") % 3 == 1, "FP").otherwise("?")), str(tmp_path / "feedback"), batch)
    back = spark.read.json(str(tmp_path / "daily"))
    assert back.count() == alerts.count() == back.select("alert_id").distinct().count()
    assert back.filter(F.to_date(F.timestamp_micros("ts_us")) != F.col("alert_date")).count() == 0
    judged = spark.read.json(str(tmp_path / "feedback"))
    assert judged.count() == alerts.filter("dst_port % 3 < 2").count() == judged.select("alert_id").distinct().count()
    assert {r.feedback for r in judged.select("feedback").distinct().collect()} == {"TP", "FP"}


def test_export_report_and_compact_states(spark, sf_dir, tmp_path):
    evidence = correlate.correlate(view(spark, sf_dir, "alerts"), window_us=300_000_000)
    found = correlate.findings(evidence)
    sinks.export_findings(found, evidence, str(tmp_path / "bundle"))
    head = spark.read.json(str(tmp_path / "bundle" / "metadata")).first()
    assert head["total_findings"] == spark.read.json(str(tmp_path / "bundle" / "findings")).count() == found.count()
    assert head["total_events"] == spark.read.json(str(tmp_path / "bundle" / "events")).count() == evidence.count()
    sinks.write_report(found.groupBy("severity").count(), str(tmp_path / "report"))
    assert sum(r["count"] for r in spark.read.json(str(tmp_path / "report")).collect()) == found.count()
    states = spark.createDataFrame([("f", 1, 5), ("f", 3, 2), ("g", 2, 2)], "finding_id string, timestamp_us bigint, evidence_count int")
    more = spark.createDataFrame([("f", 3, 9)], "finding_id string, timestamp_us bigint, evidence_count int")
    rows = sinks.append_compact(states, more)
    assert [r.timestamp_us for r in rows.collect()] == [1, 2, 3, 3]
    assert sorted(tuple(r) for r in sinks.latest_compact(rows).collect()) == [("f", 3, 9), ("g", 2, 2)]
    lines = tmp_path / "findings.jsonl"
    lines.write_text("\n".join([json.dumps({"finding_id": "f", "risk_score": 7}), "{cut", ""]))
    kind = T.StructType([T.StructField("finding_id", T.StringType()), T.StructField("risk_score", T.IntegerType())])
    assert [tuple(r) for r in zeek.read_findings(spark, str(lines), kind).collect()] == [("f", 7)]
