"""Evaluation in one call: scored once, every report against plain Python; sequences of hot findings."""

import json

import pytest
from pyspark.sql import functions as F

from flowlens.fixtures import view
from flowlens.plans import evaluate as V, flows
from flowlens.plans.reports import evidence_sequence, summary_text


@pytest.fixture(scope="module")
def detector(spark, sf_dir):
    return flows.train_dns(view(spark, sf_dir, "dns"), trees=8, code=4)


def test_reports_equal_plain_counts(spark, sf_dir, detector, tmp_path):
    names = F.expr("case when ts_us % 3 = 0 then 'Attack' when ts_us % 3 = 1 then 'benign' end")
    logs = view(spark, sf_dir, "dns").withColumns({"Label": names, "file": F.expr("case when ts_us % 2 = 0 then 'a.log' else 'b.log' end")})
    found = V.evaluate(logs, detector, store=str(tmp_path / "rows"))
    rows = found.rows.collect()
    assert len(rows) == logs.count() and {r["y"] for r in rows} == {0, 1}
    assert all(r["ensemble"] == max(r["isof"], r["ae"]) for r in rows) and any(r["ensemble"] for r in rows)
    for r in found.reports["rates"].collect():
        mine = [x[r["model"]] for x in rows if x["group"] == r["group"]]
        assert (r["lines"], r["alerts"]) == (len(mine), sum(mine)) and r["rate"] == pytest.approx(sum(mine) / len(mine))
    table = {r["model"]: r for r in found.reports["models"].collect()}
    assert set(table) == set(V.MODELS) and table["ensemble"]["roc_auc"] is None
    for m, r in table.items():
        assert r["tp"] == sum(x["y"] and x[m] for x in rows) and r["fp"] == sum((not x["y"]) and x[m] for x in rows)
    pos, neg = ([x["ae_error"] for x in rows if x["y"] == y] for y in (1, 0))
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert table["ae"]["roc_auc"] == pytest.approx(won / len(pos) / len(neg))
    assert {r["policy"] for r in found.reports["thresholds"].collect()} == {"p10", "p5", "p1", "zero"}
    found.write(str(tmp_path / "reports"))
    written = spark.read.json(str(tmp_path / "reports/confusion")).collect()
    assert sum(r["n"] for r in written) == 3 * len(rows), json.dumps([r.asDict() for r in written])


def test_without_labels_only_rates(spark, sf_dir, detector):
    found = V.evaluate(view(spark, sf_dir, "dns"), detector)
    assert set(found.reports) == {"rates", "thresholds"}
    assert {r["group"] for r in found.reports["rates"].collect()} == {"all"}


def test_sequence_of_a_long_finding(spark):
    """Blocks without alerts, equal times, alerts without a time."""
    times = [None, None, 5, 5, 299_999_999, 300_000_000, 9_000_000_000, 9_000_000_000, 9_000_000_001]
    rows = [("f", f"A{i}", t, f"10.0.0.{i}") for i, t in enumerate(times)] + [("g", "B", 7, "10.1.1.1")]
    plain = {"type": "ml_anomaly", "matched_scenario": "C2 Beaconing", "behavior_type": "", "detector": "m", "severity": "High",
             "dst_ip": "b", "dst_port": "1", "proto": "tcp", "service": "s", "conn_state": "SF"}
    frame = spark.createDataFrame(rows, "finding_id string, alert_id string, ts_us long, src_ip string").withColumns({k: F.lit(v) for k, v in plain.items()})
    got = evidence_sequence(frame.repartition(4)).collect()
    assert {r["alert_id"]: r["sequence_id"] for r in got} == {f"A{i}": i + 1 for i in range(len(times))} | {"B": 1}
    assert all(r["connection"]["src_ip"].startswith("10.") for r in got)


def test_summary_of_no_findings(spark):
    none = spark.createDataFrame([], "severity string, src_ip string, finding_type string, proto string")
    assert summary_text(none).collect()[0].asDict() == {"total_findings": 0, "grave": 0, "summary": "No security findings detected in the specified time window."}
