"""Rows with null keys or times stay in window operators."""

from __future__ import annotations

from flowlens.operators.profiles import arrival_gap, backfill


def test_null_keys_stay(spark):
    rows = [("a", 0, "u1", None), ("a", 5, "u2", 2.0), (None, 1, "u3", None), (None, 4, "u4", 3.0), ("b", None, "u5", None)]
    df = spark.createDataFrame(rows, "orig_h string, ts_us long, uid string, v double")
    assert {r["uid"]: r["gap_us"] for r in arrival_gap(df, ["orig_h"]).collect()} == {"u1": 0, "u2": 5, "u3": 0, "u4": 3, "u5": 0}
    assert {r["uid"]: r["v"] for r in backfill(df, ["v"]).collect()} == {"u1": 2.0, "u2": 2.0, "u3": 3.0, "u4": 3.0, "u5": 0.0}
