"""Headline timings. Prints one JSON line.

The log-shaped tables are written once per run (not timed) into a new folder, the
way logs arrive: several files. Every query then runs twice, writing to the
``noop`` sink; the second run is reported, so JVM start-up and code generation do
not count.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from flowlens.fixtures import WINDOW_US, table, view
from flowlens.functions.dns import dns_features
from flowlens.models.forest import IsolationForest
from flowlens.models.thresholds import LOW_IS_ODD, calibrate
from flowlens.operators import baselines, correlate, groups, profiles, rules
from flowlens.operators.anchored import cooldown
from flowlens.operators.evaluation import roc_auc
from flowlens.session import build_session
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def main() -> None:
    spark = build_session("bench", master=f"local[{CPUS}]", shuffle_partitions=CPUS)
    spark.sparkContext.setLogLevel("OFF")
    logs = tempfile.mkdtemp(prefix="flowlens-bench-")
    for name in ("conn", "dns", "alerts"):
        view(spark, SF_DIR, name).repartition(CPUS).write.parquet(f"{logs}/{name}")
    conn, dns, alerts = (spark.read.parquet(f"{logs}/{n}") for n in ("conn", "dns", "alerts"))
    lines = table(spark, SF_DIR, "lineitem").withColumn("price", F.col("l_extendedprice").cast("double"))
    vectors = table(spark, SF_DIR, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    entity = baselines.entity_fit(conn, window_us=WINDOW_US)
    model = baselines.GroupBaselineModel(baselines.ENV_DEFAULTS, entity, WINDOW_US)

    queries = {
        "dns_features": lambda: dns_features(dns),
        "dns_rules": lambda: rules.classify(dns_features(dns).filter(rules.either()), rules.dns_rules(), rules.dns_fallback()),
        "ip_profile": lambda: profiles.ip_profile(conn, window_us=WINDOW_US),
        "concurrency": lambda: profiles.concurrency(conn),
        "beacon": lambda: groups.beacon(conn, window_us=WINDOW_US),
        "horizontal": lambda: groups.horizontal(conn, window_us=WINDOW_US),
        "group_z_scores": lambda: model.transform(conn),
        "environment_fit": lambda: baselines.env_fit(conn),
        "entity_fit": lambda: entity,
        "cooldown": lambda: cooldown(alerts, window_us=WINDOW_US),
        "findings": lambda: correlate.findings(correlate.correlate(alerts, window_us=WINDOW_US)),
        "calibrate": lambda: calibrate(lines, "price", LOW_IS_ODD),
        "roc_auc": lambda: roc_auc(lines.withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "y", "price"),
        "forest_fit_score": lambda: IsolationForest(trees=100).fit(vectors).transform(vectors),
    }
    seconds = {}
    for name, build in queries.items():
        for _ in range(2):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
