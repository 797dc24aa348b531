import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.models.autoencoder import Autoencoder, gradient, load_reconstruction
from flowlens.models.forest import IsolationForest, IsolationForestModel, average_path, draw_samples
from flowlens.models.importance import dealt, permutation_importance
from flowlens.models.recon import Reconstruction
from flowlens.models.transforms import OneHot, RobustScale, error_attribution
from flowlens.operators.evaluation import pr_auc, roc_auc
from flowlens.operators.quantiles import column_quantiles, time_split


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    x[:5, 2] += 25.0
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, x array<double>")


def test_forest_ranks_planted_outliers_first(cloud, tmp_path, spark):
    model = IsolationForest(trees=60, contamination=0.02).fit(cloud)
    scored = model.transform(cloud).orderBy("isof_score")
    # row 295 is an extreme of its own: a plain forest over uniform samples puts it among the five for some seeds
    assert set(range(5)) <= {r["id"] for r in scored.limit(10).collect()}
    again = IsolationForest(trees=60, contamination=0.02).fit(cloud.repartition(7))
    assert again.nodes.equals(model.nodes)
    model.save(str(tmp_path / "m"))
    loaded = IsolationForestModel.load(str(tmp_path / "m"))
    assert loaded.transform(cloud).orderBy("id").first()["isof_score"] == pytest.approx(model.transform(cloud).orderBy("id").first()["isof_score"])
    top = model.attribute(cloud.filter("id < 5"), list("abcd")).select(F.expr("top_features[0].feature"), F.expr("top_features[0].direction")).distinct().collect()
    assert [tuple(r) for r in top] == [("c", "anomaly")]
    ranked = permutation_importance(cloud, model, list("abcd"), repeats=2).collect()
    assert {r["feature"] for r in ranked} == set("abcd") and all(r["importance"] > 0 for r in ranked)


def test_every_tree_samples_all_rows(spark):
    # many equal rows beside outliers: samples are full, and equal rows are drawn one by one
    for value in (0.0, 2.0, 3.0):
        equal = spark.range(0, 300_000, 1, 8).select(F.array(F.lit(value), F.lit(1.0)).alias("x"))
        rows = equal.unionByName(spark.range(30).select(F.array(F.col("id") + 50.5, F.lit(9.0)).alias("x")))
        sample = draw_samples(rows, 20, 256).groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("row_hash").alias("kinds")).collect()
        assert len(sample) == 20 and {r.n for r in sample} == {256}
        assert max(r.kinds for r in sample) <= 4  # 30 of 300 030 rows
    few = spark.createDataFrame([([1.0],)] * 5 + [([2.0],)], "x array<double>")
    assert sorted(tuple(r) for r in draw_samples(few, 3, 256).groupBy("tree").agg(F.count("*"), F.count_distinct("row_hash")).collect()) == [(t, 6, 2) for t in range(3)]
    # no pool: the trees together reach more rows than any fixed number
    wide = spark.range(0, 60_000, 1, 8).select("id", F.array(F.col("id").cast("double")).alias("x"))
    drawn = draw_samples(wide, 120, 256)
    assert drawn.count() == 120 * 256
    reached = drawn.select("row_hash").distinct().count()
    expected = 60_000 * (1 - (1 - 1 / 60_000) ** (120 * 256))
    assert abs(reached - expected) < 0.02 * expected and reached > 16_384
    assert draw_samples(wide.repartition(3), 120, 256).exceptAll(drawn).count() == 0


def test_importance_equals_brute_force(spark, cloud):
    model = Reconstruction(2).fit(cloud)
    found = {r.feature: r.importance for r in permutation_importance(cloud, model, list("abcd"), repeats=3, group_rows=50).collect()}
    rows = cloud.select(F.monotonically_increasing_id().alias("row_"), "x")
    groups = {}
    for r in sorted(dealt(rows, 3, 50, 7).collect(), key=lambda r: (r.place_, r.row_)):
        groups.setdefault((r.repeat_, r.group_), []).append(np.array(r.x))
    assert len(groups) > 10 and sum(map(len, groups.values())) == 1200
    error = lambda v: float(((v - model.rebuilt(v)) ** 2).mean())
    for i, name in enumerate("abcd"):
        total = 0.0
        for xs in groups.values():
            for k, x in enumerate(xs):
                y = x.copy()
                y[i] = xs[(k + 1) % len(xs)][i]
                total += abs(error(y) - error(x))
        assert found[name] == pytest.approx(total / 1200)


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_full_width_reconstruction_is_exact(cloud):
    out = Reconstruction(4).fit(cloud).transform(cloud)
    assert out.agg(F.max("ae_error")).first()[0] < 1e-9
    assert Reconstruction(1).fit(cloud).transform(cloud).agg(F.avg("ae_error")).first()[0] > 0.1


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    x, sizes = rng.normal(size=(7, 3)), [3, 4, 2, 3]
    weights = rng.normal(size=sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:])))
    for kind in ("tanh", "relu"):
        _, grad = gradient(x, weights, sizes, kind)
        for i in range(0, len(weights), 5):
            step = np.zeros_like(weights)
            step[i] = 1e-6
            near = (gradient(x, weights + step, sizes, kind)[0] - gradient(x, weights - step, sizes, kind)[0]) / 2e-6
            assert grad[i] == pytest.approx(near, rel=1e-4, abs=1e-6)


def test_autoencoder_follows_a_curve(spark, tmp_path):
    t = np.random.default_rng(5).uniform(-1.5, 1.5, 600)
    curve = spark.createDataFrame([(i, [float(a), float(a * a), float(np.sin(2 * a))]) for i, a in enumerate(t)], "id int, x array<double>")
    mean_error = lambda model: model.transform(curve).agg(F.avg("ae_error")).first()[0]
    model = Autoencoder((8, 1, 8), activation="tanh", iterations=60).fit(curve.repartition(6))
    assert mean_error(model) < 0.3 * mean_error(Reconstruction(1).fit(curve))
    model.save(str(tmp_path / "ae"))
    again = load_reconstruction(spark, str(tmp_path / "ae"))
    assert again.transform(curve).select("id", "ae_error").exceptAll(model.transform(curve).select("id", "ae_error")).count() == 0
    with pytest.raises(ValueError):
        Autoencoder((2,)).fit(curve.filter("false"))


def test_error_attribution_shares(spark):
    df = spark.createDataFrame([([1.0, 5.0, 0.0], [1.0, 2.0, 1.0])], "x array<double>, r array<double>")
    top = error_attribution(df, "x", "r", top_n=2).first()["top_features"]
    assert [(t["position"], t["error"], round(t["percent"], 6)) for t in top] == [(1, 9.0, 90.0), (2, 1.0, 10.0)]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.exponential(size=999), np.repeat([1.0, 2.0, 50.0], 333)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    got = column_quantiles(df, ["a", "b"], [0.01, 0.25, 0.5, 0.99])
    assert got["a"] == pytest.approx(np.quantile(a, [0.01, 0.25, 0.5, 0.99]).tolist())
    assert got["b"] == pytest.approx(np.quantile(b, [0.01, 0.25, 0.5, 0.99]).tolist())


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "a double")
    assert {r[0] for r in RobustScale(["a"]).fit(df).transform(df).collect()} == {0.0}


def test_one_hot_unknown_and_binary(spark):
    train = spark.createDataFrame([("a", "t"), ("b", "f"), ("c", "t")], "p string, q string")
    model = OneHot(["p", "q"]).fit(train)
    assert model.feature_names() == ["p_a", "p_b", "p_c", "q_t"]
    assert tuple(model.transform(spark.createDataFrame([("zz", None)], "p string, q string")).select(*model.feature_names()).first()) == (0, 0, 0, 0)


def test_auc_edges(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (0, 2.0), (0, 1.0)], "y int, s double")
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(0.875)
    assert 0.8 < pr_auc(df, "y", "s").first()[0] <= 1.0


def test_time_split_ties(spark):
    df = spark.createDataFrame([(5, f"u{i}") for i in range(10)], "ts_us bigint, uid string")
    rows = {r["uid"]: r["in_train"] for r in time_split(df, 0.3).collect()}
    assert sum(rows.values()) == 3 and rows["u0"] and rows["u2"] and not rows["u3"]


def test_a_filter_on_scores_does_not_score_twice(spark):
    rows = spark.range(300).select("id", F.array((F.col("id") % 17).cast("double"), F.sqrt("id")).alias("x"))
    forest, recon = IsolationForest(trees=5).fit(rows), Reconstruction(1).fit(rows)
    features = spark.range(300).select("id", F.array((F.col("id") % 17).cast("double"), F.sqrt("id")).alias("x"))
    scored = recon.transform(forest.transform(features))
    odd = scored.withColumns({"low": F.col("isof_score") < 0, "high": F.col("ae_error") > 1.0}).filter("low or high")
    plan = odd._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("score(") == 1 and plan.count("project(") == 1 and plan.count("SQRT(") == 1
    assert sorted(r["id"] for r in odd.collect()) == sorted(r["id"] for r in scored.collect() if r["isof_score"] < 0 or r["ae_error"] > 1.0)
