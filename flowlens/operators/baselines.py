"""Baselines learned from history and the z-scores taken against them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.conn import failed_connection
from flowlens.models.stages import Stage, read_json, write_json
from flowlens.operators.groups import group_features, measures
from flowlens.operators.profiles import join_null_safe
from flowlens.operators.sliding import Group, previous_time, sample_std, square
from flowlens.session import cut_lineage, shuffles_dropped

BEACON = ["orig_h", "resp_h", "resp_p", "proto"]
HORIZONTAL = ["orig_h", "resp_p"]
VERTICAL = ["orig_h", "resp_h"]
DDOS = ["resp_h", "resp_p"]

# --- fixed values: what holds before anything was learned --------------------
ENV_DEFAULTS = {
    "problematic_ratio": 0.0, "duration_std": 0.0, "orig_bytes_std": 0.0,
    "beacon_channel_timediff_std_mean": 30.0, "beacon_channel_timediff_std_std": 15.0,
    "median_horizontal_unique_dst_ip_count": 0.0, "median_vertical_unique_dst_port_count": 0.0,
    "median_beacon_group_count": 2.0, "median_ddos_unique_src_ip_count": 0.0,
}
EXPERT_BEACON = {
    "median_beacon_group_count": 2.0, "std_beacon_group_count": 5.0,
    "beacon_channel_timediff_std_mean": 30.0, "beacon_channel_timediff_std_std": 15.0,
}
Z_LIMIT = 8.0
WARM_UP_ROWS = 200
# -----------------------------------------------------------------------------

ENTITY_METRICS = ["horizontal_unique_dst_ip_count", "vertical_unique_dst_port_count", "problematic_ratio", "duration_std", "orig_bytes_std"]


def _steps(df: DataFrame) -> DataFrame:
    """Time steps between successive distinct times of a beacon group. Rows at the
    same time have a step of 0, which adds nothing to either total."""
    points = df.select(*BEACON, "ts_us").distinct()
    step = F.col("ts_us") - F.col("prev")
    return previous_time(points, BEACON, "ts_us").filter(F.col("prev").isNotNull()).select(*BEACON, step.alias("step"))


def beacon_fit(df: DataFrame) -> DataFrame:
    """Count and spread per beacon group; the first step of a group counts as 0."""
    rows = df.withColumns({f"_{k}": v for k, v in measures().items()}).groupBy(*BEACON).agg(
        F.count("*").alias("n"), *[F.sum(f"_{c}").alias(c) for c in ("dur", "dur_sq", "ob", "ob_sq")])
    gaps = _steps(df).groupBy(*BEACON).agg(F.sum("step").alias("gap"), F.sum(square(F.col("step"))).alias("gap_sq"))
    both = join_null_safe(rows, gaps, BEACON, "left").fillna(0, ["gap"]).withColumn("gap_sq", F.coalesce("gap_sq", F.lit(0).cast("decimal(38,0)")))
    n, mean = F.col("n"), F.col("gap") / F.col("n") / 1e6
    std = sample_std(n, F.col("gap"), F.col("gap_sq"), 1e6)
    return both.select(
        *BEACON, n.alias("beacon_group_count"),
        mean.alias("beacon_group_mean_interval"),
        F.when(mean > 0, std / mean).otherwise(0.0).alias("beacon_group_cv"),
        std.alias("beacon_channel_timediff_std"),
        (F.col("dur") / n / 1e6).alias("beacon_group_mean_duration"),
        sample_std(n, F.col("dur"), F.col("dur_sq"), 1e6).alias("beacon_channel_duration_std"),
        (F.col("ob") / n).alias("beacon_group_mean_orig_bytes"),
        sample_std(n, F.col("ob"), F.col("ob_sq")).alias("beacon_channel_orig_bytes_std"),
    )


def horizontal_fit(df: DataFrame) -> DataFrame:
    return df.groupBy(*HORIZONTAL).agg(
        F.countDistinct("resp_h").alias("horizontal_scan_unique_dst_ip_count"),
        F.avg(failed_connection()).alias("horizontal_scan_problematic_ratio"))


def vertical_fit(df: DataFrame) -> DataFrame:
    return df.groupBy(*VERTICAL).agg(
        F.countDistinct("resp_p").alias("vertical_scan_unique_dst_port_count"),
        F.avg(failed_connection()).alias("vertical_scan_problematic_ratio"))


def ddos_fit(df: DataFrame) -> DataFrame:
    return df.groupBy(*DDOS).agg(F.countDistinct("orig_h").alias("ddos_group_unique_src_ip_count"))


def _tall(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    row = df.agg(*[v.alias(k) for k, v in values.items()])
    return row.unpivot([], list(values), "name", "value")


def env_fit(df: DataFrame) -> DataFrame:
    """Baselines of the whole environment as (name, value) rows.

    Three passes over the rows: totals, time steps, and one pre-aggregate by beacon
    group, which the host and port groups roll up from. Exact medians keep one entry
    per distinct count."""
    def std(column: str) -> Column:
        s = F.stddev_samp(column)
        return F.when(s > 0, s).otherwise(1.0)

    failed = failed_connection()
    beacons = cut_lineage(df.groupBy(*BEACON).agg(F.count("*").alias("n"), F.sum(failed).alias("failed"), F.count(failed).alias("known")))

    def rolled(keys: list[str], counted: str) -> DataFrame:
        return beacons.groupBy(*keys).agg(F.countDistinct(counted).alias("n"), (F.sum("failed") / F.sum("known")).alias("ratio"))

    def counts(name: str, ratio: str | None = None) -> dict[str, Column]:
        out = {f"std_{name}": std("n"), f"median_{name}": F.percentile("n", 0.5)}
        return out | ({f"std_{ratio}": std("ratio")} if ratio else {})

    step_std = F.coalesce(F.stddev_samp(F.col("step") / 1e6), F.lit(0.0))
    parts = [
        _tall(df, {
            "problematic_ratio": F.avg(failed_connection()),
            "duration_std": F.stddev_samp(F.coalesce("duration", F.lit(0.0))),
            "orig_bytes_std": F.stddev_samp(F.coalesce("orig_bytes", F.lit(0))),
        }),
        _tall(_steps(df), {
            "beacon_channel_timediff_std_mean": F.when(step_std > 0, step_std).otherwise(ENV_DEFAULTS["beacon_channel_timediff_std_mean"]),
            "beacon_channel_timediff_std_std": F.when(step_std > 0, step_std * 0.5).otherwise(ENV_DEFAULTS["beacon_channel_timediff_std_std"]),
        }),
        _tall(rolled(HORIZONTAL, "resp_h"), counts("horizontal_unique_dst_ip_count", "horizontal_problematic_ratio")),
        _tall(rolled(VERTICAL, "resp_p"), counts("vertical_unique_dst_port_count", "vertical_problematic_ratio")),
        _tall(beacons, counts("beacon_group_count")),
        _tall(rolled(DDOS, "orig_h"), counts("ddos_unique_src_ip_count")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_env(fitted: Mapping[str, float], manual: Mapping[str, float] | None = None, *, reference_mode: bool = False) -> dict[str, float]:
    """Manual values win over fitted ones, those over defaults. In reference mode
    manual values switch fitted ones off altogether."""
    learned = {} if (manual and reference_mode) else {k: v for k, v in fitted.items() if v is not None}
    return {**ENV_DEFAULTS, **learned, **(manual or {})}


def entity_buckets(df: DataFrame, *, window_us: int, key: str = "orig_h") -> DataFrame:
    """Behaviour per entity and tumbling bucket."""
    return df.groupBy(key, F.expr(f"ts_us div {window_us}").alias("bucket")).agg(
        F.countDistinct("resp_h").alias("horizontal_unique_dst_ip_count"),
        F.countDistinct("resp_p").alias("vertical_unique_dst_port_count"),
        F.avg(failed_connection()).alias("problematic_ratio"),
        F.coalesce(F.stddev_samp(F.coalesce("duration", F.lit(0.0))), F.lit(0.0)).alias("duration_std"),
        F.coalesce(F.stddev_samp(F.coalesce("orig_bytes", F.lit(0))), F.lit(0.0)).alias("orig_bytes_std"),
    )


def entity_gap(df: DataFrame) -> DataFrame:
    """Spread of all non-zero steps of an entity."""
    s = F.coalesce(F.stddev_samp(F.col("step") / 1e6), F.lit(0.0))
    return _steps(df).groupBy("orig_h").agg(
        s.alias("beacon_channel_timediff_std_mean"),
        F.greatest(s * 0.5, F.lit(1.0)).alias("beacon_channel_timediff_std_std"))


def entity_fit(df: DataFrame, *, window_us: int) -> DataFrame:
    """Mean and spread of the bucket metrics per entity."""
    def spread(c: str) -> Column:
        s = F.stddev_samp(c)
        return F.when(s > 0, s).otherwise(1.0)

    stats = [x for c in ENTITY_METRICS for x in (F.avg(c).alias(f"{c}_mean"), spread(c).alias(f"{c}_std"))]
    means = entity_buckets(df, window_us=window_us).groupBy("orig_h").agg(*stats)
    return means.join(entity_gap(df), "orig_h", "left").fillna(
        {"beacon_channel_timediff_std_mean": 0.0, "beacon_channel_timediff_std_std": 1.0})


# z-score -> (value, entity baseline, env mean, env std); no entity baseline for
# counts that are only known for the environment.
_Z = {
    "z_horizontal_unique_dst_ip_count": ("horizontal_scan_unique_dst_ip_count", "horizontal_unique_dst_ip_count",
                                         "median_horizontal_unique_dst_ip_count", "std_horizontal_unique_dst_ip_count"),
    "z_horizontal_problematic_ratio": ("horizontal_scan_problematic_ratio", "problematic_ratio",
                                       "problematic_ratio", "std_horizontal_problematic_ratio"),
    "z_vertical_unique_dst_port_count": ("vertical_scan_unique_dst_port_count", "vertical_unique_dst_port_count",
                                         "median_vertical_unique_dst_port_count", "std_vertical_unique_dst_port_count"),
    "z_vertical_problematic_ratio": ("vertical_scan_problematic_ratio", "problematic_ratio",
                                     "problematic_ratio", "std_vertical_problematic_ratio"),
    "z_beacon_group_count": ("beacon_group_count", None, "median_beacon_group_count", "std_beacon_group_count"),
    "z_ddos_group_unique_src_ip_count": ("ddos_group_unique_src_ip_count", None,
                                         "median_ddos_unique_src_ip_count", "std_ddos_unique_src_ip_count"),
    "z_beacon_channel_timediff_std": ("beacon_channel_timediff_std", "beacon_channel_timediff_std",
                                      "beacon_channel_timediff_std_mean", "beacon_channel_timediff_std_std"),
    "z_beacon_channel_duration_std": ("beacon_channel_duration_std", "duration_std", "duration_std", "duration_std"),
    "z_beacon_channel_orig_bytes_std": ("beacon_channel_orig_bytes_std", "orig_bytes_std", "orig_bytes_std", "orig_bytes_std"),
}
Z_COLUMNS = list(_Z)


def z_columns(env: Mapping[str, float]) -> dict[str, Column]:
    """z-scores over rows that carry the entity columns prefixed ``ent_``."""
    out = {}
    for name, (value, entity, mean_key, std_key) in _Z.items():
        x = F.col(value).cast("double")
        mean, std = F.lit(float(env.get(mean_key, 0.0))), F.lit(float(env.get(std_key, 1.0)))
        if entity:
            mean, std = F.coalesce(F.col(f"ent_{entity}_mean"), mean), F.coalesce(F.col(f"ent_{entity}_std"), std)
            std = F.when(std <= 0, 1.0).otherwise(std)
        z = (x - mean) / F.greatest(std, F.lit(1e-9))
        if entity:
            z = F.when((F.abs(x) < 1e-9) & (F.abs(mean) < 1e-9), 0.0).otherwise(z)
        out[name] = F.greatest(F.least(F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)), F.lit(Z_LIMIT)), F.lit(-Z_LIMIT))
    return out


def with_entity(df: DataFrame, entity: DataFrame) -> DataFrame:
    """Left join of the entity baselines. Their number grows with the hosts seen,
    so the join is left to the planner: it broadcasts only what is small."""
    renamed = entity.select("orig_h", *[F.col(c).alias(f"ent_{c}") for c in entity.columns if c != "orig_h"])
    return df.join(renamed, "orig_h", "left")


class GroupBaselineModel(Stage, Model):
    """Fitted baselines: ``env`` (about twenty numbers) and ``entity`` (a table)."""

    def __init__(self, env: Mapping[str, float], entity: DataFrame, window_us: int, min_samples: int = 3, ready: bool = True):
        super().__init__()
        self.env, self.entity, self.window_us, self.min_samples, self.ready = dict(env), entity, window_us, min_samples, ready

    def features(self, df: DataFrame, *, extra: tuple[Group, ...] = (), extra_measures: Mapping[str, Column] | None = None) -> DataFrame:
        """Raw features and z-scores; ``extra`` groups share the pass."""
        env = self.env if self.ready else ENV_DEFAULTS
        raw = group_features(df, env, window_us=self.window_us, min_samples=self.min_samples, extra=extra, extra_measures=extra_measures)
        entity = self.entity if self.ready else self.entity.limit(0)
        scored = with_entity(raw, entity).withColumns(z_columns(env))
        return scored.drop(*[c for c in scored.columns if c.startswith("ent_")])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.features(df)

    def get_feature_names_out(self) -> list[str]:
        from flowlens.operators.groups import RAW
        return [*RAW, *Z_COLUMNS]

    def write_data(self, spark: SparkSession, path: str) -> None:
        settings = {"env": self.env, "window_us": self.window_us, "min_samples": self.min_samples, "ready": self.ready}
        write_json(spark, settings, f"{path}/settings")
        self.entity.write.mode("overwrite").parquet(f"{path}/entity")

    @classmethod
    def read_data(cls, spark: SparkSession, path: str) -> GroupBaselineModel:
        s = read_json(spark, f"{path}/settings")
        return cls(s["env"], spark.read.parquet(f"{path}/entity"), s["window_us"], s["min_samples"], s["ready"])


class GroupBaseline(Stage, Estimator):
    """Learns environment and entity baselines from typed connections."""

    def __init__(self, window_us: int, min_samples: int = 3, manual: Mapping[str, float] | None = None, *,
                 reference_mode: bool = False, warm_up_rows: int = WARM_UP_ROWS):
        super().__init__()
        self.window_us, self.min_samples, self.manual = window_us, min_samples, manual
        self.reference_mode, self.warm_up_rows = reference_mode, warm_up_rows

    def _fit(self, df: DataFrame) -> GroupBaselineModel:
        with shuffles_dropped(df.sparkSession):
            fitted = {r["name"]: r["value"] for r in env_fit(df).collect()}
        env = merge_env(fitted, self.manual, reference_mode=self.reference_mode)
        enough = df.limit(self.warm_up_rows).count() >= self.warm_up_rows
        return GroupBaselineModel(env, entity_fit(df, window_us=self.window_us), self.window_us, self.min_samples, ready=enough)
