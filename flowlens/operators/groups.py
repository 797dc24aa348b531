"""Sliding features of host and port groups, excluding the row itself."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.conn import failed_connection
from flowlens.operators.profiles import duration_us
from flowlens.operators.sliding import Group, sample_std, slide, square

RAW = ["horizontal_scan_unique_dst_ip_count", "horizontal_scan_problematic_ratio", "vertical_scan_unique_dst_port_count",
       "vertical_scan_problematic_ratio", "beacon_group_count", "beacon_group_cv", "beacon_channel_timediff_std",
       "beacon_channel_duration_std", "beacon_channel_orig_bytes_std", "ddos_group_unique_src_ip_count"]


def _present(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def measures() -> dict[str, Column]:
    dur, ob = duration_us(), F.coalesce(F.col("orig_bytes"), F.lit(0))
    return {"failed": failed_connection(), "dur": dur, "dur_sq": square(dur), "ob": ob, "ob_sq": square(ob)}


_SPREAD = ("n", "dur", "dur_sq", "ob", "ob_sq")


def beacon_group() -> Group:
    return Group("beacon", ("orig_h", "resp_h", "resp_p", "proto"), measures=_SPREAD, gaps=True)


def horizontal_group() -> Group:
    return Group("horizontal", ("orig_h", "resp_p"), measures=("n", "failed"), distinct={"hosts": _present("resp_h")})


def vertical_group() -> Group:
    return Group("vertical", ("orig_h", "resp_h"), measures=("n", "failed"), distinct={"ports": "resp_p"})


def ddos_group() -> Group:
    return Group("ddos", ("resp_h", "resp_p"), distinct={"sources": _present("orig_h")})


def env_group() -> Group:
    return Group("env", (), measures=(*_SPREAD, "failed"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def beacon_columns() -> dict[str, Column]:
    """Raw beacon statistics from the totals of :func:`beacon_group`."""
    n = F.col("beacon__n")
    steps = n - 1
    interval_std = sample_std(steps, F.col("beacon__gap"), F.col("beacon__gap_sq"), 1e6)
    mean = ratio(F.col("beacon__gap") / 1e6, steps)
    return {
        "beacon_group_count": n,
        "beacon_interval_mean": F.when(n >= 2, mean).otherwise(0.0),
        "beacon_interval_std": F.when(n >= 2, interval_std).otherwise(0.0),
        "beacon_group_cv": F.when((n >= 2) & (mean > 0), interval_std / mean).otherwise(0.0),
        "beacon_duration_std": sample_std(n, F.col("beacon__dur"), F.col("beacon__dur_sq"), 1e6),
        "beacon_orig_bytes_std": sample_std(n, F.col("beacon__ob"), F.col("beacon__ob_sq")),
    }


def _without_totals(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "__" in c])


def _one(df: DataFrame, group: Group, window_us: int, columns: Mapping[str, Column]) -> DataFrame:
    totals = slide(df, [group], window_us=window_us, measures=measures())
    return _without_totals(totals.withColumns(dict(columns)))


def beacon(df: DataFrame, *, window_us: int) -> DataFrame:
    return _one(df, beacon_group(), window_us, beacon_columns())


def horizontal_columns() -> dict[str, Column]:
    return {"horizontal_scan_unique_dst_ip_count": F.col("horizontal__hosts"),
            "horizontal_ratio": ratio(F.col("horizontal__failed"), F.col("horizontal__n"))}


def vertical_columns() -> dict[str, Column]:
    return {"vertical_scan_unique_dst_port_count": F.col("vertical__ports"),
            "vertical_ratio": ratio(F.col("vertical__failed"), F.col("vertical__n"))}


def horizontal(df: DataFrame, *, window_us: int) -> DataFrame:
    return _one(df, horizontal_group(), window_us, horizontal_columns())


def vertical(df: DataFrame, *, window_us: int) -> DataFrame:
    return _one(df, vertical_group(), window_us, vertical_columns())


def ddos(df: DataFrame, *, window_us: int) -> DataFrame:
    return _one(df, ddos_group(), window_us, {"ddos_group_unique_src_ip_count": F.col("ddos__sources")})


def env_columns(env: Mapping[str, float]) -> dict[str, Column]:
    """Live baseline of everything in the window; fitted values while it is empty."""
    n = F.col("env__n")

    def live(value: Column, name: str) -> Column:
        return F.when(n > 0, value).otherwise(F.lit(float(env.get(name, 0.0))))

    return {
        "env_problematic_ratio": live(F.col("env__failed") / n, "problematic_ratio"),
        "env_duration_std": live(sample_std(n, F.col("env__dur"), F.col("env__dur_sq"), 1e6, ddof=0), "duration_std"),
        "env_orig_bytes_std": live(sample_std(n, F.col("env__ob"), F.col("env__ob_sq"), ddof=0), "orig_bytes_std"),
    }


def env_live(df: DataFrame, *, window_us: int, env: Mapping[str, float] | None = None) -> DataFrame:
    return _one(df, env_group(), window_us, env_columns(env or {}))


def blend(local: Column, env: Column, n: Column, k: int) -> Column:
    """Trust the group in proportion to its rows, up to ``k`` of them."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / F.lit(float(k))))
    return local * w + env * (F.lit(1.0) - w)


def cap(local: Column, mult: float, env: Column) -> Column:
    top = F.greatest(F.lit(1.0), F.lit(float(mult)) * F.greatest(env, F.lit(1e-6)))
    return F.least(F.greatest(local, F.lit(0.0)), top)


def blended_columns(env: Mapping[str, float], min_samples: int = 3) -> dict[str, Column]:
    """Raw statistics blended with the live baseline where data is sparse."""
    k = max(1, min_samples)
    n = F.col("beacon_group_count")
    env_gap = F.lit(float(env.get("beacon_channel_timediff_std_mean", 0.0)))

    def channel(local: str, base: Column) -> Column:
        return F.when(n >= 2, blend(cap(F.col(local), 10.0, base), base, n, k)).otherwise(base)

    steady = (F.col("beacon_interval_std") > 0) & (n >= 4)
    one, ambient = F.lit(1.0), F.col("env_problematic_ratio")
    return {
        "beacon_channel_timediff_std": F.when(steady, blend(cap(F.col("beacon_interval_std"), 10.0, env_gap), env_gap, n - 1, k)).otherwise(env_gap),
        "beacon_channel_duration_std": channel("beacon_duration_std", F.col("env_duration_std")),
        "beacon_channel_orig_bytes_std": channel("beacon_orig_bytes_std", F.col("env_orig_bytes_std")),
        "horizontal_scan_problematic_ratio": blend(cap(F.col("horizontal_ratio"), 1.0, one), ambient, F.col("horizontal__n"), k),
        "vertical_scan_problematic_ratio": blend(cap(F.col("vertical_ratio"), 1.0, one), ambient, F.col("vertical__n"), k),
    }


def group_features(df: DataFrame, env: Mapping[str, float], *, window_us: int, min_samples: int = 3, extra: tuple[Group, ...] = (), extra_measures: Mapping[str, Column] | None = None) -> DataFrame:
    """The ten raw group features; ``extra`` groups ride along in the same pass
    and keep their totals for the caller."""
    families = [beacon_group(), horizontal_group(), vertical_group(), ddos_group(), env_group(), *extra]
    out = slide(df, families, window_us=window_us, measures={**measures(), **(extra_measures or {})})
    out = out.withColumns({**beacon_columns(), **horizontal_columns(), **vertical_columns(), **env_columns(env),
                           "ddos_group_unique_src_ip_count": F.col("ddos__sources")})
    out = out.withColumns(blended_columns(env, min_samples))
    mine = {g.name for g in families} - {g.name for g in extra}
    scratch = ["beacon_interval_mean", "beacon_interval_std", "beacon_duration_std", "beacon_orig_bytes_std", "horizontal_ratio",
               "vertical_ratio", "env_problematic_ratio", "env_duration_std", "env_orig_bytes_std"]
    return out.drop(*scratch, *[c for c in out.columns if c.split("__")[0] in mine and "__" in c])
