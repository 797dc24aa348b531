"""Behaviour profile of a source address and concurrency of connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.sliding import Group, previous_time, slide, slot_of, SLOT_US

PROFILE = ["concurrent_connections", "ip_profile_uid_rate", "ip_profile_resp_p_rate", "ip_profile_resp_h_rate",
           "ip_profile_conn_state_diversity", "ip_profile_mean_duration", "ip_profile_mean_orig_bytes"]


def duration_us() -> Column:
    return F.round(F.coalesce(F.col("duration"), F.lit(0.0)) * 1e6).cast("bigint")


def profile_group(key: str = "orig_h") -> Group:
    return Group(
        "profile", (key,), include_current=True, measures=("n", "dur", "ob"),
        distinct={"ports": "resp_p", "hosts": "resp_h", "states": "conn_state"},
    )


def profile_measures() -> dict[str, Column]:
    return {"dur": duration_us(), "ob": F.col("orig_bytes")}


def profile_columns(df: DataFrame) -> DataFrame:
    """Turns the totals of :func:`profile_group` into profile columns."""
    n = F.col("profile__n")
    # A row without a source or a time has no window: it stands for itself.
    known = F.col("orig_h").isNotNull() & (F.col("orig_h") != "") & F.col("ts_us").isNotNull() & (F.col("ts_us") != 0)
    own = {"ip_profile_mean_duration": F.coalesce(F.col("duration"), F.lit(0.0)),
           "ip_profile_mean_orig_bytes": F.coalesce(F.col("orig_bytes"), F.lit(0)).cast("double")}
    values = {
        "ip_profile_uid_rate": n,
        "ip_profile_resp_p_rate": F.col("profile__ports"),
        "ip_profile_resp_h_rate": F.col("profile__hosts"),
        "ip_profile_conn_state_diversity": F.col("profile__states"),
        "ip_profile_mean_duration": F.col("profile__dur") / n / 1e6,
        "ip_profile_mean_orig_bytes": F.col("profile__ob") / n,
    }
    out = df.withColumns({c: F.when(known, v).otherwise(own.get(c, F.lit(1))) for c, v in values.items()})
    return out.drop(*[c for c in out.columns if c.startswith("profile__")])


def ip_profile(df: DataFrame, *, window_us: int) -> DataFrame:
    """Rates, diversity and means per source over ``[ts - W, ts]``."""
    totals = slide(df, [profile_group()], window_us=window_us, measures=profile_measures())
    return profile_columns(totals)


def ip_profile_snapshot(df: DataFrame, *, window_us: int) -> DataFrame:
    """Every row gets the *final* window of its source."""
    ends = df.groupBy("orig_h").agg(F.max("ts_us").alias("_end"))
    recent = df.join(ends, "orig_h").filter(F.col("ts_us") >= F.col("_end") - window_us)
    final = recent.groupBy("orig_h").agg(
        F.count("*").alias("ip_profile_uid_rate"),
        F.countDistinct("resp_p").alias("ip_profile_resp_p_rate"),
        F.countDistinct("resp_h").alias("ip_profile_resp_h_rate"),
        F.countDistinct("conn_state").alias("ip_profile_conn_state_diversity"),
        F.avg(F.coalesce("duration", F.lit(0.0))).alias("ip_profile_mean_duration"),
        F.avg(F.coalesce("orig_bytes", F.lit(0))).alias("ip_profile_mean_orig_bytes"),
    )
    return df.join(final, "orig_h", "left")


def concurrency_group(*, window_us: int | None = None) -> Group:
    """Connections open at an instant; with ``window_us``, only while the row is
    still remembered."""
    last = F.col("ts_us") + duration_us()
    if window_us is not None:
        last = F.least(last, F.col("ts_us") + F.lit(window_us))
    # A negative duration would end a connection before it starts.
    return Group("open", (), include_current=True, last_instant=F.greatest(last, F.col("ts_us") - 1))


def concurrency(df: DataFrame) -> DataFrame:
    """Connections that started at or before ``ts`` and have not ended before it."""
    out = slide(df, [concurrency_group()], window_us=0)
    return out.withColumnRenamed("open__n", "concurrent_connections")


def concurrency_active(df: DataFrame, *, window_us: int) -> DataFrame:
    """As :func:`concurrency`, over rows that the window still remembers."""
    out = slide(df, [concurrency_group(window_us=window_us)], window_us=window_us)
    return out.withColumnRenamed("open__n", "concurrent_connections")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from the left."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def arrival_gap(df: DataFrame, keys: list[str], *, tie: str = "uid", out: str = "gap_us") -> DataFrame:
    """Microseconds since the previous row of the group; the first row has 0.

    Only the first of several rows at one instant can have a step, so the step
    is found between distinct times and given to the first of the ties.
    """
    points = df.select(*keys, "ts_us").distinct()
    steps = previous_time(points, keys, "ts_us").select(*keys, "ts_us", (F.col("ts_us") - F.col("prev")).alias("_step"))
    firsts = df.groupBy(*keys, "ts_us").agg(F.min(tie).alias("_first"))
    # null keys and times are groups like others
    info = join_null_safe(firsts, steps, [*keys, "ts_us"])
    return (
        join_null_safe(df, info, [*keys, "ts_us"])
        .withColumn(out, F.when(F.col(tie) == F.col("_first"), F.coalesce("_step", F.lit(0))).otherwise(F.lit(0)))
        .drop("_step", "_first")
    )


def backfill(df: DataFrame, cols: list[str], *, key: str = "orig_h", order: str = "ts_us", tie: str = "uid", slot_us: int = SLOT_US) -> DataFrame:
    """Missing values take the next known value of the same source, else 0.

    Two levels: inside a slot by window, across slots by the first known value of
    each later slot.
    """
    slotted = df.withColumn("_slot", slot_of(order, slot_us))
    ahead = Window.partitionBy(key, "_slot").orderBy(F.desc(order), F.desc(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = slotted.withColumns({f"_in_{c}": F.last(c, ignorenulls=True).over(ahead) for c in cols})
    rank = F.struct(order, tie)
    per_slot = slotted.groupBy(key, "_slot").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_s_{c}") for c in cols])
    later = Window.partitionBy(key).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    next_slots = per_slot.select(key, "_slot", *[F.last(f"_s_{c}", ignorenulls=True).over(later).alias(f"_next_{c}") for c in cols])
    out = join_null_safe(filled, next_slots, [key, "_slot"])
    out = out.withColumns({c: F.coalesce(f"_in_{c}", f"_next_{c}", F.lit(0)) for c in cols})
    return out.select(*df.columns)
