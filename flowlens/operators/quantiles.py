"""Exact quantiles and exact ordered totals of data that fits no single task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import cut_lineage

ACCURACY = 10_000
#: A bracket with more rows than this is sketched again.
BRACKET_ROWS = 100_000
ROUNDS = 8
#: Rows of one range of ordered totals.
RANGE_ROWS = 500_000


def order_statistics(df: DataFrame, columns: Sequence[str], places: Callable[[int], Sequence[int]], *, bracket_rows: int = BRACKET_ROWS) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column: rows with a value and the exact values at 0-based ranks, where
    ``places(n)`` names the ranks among n rows. A few jobs for all columns.

    A mergeable sketch brackets each rank between two values of the data. The rows
    before and inside the bracket are counted: if the rank lies elsewhere, the bracket
    becomes the whole range; if it holds more than ``bracket_rows``, the rows inside
    are sketched alone, which leaves about a thousandth of them. Only the values of
    a bracket that is small enough are then tallied.
    """
    counts = df.agg(*[F.count(c) for c in columns]).first()
    size = dict(zip(columns, counts))
    ranks = {c: sorted(set(places(n))) if n else [] for c, n in size.items()}
    asked = [c for c in columns if size[c]]
    if not asked:
        return {c: (0, {}) for c in columns}
    slack = 3.0 / ACCURACY

    def probes(rank: int, n: int) -> list[float]:
        return [min(1.0, max(0.0, rank / max(n - 1, 1) + d)) for d in (-slack, slack)]

    row = df.agg(*[x for c in asked for x in (F.min(c), F.max(c), F.percentile_approx(c, [p for r in ranks[c] for p in probes(r, size[c])], ACCURACY))]).first()
    ends, todo = {}, {}
    for i, c in enumerate(asked):
        low, high, sketch = row[3 * i: 3 * i + 3]
        ends[c] = (low, high)
        todo.update({(c, r): (sketch[2 * k], sketch[2 * k + 1]) for k, r in enumerate(ranks[c])})

    found: dict[tuple[str, int], float] = {}
    ready: dict[tuple[str, int], tuple] = {}
    for left in range(ROUNDS, 0, -1):
        if not todo:
            break
        keys = list(todo)
        tally = df.agg(*[x for c, r in keys for x in (F.count_if(F.col(c) < todo[c, r][0]), F.count_if(F.col(c).between(*todo[c, r])))]).first()
        again = {}
        for i, key in enumerate(keys):
            (low, high), below, inside = todo[key], tally[2 * i], tally[2 * i + 1]
            if not below <= key[1] < below + inside:
                again[key] = (*ends[key[0]], 0, 0)
            elif low == high:
                found[key] = float(low)
            elif inside <= bracket_rows or left == 1:
                ready[key] = (low, high, below)
            else:
                again[key] = (low, high, below, inside)
        crowded = [k for k, (_, _, _, inside) in again.items() if inside]
        narrowed = df.agg(*[F.percentile_approx(F.when(F.col(k[0]).between(*again[k][:2]), F.col(k[0])), probes(k[1] - again[k][2], again[k][3]), ACCURACY) for k in crowded]).first() if crowded else ()
        todo = {k: v[:2] for k, v in again.items()}
        for k, (low, high) in zip(crowded, narrowed):
            if (low, high) == todo[k]:  # all but a thousandth of its rows are its two ends
                ready[k] = (*todo.pop(k), again[k][2])
            else:
                todo[k] = (low, high)
    ready.update({k: (*ends[k[0]], 0) for k in todo})

    if ready:
        keys = list(ready)
        cases = F.array(*[F.when(F.col(c).between(*ready[c, r][:2]), F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v"))) for i, (c, r) in enumerate(keys)])
        tally = df.select(F.explode(F.array_compact(cases)).alias("e")).groupBy("e.i", "e.v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        start, goal = F.array(*[F.lit(int(ready[k][2])) for k in keys]), F.array(*[F.lit(r) for _, r in keys])
        placed = tally.withColumns({"_end": upto + F.get(start, F.col("i")), "_goal": F.get(goal, F.col("i"))})
        hit = placed.filter((F.col("_end") > F.col("_goal")) & (F.col("_end") - F.col("c") <= F.col("_goal")))
        found.update({keys[h["i"]]: h["v"] for h in hit.select("i", "v").collect()})
    return {c: (size[c], {r: found[c, r] for r in ranks[c]}) for c in columns}


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of several columns, with linear interpolation between neighbours."""
    def places(n: int) -> list[int]:
        return [r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    out = {}
    for c, (n, value) in order_statistics(df, columns, places).items():
        spots = [p * (n - 1) for p in probs]
        out[c] = [value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) for x in spots] if n else [float("nan")] * len(probs)
    return out


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    return column_quantiles(df, [column], probs)[column]


def ordered_totals(df: DataFrame, order: str, cols: Sequence[str], *, range_rows: int = RANGE_ROWS, descending: bool = False) -> DataFrame:
    """``before_<col>``: total over all rows that sort strictly before this one.
    ``order`` is unique per row (group first). Rows are dealt into ranges of about
    ``range_rows``, as many as it takes; each is one window partition, and the range
    totals are one row for each."""
    df = cut_lineage(df)
    ranges = max(1, math.ceil(df.count() / range_rows))
    # settled, so that both uses below see the same ranges
    ranged = cut_lineage(df.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))
    by = F.desc if descending else F.asc
    inside = Window.partitionBy("_range").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, -1)
    over_ranges = Window.orderBy(by("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(over_ranges), F.lit(0)).alias(f"_o_{c}") for c in cols])
    rows = ranged.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols})
    out = rows.join(offsets, "_range")
    out = out.withColumns({f"before_{c}": F.col(f"_i_{c}") + F.col(f"_o_{c}") for c in cols})
    return out.drop("_range", *[f"_{k}_{c}" for c in cols for k in "io"])


def time_split(df: DataFrame, share: float, *, ts: str = "ts_us", tie: str = "uid") -> DataFrame:
    """``in_train``: the earliest ``floor(share * n)`` rows in (time, tie) order.

    The cut time is found exactly; only rows at that very instant are ranked.
    """
    ((n, at),) = order_statistics(df, [ts], lambda n: [max(0, math.floor(share * n) - 1)]).values()
    k = math.floor(share * n)
    if k in (0, n):
        return df.withColumn("in_train", F.lit(k == n))
    cut = int(at[k - 1])
    below = df.filter(F.col(ts) < cut).count()
    rank = F.row_number().over(Window.partitionBy(ts).orderBy(tie))
    tied = df.filter(F.col(ts) == cut).withColumn("in_train", rank <= k - below)
    return df.filter(F.col(ts) != cut).withColumn("in_train", F.col(ts) < cut).unionByName(tied)
