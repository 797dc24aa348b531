"""Sliding event-time aggregates in linear time, without hot tasks.

A row seen at time ``o`` belongs to the frame of every query time ``t`` with
``o <= t <= o + W``. So each row is written as two *deltas*: its measures enter
the frame at ``o`` and leave it after ``o + W``. The value of a frame is the
running total of all deltas of its group up to ``t``. That costs one sort, not
one pass over the frame per row.

Distinct counts become deltas as well. All sightings of a value inside one slot
no longer than ``W`` merge into one span ``[first, last + W]`` during the
map-side aggregation; neighbouring spans merge by ``lag``/``lead`` over slots; a
merged span adds one at its start and takes one away after its end.

Skew: deltas with the same (group, time) collapse in the partial aggregate, and
the running total is taken in two levels, inside short slots of (group, slot)
and then over the slot totals of a group. No task ever holds a whole group, only
one slot of it or its slot totals; both are bounded by time, not by row count.

Volume: asking by (group, time) costs several records a row and family, there and
back. Where a call has several families, those with keys go another way
(:func:`in_blocks`): the rows themselves are dealt by a key that the families share
and by blocks of a few ``W``. A block that also holds the rows of the ``W`` before it
knows the whole frame of each of its rows, so all those families take one shuffle and
need no second level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_US = 10_000_000
#: Length of a block, in windows; one window more is read for each block.
BLOCK_WINDOWS = 4
_SEP = "\u0001"
_SQUARE = "decimal(38,0)"


@dataclass(frozen=True)
class Group:
    """One family of frames.

    keys            grouping columns; none for one global frame
    include_current whether a row (and its same-instant peers) is in its own frame
    measures        names in the ``measures`` argument of :func:`slide`
    distinct        output name -> column (or expression) whose distinct non-null values count
    last_instant    last microsecond at which a row counts (default ``ts + W``)
    gaps            also total the steps between successive distinct times
    """

    name: str
    keys: tuple[str, ...] = ()
    include_current: bool = False
    measures: tuple[str, ...] = ("n",)
    distinct: Mapping[str, str | Column] = field(default_factory=dict)
    last_instant: Column | None = None
    gaps: bool = False

    def gkey(self) -> Column:
        return F.concat_ws(_SEP, F.lit(self.name), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys])

    def outputs(self) -> list[str]:
        extra = ["gap", "gap_sq"] if self.gaps else []
        return [*self.measures, *self.distinct, *extra]


def square(value: Column) -> Column:
    """Exact square of an integer column (38 decimal digits)."""
    wide = value.cast(_SQUARE)
    return (wide * wide).cast(_SQUARE)


def slot_of(t: str, slot_us: int) -> Column:
    return F.expr(f"{t} div {slot_us}")


def kept(*names: str) -> list[Column]:
    """Columns that an ``unpivot`` keeps, under ids of their own. Spark gives them new ids where a plan
    occurs twice; were the first occurrence's ids those of its input, the two would not count as the
    same plan, and one shuffle would not serve both."""
    return [F.col(n).alias(n) for n in names]


def running_totals(
    df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], *, wanted: str, slot_us: int = SLOT_US
) -> DataFrame:
    """Running totals of ``cols`` per key in the order of ``t``; rows at the same
    ``t`` are peers and see each other. Keeps the rows where ``wanted`` is true.

    One shuffle by (key, slot) serves both levels: the windows inside the slots
    and the slot totals.
    """
    # The null checks stand before the shuffle, so that the join below infers no
    # filter for one branch only, and both branches read the same exchange.
    slotted = df.withColumn("_slot", slot_of(t, slot_us)).filter(" and ".join(f"{k} is not null" for k in [*keys, "_slot"]))
    slotted = slotted.repartition(*keys, "_slot")
    inner = Window.partitionBy("_slot", *keys).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = slotted.select(*keys, "_slot", t, wanted, *[F.sum(c).over(inner).alias(c) for c in cols]).filter(wanted)
    totals = slotted.groupBy(*keys, "_slot").agg(
        F.max(F.when(F.col(wanted), F.col(t))).alias("_asked"), *[F.sum(c).alias(f"_before_{c}") for c in cols])
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_slot", "_asked", *[F.sum(f"_before_{c}").over(earlier).alias(f"_before_{c}") for c in cols]
    ).filter(F.col("_asked").isNotNull()).drop("_asked")
    return rows.join(offsets, [*keys, "_slot"]).selectExpr(
        *keys, t, *[f"coalesce({c}, 0) + coalesce(_before_{c}, 0) as {c}" for c in cols]
    )


def previous_time(points: DataFrame, keys: Sequence[str], t: str, *, slot_us: int = SLOT_US) -> DataFrame:
    """Adds ``prev``: the time before ``t`` in the same group. ``points`` has
    each (key, time) once. Two levels, as for running totals."""
    slotted = points.withColumn("_slot", slot_of(t, slot_us))
    ends = slotted.groupBy(*keys, "_slot").agg(F.max(t).alias("_end"))
    over_slots = Window.partitionBy(*keys).orderBy("_slot")
    heads = ends.select(*keys, "_slot", F.lag("_end").over(over_slots).alias(t), F.lit(True).alias("_head")).filter(F.col(t).isNotNull())
    inside = Window.partitionBy(*keys, "_slot").orderBy(t)
    both = slotted.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    return both.withColumn("prev", F.lag(t).over(inside)).filter(~F.col("_head")).drop("_head", "_slot")


def _sql_type(measure: str) -> str:
    return _SQUARE if measure.endswith("_sq") else "bigint"


def _row_deltas(df: DataFrame, groups: Sequence[Group], measures: Mapping[str, Column], window_us: int) -> DataFrame | None:
    """Rows of the groups that forget after ``W``: totals per (group, time) first,
    so that the two or three deltas are written after the hot times collapsed."""
    groups = [g for g in groups if g.last_instant is None]
    if not groups:
        return None
    used = [m for m in measures if any(m in g.measures for g in groups)]
    rows = df.select(
        "ts_us", *[measures[m].cast(_sql_type(m)).alias(m) for m in used], *[g.gkey().alias(g.name) for g in groups]
    ).unpivot(kept("ts_us", *used), [g.name for g in groups], "g", "gkey")

    def masked(m: str) -> str:
        having = [f"'{g.name}'" for g in groups if m in g.measures]
        return m if len(having) == len(groups) else f"case when g in ({', '.join(having)}) then {m} end as {m}"

    past = [f"'{g.name}'" for g in groups if not g.include_current] or ["''"]
    points = rows.selectExpr("ts_us", "gkey", f"if(g in ({', '.join(past)}), 1, 0) as delay", *[masked(m) for m in used])
    points = points.groupBy("gkey", "delay", "ts_us").agg(*[F.sum(m).alias(m) for m in used])
    # Row enters after its delay and leaves after the window; a row outside its
    # own frame needs a third entry that only asks.
    deltas = points.selectExpr(
        "gkey", *used, "struct(ts_us + delay as t, delay = 0 as wanted, 1 as step) as enter",
        f"struct(ts_us + {window_us + 1} as t, false as wanted, -1 as step) as leave",
        "if(delay = 1, struct(ts_us as t, true as wanted, 0 as step), null) as ask",
    ).unpivot(kept("gkey", *used), ["enter", "leave", "ask"], "kind", "d").filter("d is not null")
    return deltas.selectExpr("gkey", "d.t", "d.wanted", *[f"case d.step when 1 then {m} when -1 then cast(-{m} as {_sql_type(m)}) end as {m}" for m in used])


def _span_deltas(df: DataFrame, groups: Sequence[Group], measures: Mapping[str, Column]) -> DataFrame | None:
    """Rows of the groups with an end of their own."""
    groups = [g for g in groups if g.last_instant is not None]
    if not groups:
        return None
    used = [m for m in measures if any(m in g.measures for g in groups)]
    ts = F.col("ts_us")

    def delta(group: Group, at: Column, sign: int, wanted: bool) -> Column:
        values = [
            (measures[m] * F.lit(sign) if sign and m in group.measures else F.lit(None)).cast(_sql_type(m)).alias(m) for m in used
        ]
        return F.struct(group.gkey().alias("gkey"), at.alias("t"), F.lit(wanted).alias("wanted"), *values)

    deltas = {}
    for g in groups:
        deltas[f"{g.name}_enter"] = delta(g, ts if g.include_current else ts + 1, 1, g.include_current)
        deltas[f"{g.name}_leave"] = delta(g, g.last_instant + 1, -1, False)
        if not g.include_current:
            deltas[f"{g.name}_ask"] = delta(g, ts, 0, True)
    rows = df.select(*[d.alias(n) for n, d in deltas.items()]).unpivot([], list(deltas), "kind", "d").select("d.*")
    return rows.groupBy("gkey", "t").agg(F.max("wanted").alias("wanted"), *[F.sum(m).alias(m) for m in used])


def _distinct_deltas(df: DataFrame, groups: Sequence[Group], window_us: int) -> DataFrame | None:
    sightings = {
        f"{g.name}_{out}": F.struct(
            g.gkey().alias("gkey"),
            F.lit(out).alias("what"),
            (F.col(column) if isinstance(column, str) else column).cast("string").alias("seen"),
            F.lit(0 if g.include_current else 1).cast("bigint").alias("delay"),
        )
        for g in groups
        for out, column in g.distinct.items()
    }
    if not sightings:
        return None
    spans = (
        df.select("ts_us", *[c.alias(n) for n, c in sightings.items()])
        .unpivot(kept("ts_us"), list(sightings), "kind", "s")
        .select("ts_us", "s.*")
        .filter(F.col("seen").isNotNull())
        .groupBy("gkey", "what", "delay", "seen", slot_of("ts_us", window_us).alias("slot"))
        .agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    )
    w = Window.partitionBy("gkey", "what", "delay", "seen").orderBy("slot")
    edges = spans.select(
        "gkey", "what", "delay", "first", "last",
        F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"),
    )
    names = list(dict.fromkeys(out for g in groups for out in g.distinct))
    turns = edges.selectExpr(
        "gkey", "what",
        f"case when before is null or first > before + {window_us} then struct(first + delay as t, 1 as step) end as opens",
        f"case when after is null or after > last + {window_us} then struct(last + {window_us + 1} as t, -1 as step) end as closes",
    ).unpivot(kept("gkey", "what"), ["opens", "closes"], "kind", "e").filter("e is not null")
    return turns.selectExpr("gkey", "e.t", "false as wanted", *[f"case when what = '{n}' then cast(e.step as bigint) end as {n}" for n in names])


def _gap_deltas(df: DataFrame, groups: Sequence[Group], window_us: int, slot_us: int) -> DataFrame | None:
    """Step from ``prev`` to ``t`` is inside a frame while both ends are."""
    with_gaps = [g for g in groups if g.gaps]
    if not with_gaps:
        return None
    points = df.select("ts_us", *[g.gkey().alias(g.name) for g in with_gaps]).unpivot(kept("ts_us"), [g.name for g in with_gaps], "g", "gkey")
    stepped = previous_time(points.select("ts_us", "gkey").distinct(), ["gkey"], "ts_us", slot_us=slot_us)
    inside = stepped.selectExpr("gkey", "ts_us", "prev", "ts_us - prev as gap").filter(F.col("gap") < window_us)
    inside = inside.withColumn("gap_sq", square(F.col("gap")))
    turns = inside.selectExpr(
        "gkey", "gap", "gap_sq", "struct(ts_us + 1 as t, 1 as step) as enter", f"struct(prev + {window_us + 1} as t, -1 as step) as leave",
    ).unpivot(kept("gkey", "gap", "gap_sq"), ["enter", "leave"], "kind", "d")
    return turns.selectExpr("gkey", "d.t", "false as wanted", "gap * d.step as gap", f"cast(gap_sq * d.step as {_SQUARE}) as gap_sq")


def frame_totals(
    df: DataFrame, groups: Sequence[Group], measures: Mapping[str, Column], window_us: int, slot_us: int = SLOT_US
) -> DataFrame:
    """One row per (gkey, t) that some input row asks for, with all totals."""
    parts = [
        _row_deltas(df, groups, measures, window_us), _span_deltas(df, groups, measures),
        _distinct_deltas(df, groups, window_us), _gap_deltas(df, groups, window_us, slot_us),
    ]
    deltas, *rest = [p for p in parts if p is not None]
    for p in rest:
        deltas = deltas.unionByName(p, allowMissingColumns=True)
    cols = [c for c in deltas.columns if c not in ("gkey", "t", "wanted")]
    return running_totals(deltas, ["gkey"], "t", cols, wanted="wanted", slot_us=slot_us)


def slide(
    df: DataFrame,
    groups: Sequence[Group],
    *,
    window_us: int,
    measures: Mapping[str, Column] | None = None,
    slot_us: int = SLOT_US,
) -> DataFrame:
    """``df`` plus one column ``<group>__<output>`` per group and output.

    One row in, one row out, whatever the duplicates. A single family, or one with keys
    and an end of its own, is computed once per distinct (time, group) and joined back;
    several families are computed in place, those with keys in blocks, others in slots.
    """
    # Not a literal: a constant would be folded into one branch of the plan only.
    measures = {"n": F.when(F.col("ts_us").isNotNull(), 1).otherwise(0), **(measures or {})}
    outs = [f"{g.name}__{o}" for g in groups for o in g.outputs()]
    out, blocked, instants = df, [], []
    for g in groups:
        plain = not g.keys and not g.distinct and not g.gaps
        if len(groups) == 1 or (g.last_instant is not None and not plain):
            out = _asked(out, g, measures, window_us, slot_us)
        else:
            (instants if plain else blocked).append(g)
    for shared, cluster in clusters(blocked):
        # what earlier clusters found is of no use to the next block
        spare = [c for c in out.columns if c not in df.columns]
        out = in_blocks(out, cluster, shared, _used(measures, cluster), window_us, spare=spare)
    if instants:  # last, so that what they add is not moved by the clusters
        out = in_slots(out, instants, _used(measures, instants), window_us, slot_us)
    return out.select(*df.columns, *outs)


def _used(measures: Mapping[str, Column], groups: Sequence[Group]) -> dict[str, Column]:
    return {m: c for m, c in measures.items() if any(m in g.measures for g in groups)}


def _asked(df: DataFrame, g: Group, measures: Mapping[str, Column], window_us: int, slot_us: int) -> DataFrame:
    """``df`` with the totals of one family, joined by (group, time)."""
    totals = frame_totals(df, [g], _used(measures, [g]), window_us, slot_us)
    named = totals.select(F.col("gkey").alias("_gkey"), F.col("t").alias("_t"), *[F.col(o).alias(f"{g.name}__{o}") for o in g.outputs()])
    joined = df.withColumn("_key", g.gkey()).join(named, (F.col("_key") == F.col("_gkey")) & (F.col("ts_us") == F.col("_t")), "left")
    return joined.drop("_key", "_gkey", "_t")


def in_slots(df: DataFrame, groups: Sequence[Group], measures: Mapping[str, Column], window_us: int, slot_us: int) -> DataFrame:
    """``df`` plus the totals of families without keys and distinct values. As in
    :func:`running_totals`, but rows and what they ask for stay together."""
    ts, kinds = F.col("ts_us"), {f"{g.name}__{m}": _sql_type(m) for g in groups for m in g.measures}

    def entry(at: Column, sign: int, of: Sequence[Group]) -> Column:
        values = [(F.when(ts.isNotNull(), measures[m] * F.lit(sign)) if any(g is x for x in of) else F.lit(None)).cast(_sql_type(m)).alias(f"{g.name}__{m}") for g in groups for m in g.measures]
        return F.struct(at.alias("t"), F.lit(sign > 0).alias("asks"), *values)

    def leaves(g: Group) -> Column:
        last = ts + window_us if g.last_instant is None else g.last_instant
        return last + 1 if g.include_current else last  # the frames of the others end before the row that asks

    entries = F.array(entry(ts, 1, groups), *[entry(leaves(g), -1, [g]) for g in groups])
    stream = df.select(F.struct(*df.columns).alias("_row"), F.explode(entries).alias("_e")).filter("_e.asks or _e.t is not null")
    stream = stream.select(F.when(F.col("_e.asks"), F.col("_row")).alias("_row"), "_e.t", *[f"_e.{v}" for v in kinds])
    # Both levels need every column, so that they read the same exchange.
    slotted = stream.withColumn("_slot", slot_of("t", slot_us)).repartition("_slot")
    ordered = Window.partitionBy("_slot").orderBy("t")
    frames = {True: ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow), False: ordered.rangeBetween(Window.unboundedPreceding, -1)}
    inside = [F.sum(f"{g.name}__{m}").over(frames[g.include_current]).alias(f"{g.name}__{m}") for g in groups for m in g.measures]
    rows = slotted.select("_row", "_slot", *inside).filter("_row is not null")
    totals = slotted.groupBy(F.col("_slot").alias("_at")).agg(F.count("_row").alias("_asked"), F.max("t").alias("_newest"), *[F.sum(v).alias(f"_before_{v}") for v in kinds])
    earlier = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_at", "_asked", "_newest", *[F.sum(f"_before_{v}").over(earlier).alias(f"_before_{v}") for v in kinds]).filter("_asked > 0 and _newest is not null")
    found = rows.join(offsets, F.col("_slot") == F.col("_at"), "left")
    return found.select("_row.*", *[
        F.when(F.col("_row.ts_us").isNotNull(), F.expr(f"coalesce({v}, 0) + coalesce(_before_{v}, 0)")).cast(kind).alias(v) for v, kind in kinds.items()])


def clusters(groups: Sequence[Group]) -> list[tuple[list[str], list[Group]]]:
    """Families that share a key, with the keys they all have. Those with the fewest
    outputs come first, since each cluster moves what the ones before it added."""
    left, found = list(groups), []
    while left:
        counts = Counter(k for g in left for k in g.keys)
        key = max(counts, key=counts.__getitem__, default=None)
        mine = [g for g in left if key is None or key in g.keys]
        shared = [k for k in mine[0].keys if all(k in g.keys for g in mine)]
        found.append((shared, mine))
        left = [g for g in left if all(g is not m for m in mine)]
    return sorted(found, key=lambda c: sum(len(g.outputs()) for g in c[1]))


def in_blocks(
    df: DataFrame, groups: Sequence[Group], shared: Sequence[str], measures: Mapping[str, Column], window_us: int, *, spare: Sequence[str] = ()
) -> DataFrame:
    """``df`` plus the outputs of ``groups``, which all have the keys ``shared``.
    Columns in ``spare`` are null in copies of rows.

    Rows are dealt by (shared keys, block of ``BLOCK_WINDOWS`` windows); those of the
    last ``W`` of a block also go to the next one, where they are not answered. In a
    block each row stands twice, where it enters and where it leaves, and the value of
    a frame is a running total as in :func:`running_totals`. A distinct value enters
    with a sighting that has none in the ``W`` before it and leaves after one that has
    none in the ``W`` behind it; a gap enters with its later end and leaves with its
    earlier one.
    """
    block_us = max(1, window_us) * BLOCK_WINDOWS
    rows, ts = list(df.columns), F.col("ts_us")
    part = ["_part", "_block"]

    def joint(keys: Sequence[str]) -> Column:
        return F.concat_ws(_SEP, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])

    own = F.expr(f"(ts_us - pmod(ts_us, {block_us}L)) div {block_us}L")
    late = F.expr(f"pmod(ts_us, {block_us}L) >= {block_us - window_us}L")
    dealt = df.select(F.struct(*rows).alias("_row"), joint(shared).alias("_part"), own.alias("_own"), F.explode(
        F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("_block"))
    lean = F.struct(*[(F.when(F.col("_own").eqNullSafe(F.col("_block")), F.col(f"_row.{c}")) if c in spare else F.col(f"_row.{c}")).alias(c) for c in rows])
    dealt = dealt.select(*part, F.col("_own").eqNullSafe(F.col("_block")).alias("_mine"), lean.alias("_row"))

    steps = dealt.select("*", *[F.col(f"_row.{c}").alias(c) for c in rows])
    seen = {(g.name, o): (F.col(c) if isinstance(c, str) else c).cast("string") for g in groups for o, c in g.distinct.items()}
    steps = steps.select(
        "_row", *part, "_mine", "ts_us", *[g.gkey().alias(f"_g_{g.name}") for g in groups],
        *[c.cast(_sql_type(m)).alias(f"_m_{m}") for m, c in measures.items()], *[c.alias(f"_s_{n}_{o}") for (n, o), c in seen.items()])

    def neighbours(frame: DataFrame, same: Sequence[str], enter: str, leave: str, turn: Callable[[Column, Column, Column], tuple[Column, Column]]) -> DataFrame:
        """``turn`` of the times before, at and after a row among rows with equal ``same``."""
        # partitioned by part and block alone, so that every family takes the same shuffle
        w = Window.partitionBy(*part).orderBy(*same, "ts_us")
        near = F.struct(*same, "ts_us")
        both = frame.withColumns({"_back": F.lag(near).over(w), "_ahead": F.lead(near).over(w)})

        def at(side: str) -> Column:
            equal = F.lit(True)
            for c in same:
                equal = equal & F.col(f"{side}.{c}").eqNullSafe(F.col(c))
            return F.when(equal, F.col(f"{side}.ts_us"))

        enters, leaves = turn(at("_back"), ts, at("_ahead"))
        return both.withColumns({enter: enters, leave: leaves}).drop("_back", "_ahead")

    for n, o in seen:
        known = F.col(f"_s_{n}_{o}").isNotNull() & ts.isNotNull()
        steps = neighbours(steps, [f"_g_{n}", f"_s_{n}_{o}"], f"_in_{n}_{o}", f"_out_{n}_{o}", lambda back, t, ahead: (
            F.when(known & (back.isNull() | (back < t - window_us)), F.lit(1).cast("bigint")),
            F.when(known & (ahead.isNull() | (ahead > t + window_us)), F.lit(1).cast("bigint")))).drop(f"_s_{n}_{o}")
    for g in groups:
        if g.gaps:
            steps = neighbours(steps, [f"_g_{g.name}"], f"_in_{g.name}_gap", f"_out_{g.name}_gap", lambda back, t, ahead: (
                F.when(t - back < window_us, t - back), F.when(ahead - t < window_us, ahead - t)))

    # A row leaves right after the window. In an order that looks back to the microsecond
    # before, it leaves one earlier.
    end = F.expr(f"(_block + 1) * {block_us}L")
    twice = steps.withColumn("_leaves", F.explode(F.when(ts + window_us < end, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    twice = twice.withColumn("_row", F.when(F.col("_mine") & ~F.col("_leaves"), F.col("_row")))
    twice = twice.withColumns({"_upto": F.when(F.col("_leaves"), ts + window_us + 1).otherwise(ts), "_before": F.when(F.col("_leaves"), ts + window_us).otherwise(ts)})

    totals = twice
    for g in groups:
        family = Window.partitionBy(*part, f"_g_{g.name}")
        upto = family.orderBy("_upto").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        before = family.orderBy("_before").rangeBetween(Window.unboundedPreceding, -1)
        frame = upto if g.include_current else before

        def signed(into: Column, out: Column, kind: str) -> Column:
            return F.when(F.col("_leaves"), (-out).cast(kind)).otherwise(into)

        values = {m: (F.sum(signed(F.col(f"_m_{m}"), F.col(f"_m_{m}"), _sql_type(m))).over(frame), _sql_type(m)) for m in g.measures}
        for o in g.distinct:
            values[o] = (F.sum(signed(F.col(f"_in_{g.name}_{o}"), F.col(f"_out_{g.name}_{o}"), "bigint")).over(frame), "bigint")
        if g.gaps:  # both ends of a gap lie before the row that asks
            into, out = F.col(f"_in_{g.name}_gap"), F.col(f"_out_{g.name}_gap")
            values["gap"] = (F.sum(signed(into, out, "bigint")).over(before), "bigint")
            values["gap_sq"] = (F.sum(signed(square(into), square(out), _SQUARE)).over(before), _SQUARE)
        totals = totals.withColumns({f"{g.name}__{o}": F.when(ts.isNotNull(), F.coalesce(v, F.lit(0).cast(kind))) for o, (v, kind) in values.items()})
    answered = totals.filter(F.col("_mine") & ~F.col("_leaves"))
    return answered.select("_row.*", *[f"{g.name}__{o}" for g in groups for o in g.outputs()])


def sample_std(n: Column, total: Column, total_sq: Column, scale: float = 1.0, ddof: int = 1) -> Column:
    """Standard deviation from exact integer totals; 0 where it is undefined.

    The difference ``n * sum(x^2) - sum(x)^2`` is taken in 38-digit decimals, so
    a constant column gives exactly 0; should it overflow, doubles take over.
    """
    n38, t38 = n.cast(_SQUARE), total.cast(_SQUARE)
    exact = F.try_subtract(F.try_multiply(n38, total_sq), F.try_multiply(t38, t38)).cast("double")
    rough = n.cast("double") * total_sq.cast("double") - total.cast("double") * total.cast("double")
    spread = F.greatest(F.coalesce(exact, rough), F.lit(0.0))
    return F.when(n > ddof, F.sqrt(spread / (n * (n - ddof)).cast("double")) / F.lit(scale)).otherwise(0.0)
