"""Windows anchored at their first event, and the cooldown built on them.

A window opens at the first event of a key, covers a fixed span, and the next
event after it opens the next window. Where a window starts depends on all the
ones before, so this is neither a tumbling nor a session window, and a plain
fold needs a whole key in one place. Here the timeline of a key is cut into
blocks of many spans:

1. every (key, block) works out, for each instant the previous window may end at,
   which window would be its last. Instants with the same outcome are merged, and
   chains soon fall together, so a block shrinks to a few rows;
2. neighbouring blocks are composed, ``fan`` at a time, into functions of longer
   blocks, level by level, until one of them covers decades;
3. from the longest down, every level tells the blocks below where the window that
   reaches into them ends, again ``fan`` at a time;
4. every block replays its own events from that end.

Only distinct times of one (key, block), or the few rows of ``fan`` blocks, are
ever held at once, however long a key's history is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SPANS = 32
#: Blocks that one task composes. A composed block has about as many rows as its first one.
FAN = 512
#: Levels are added until a block covers this time; per key, what is left is one block for each.
LONGEST_US = 30 * 366 * 86_400_000_000
LONG_AGO = -(1 << 62)


def window_starts(times: np.ndarray, span: int, free_from: int) -> np.ndarray:
    """Start of the window of each of the sorted ``times``; times before
    ``free_from`` belong to the window that opened at ``free_from - span``."""
    starts = np.empty(len(times), dtype=np.int64)
    i = int(np.searchsorted(times, free_from, side="left"))
    starts[:i] = free_from - span
    while i < len(times):
        j = int(np.searchsorted(times, times[i] + span, side="left"))
        starts[i:j] = times[i]
        i = j
    return starts


def block_outcomes(times: np.ndarray, span: int, block_start: int) -> list[tuple[int, int, int]]:
    """(above, up_to, last): a window ending in (above, up_to] leads to the last
    window start ``last`` of this block. One ending later than all of them passes
    over the block."""
    following = np.searchsorted(times, times + span, side="left")
    last = np.arange(len(times))
    while True:
        step = np.where(following[last] < len(times), following[np.minimum(last, len(times) - 1)], last)
        if np.array_equal(step, last):
            break
        last = step
    # The window before this block started before it, so it ends within one span.
    entries = int(np.searchsorted(times, block_start + span, side="left")) + 1
    out: list[tuple[int, int, int]] = []
    above = LONG_AGO
    for i in range(min(entries, len(times))):
        outcome = int(times[last[i]])
        if out and out[-1][2] == outcome:
            out[-1] = (out[-1][0], int(times[i]), outcome)
        else:
            out.append((int(above), int(times[i]), outcome))
        above = times[i]
    return out


def leaves_at(up_to: np.ndarray, last: np.ndarray, span: int, ends: np.ndarray) -> np.ndarray:
    """Where the windows that reach into a block up to ``ends`` have moved when it is over."""
    hit = np.searchsorted(up_to, ends, side="left")
    return np.where(hit < len(up_to), np.append(last, 0)[hit] + span, ends)


def compose(pieces: Sequence[tuple[np.ndarray, np.ndarray]], span: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(up_to, last) of consecutive blocks as one block that begins at ``start``."""
    up_to, last = (np.asarray(c, dtype=np.int64) for c in pieces[0])
    for later_up_to, later_last in pieces[1:]:
        through = leaves_at(later_up_to, later_last, span, last + span) - span
        # an end above all rows so far passes over; none lies more than one span after the start
        reach = up_to[-1]
        begins = np.concatenate([[LONG_AGO], later_up_to[:-1]])
        over = (later_up_to > reach) & (np.maximum(begins, reach) < start + span)
        up_to, last = np.concatenate([up_to, later_up_to[over]]), np.concatenate([through, later_last[over]])
        final = np.append(last[1:] != last[:-1], True)
        up_to, last = up_to[final], last[final]
    return up_to, last


def levels_of(block_us: int, fan: int) -> int:
    """Levels of composed blocks; depends on the parameters alone."""
    levels, covered = 0, block_us
    while covered < LONGEST_US:
        levels, covered = levels + 1, covered * fan
    return levels


def anchor_windows(df: DataFrame, keys: Sequence[str], *, span_us: int, ts: str = "ts_us", out: str = "start_us", block_spans: int = BLOCK_SPANS, fan: int = FAN) -> DataFrame:
    """``df`` plus the start of the anchored window of each row. A row opens a new
    window when it is ``span_us`` or more after the start of the current one. Rows
    without a time or a full key are in no window: their start is null."""
    keys, block_us = list(keys), span_us * block_spans
    types = dict(df.dtypes)
    placed = F.lit(True)
    for c in [*keys, ts]:
        placed = placed & F.col(c).isNotNull()
    outside, df = df.filter(~placed).withColumn(out, F.lit(None).cast("bigint")), df.filter(placed)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def block_of(column: str, size: int):
        return F.expr(f"(`{column}` - pmod(`{column}`, {size}L)) div {size}L")

    points = df.select(*keys, F.col(ts).alias("_t")).withColumn("_block", block_of("_t", block_us)).distinct()

    def outcomes(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        rows = block_outcomes(times, span_us, int(group[-1]) * block_us)
        table = pd.DataFrame([r[1:] for r in rows], columns=["_up_to", "_last"])
        for name, value in zip([*keys, "_block"], group):
            table[name] = value
        return table[[*keys, "_block", "_up_to", "_last"]]

    def pieces_of(pdf: pd.DataFrame):
        for block, part in pdf.sort_values(["_block", "_up_to"]).groupby("_block", sort=True):
            yield int(block), (part["_up_to"].to_numpy(), part["_last"].to_numpy())

    def composed(size_us: int):
        def combine(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            up_to, last = compose([p for _, p in pieces_of(pdf)], span_us, int(group[-1]) * size_us)
            table = pd.DataFrame({"_up_to": up_to, "_last": last})
            for name, value in zip([*keys, "_block"], group):
                table[name] = value
            return table[[*keys, "_block", "_up_to", "_last"]]
        return combine

    def walk(group: tuple, pdf: pd.DataFrame, free_from: int = LONG_AGO) -> pd.DataFrame:
        rows = []
        for block, (up_to, last) in pieces_of(pdf):
            rows.append((*group[:len(keys)], block, free_from))
            free_from = int(leaves_at(up_to, last, span_us, np.array([free_from]))[0])
        return pd.DataFrame(rows, columns=[*keys, "_block", "_free_from"])

    def walk_all(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return walk(group, pdf)

    def walk_below(group: tuple, pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return walk(group, pdf, int(entry["_free_from"].iloc[0]))

    def replay(group: tuple, pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        table = pd.DataFrame({"_t": times, out: window_starts(times, span_us, int(entry["_free_from"].iloc[0]))})
        for name, value in zip(keys, group):
            table[name] = value
        return table[[*keys, "_t", out]]

    rows_of, entries_of = f"{key_schema}, _block bigint, _up_to bigint, _last bigint", f"{key_schema}, _block bigint, _free_from bigint"
    below, segments, size_us = [], points.groupBy(*keys, "_block").applyInPandas(outcomes, rows_of), block_us
    for _ in range(levels_of(block_us, fan)):
        below.append(segments.withColumn("_parent", block_of("_block", fan)))
        size_us *= fan
        segments = below[-1].groupBy(*keys, "_parent").applyInPandas(composed(size_us), rows_of)
    entries = segments.groupBy(*keys).applyInPandas(walk_all, entries_of)
    for blocks in reversed(below):
        above = entries.withColumnRenamed("_block", "_parent").groupBy(*keys, "_parent")
        entries = blocks.groupBy(*keys, "_parent").cogroup(above).applyInPandas(walk_below, entries_of)
    starts = points.groupBy(*keys, "_block").cogroup(entries.groupBy(*keys, "_block")).applyInPandas(replay, f"{key_schema}, _t bigint, {out} bigint")
    timed = df.join(starts.withColumnRenamed("_t", ts), [*keys, ts])
    return timed.unionByName(outside)


def cooldown(alerts: DataFrame, *, keys: Sequence[str] = ("matched_scenario", "src_ip"), window_us: int, tie: str = "alert_id") -> DataFrame:
    """One alert per key, then silence until ``window_us`` after the last one that
    was let through. Alerts without a full key or a time are always let through."""
    complete = F.col("ts_us").isNotNull()
    for k in keys:
        complete = complete & F.col(k).isNotNull() & (F.col(k) != "")
    complete = F.coalesce(complete, F.lit(False))
    timed = anchor_windows(alerts.filter(complete), keys, span_us=window_us)
    first = Window.partitionBy(*keys, "ts_us").orderBy(tie)
    passed = timed.filter(F.col("ts_us") == F.col("start_us")).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return passed.select(*alerts.columns).unionByName(alerts.filter(~complete))
