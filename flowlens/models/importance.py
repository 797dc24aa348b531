"""Permutation importance over all rows.

A permutation of a feature gives every row the value of another one. Rows are dealt by
a hash into groups of a few thousand, ordered by it, and each takes the values of the
next row in its group, the last those of the first. All features use the same partner,
so a repeat is one shuffle and one pass, and nothing but sums leaves a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.models.forest import IsolationForestModel, _Arrays, _matrix, average_path
from flowlens.models.recon import ReconstructionModel
from flowlens.session import cut_lineage

REPEATS, GROUP_ROWS = 5, 4096


def dealt(df: DataFrame, repeats: int, group_rows: int, seed: int) -> DataFrame:
    """Every row once for each repeat, with the group and the place in it. ``row_`` tells equal rows apart."""
    groups = max(1, df.count() // group_rows)
    copies = df.withColumn("repeat_", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    place = F.xxhash64(F.lit(seed), "repeat_", "row_")
    return copies.withColumn("place_", place).withColumn("group_", F.pmod(F.xxhash64("place_"), F.lit(groups)))


def permutation_importance(df: DataFrame, model: IsolationForestModel | ReconstructionModel, names: Sequence[str], *,
                           repeats: int = REPEATS, group_rows: int = GROUP_ROWS, seed: int = 7) -> DataFrame:
    """(feature, importance): mean absolute change of the score when one feature is shuffled."""
    spark = df.sparkSession
    if isinstance(model, IsolationForestModel):
        arrays, scale = spark.sparkContext.broadcast(_Arrays(model.nodes)), average_path(model.subsample)

        def score(x: np.ndarray) -> np.ndarray:
            return -np.power(2.0, -arrays.value.walk(x) / scale)
    else:
        def score(x: np.ndarray) -> np.ndarray:
            return ((x - model.rebuilt(x)) ** 2).mean(axis=1)

    def changes(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows.sort_values(["place_", "row_"])["x"])
        partner, base, out = np.roll(x, -1, axis=0), score(x), []
        for i, name in enumerate(names):
            y = x.copy()
            y[:, i] = partner[:, i]
            out.append((name, float(np.abs(score(y) - base).sum()), len(x)))
        return pd.DataFrame(out, columns=["feature", "change", "n"])

    # settled, so that row numbers stay the same when a task runs again
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("row_"), F.col(model.features).alias("x")))
    sums = dealt(rows, repeats, group_rows, seed).groupBy("repeat_", "group_").applyInPandas(changes, "feature string, change double, n bigint")
    return sums.groupBy("feature").agg((F.sum("change") / F.sum("n")).alias("importance"))
