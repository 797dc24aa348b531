"""Metrics of binary decisions and of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.quantiles import ordered_totals


def _safe(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def confusion(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(y) == 1, F.col(yhat) == 1
    return df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def binary_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    out = confusion(df, y, yhat, by).withColumns({
        "accuracy": _safe(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "precision": _safe(c("tp"), c("tp") + c("fp")),
        "recall": _safe(c("tp"), c("tp") + c("fn")), "specificity": _safe(c("tn"), c("tn") + c("fp"))})
    return out.withColumns({"f1": _safe(c("precision") * c("recall") * 2, c("precision") + c("recall")), "balanced_accuracy": (c("recall") + c("specificity")) / 2})


def confusion_shares(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Cells of the confusion matrix as shares of their true class."""
    cells = df.groupBy(F.col(y).alias("truth"), F.col(yhat).alias("predicted")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Probability that an attack outscores a normal row, ties counting half."""
    steps = ordered_totals(_by_score(df, y, score), "score", ["neg"])
    won = F.sum((F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).cast("double"))
    return steps.agg((won / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("roc_auc"))


def pr_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Trapezoids under precision over recall, from (recall 0, precision 1)."""
    steps = ordered_totals(_by_score(df, y, score), "score", ["pos", "neg"], descending=True)
    c = F.col
    had, have = c("before_pos").cast("double"), (c("before_pos") + c("pos")).cast("double")
    before = F.when(had + c("before_neg") > 0, had / (had + c("before_neg"))).otherwise(1.0)
    after = have / (have + c("before_neg") + c("neg"))
    return steps.agg((F.sum((have - had) * (before + after) / 2) / F.sum("pos").cast("double")).alias("pr_auc"))


def histogram(df: DataFrame, y: str, score: str, *, bins: int = 50, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows per class and equal-width bin; the last bin includes the top value."""
    if low is None or high is None:
        low, high = df.agg(F.min(score), F.max(score)).first()
    width = (float(high) - float(low)) / bins or 1.0
    b = F.least(F.floor((F.col(score) - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.groupBy(F.col(y).alias("truth"), b.alias("bin")).agg(F.count("*").alias("n"))


def threshold_sweep(df: DataFrame, score: str, thresholds: dict[str, float]) -> DataFrame:
    """Rows at or below each threshold, all in one pass."""
    row = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(score) <= F.lit(float(t))).alias(n) for n, t in thresholds.items()])
    return row.unpivot(["total"], list(thresholds), "policy", "flagged")


def compare_models(df: DataFrame, y: str, predictions: Sequence[str]) -> DataFrame:
    """Metrics of several prediction columns in one pass."""
    tall = df.unpivot([y], list(predictions), "model", "_yhat")
    return binary_metrics(tall, y, "_yhat", ["model"])
