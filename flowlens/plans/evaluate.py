"""Evaluation of trained detectors over labelled or unlabelled logs.

Rows are scored once and settled with the few columns that reports need; every
report is an aggregate of that table. Rows without a label column are only counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.conn import normal_label
from flowlens.functions.dns import dns_features
from flowlens.models.thresholds import DEFAULT_POLICY, LOW_IS_ODD, low_flag, pick
from flowlens.operators.evaluation import compare_models, confusion_shares, histogram, pr_auc, roc_auc, threshold_sweep
from flowlens.operators.tallies import detection_rate, label_distribution
from flowlens.plans.flows import Detector, _settled, conn_inputs
from flowlens.sources.sinks import write_report

MODELS = ["isof", "ae", "ensemble"]


@dataclass
class Evaluation:
    """Tables of one evaluation, by name, over the settled ``rows``."""

    rows: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, path: str) -> None:
        for name, table in self.reports.items():
            write_report(table, f"{path}/{name}")


def label_column(df: DataFrame) -> str | None:
    """The column called label, in any case."""
    return next((c for c in df.columns if c.lower() == "label"), None)


def judge(df: DataFrame, detector: Detector, *, policy: str | None = None, by: str = "file", store: str | None = None) -> DataFrame:
    """(group, y where there are labels, scores, one 0/1 column for each model), settled.

    ``by`` names the column whose values get a detection rate of their own; without
    it all rows are one group, named 'all'. Scores rise with the danger; the forest's
    threshold itself counts as flagged.
    """
    label, group = label_column(df), F.coalesce(F.col(by).cast("string"), F.lit("")) if by in df.columns else F.lit("all")
    named = df.withColumns({"_group": group, **({"_y": normal_label(F.col(label).cast("string"))} if label else {})})
    inputs = conn_inputs(named, detector.baselines, detector.services) if detector.kind == "conn" else dns_features(named)
    scored = detector.score(inputs, policy)
    cut = pick(detector.thresholds, policy or DEFAULT_POLICY[detector.kind])
    flags = (low_flag(F.col("isof_score"), cut, inclusive=True), F.col("ae_anomaly"))
    isof, ae = (F.coalesce(flag.cast("int"), F.lit(0)) for flag in flags)
    columns = [F.col("_group").alias("group"), *([F.col("_y").alias("y")] if label else []), (-F.col("isof_score")).alias("isof_score"), "ae_error"]
    return _settled(scored.select(*columns, isof.alias("isof"), ae.alias("ae"), F.greatest(isof, ae).alias("ensemble")), store)


def rates(rows: DataFrame) -> DataFrame:
    """Rows, flagged rows and their share, for each group and model, in one pass."""
    tall = rows.select("group", *MODELS).unpivot(["group"], MODELS, "model", "flag")
    return detection_rate(tall.withColumn("_of", F.struct("group", "model")), "_of", F.col("flag") == 1).select("_of.*", "lines", "alerts", "rate")


def model_table(rows: DataFrame) -> DataFrame:
    """Metrics of each model's decisions; AUC of those that have a score."""
    scores = {"isof": "isof_score", "ae": "ae_error"}
    areas = None
    for model, score in scores.items():
        one = roc_auc(rows, "y", score).select(F.lit(model).alias("model"), "roc_auc", pr_auc(rows, "y", score).scalar().alias("pr_auc"))
        areas = one if areas is None else areas.unionByName(one)
    return compare_models(rows, "y", MODELS).join(areas, "model", "left")


def confusion_table(rows: DataFrame) -> DataFrame:
    """Cells of every model's confusion matrix as counts and shares of the true class."""
    tall = None
    for model in MODELS:
        one = confusion_shares(rows, "y", model).withColumn("model", F.lit(model))
        tall = one if tall is None else tall.unionByName(one)
    return tall.select("model", "truth", "predicted", "n", "share")


def reports(rows: DataFrame, thresholds: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """All reports over judged rows. ``thresholds`` are those of the forest (low is odd)."""
    out = {"rates": rates(rows)}
    if thresholds:
        out["thresholds"] = threshold_sweep(rows.withColumn("_score", -F.col("isof_score")), "_score", thresholds)
    if "y" in rows.columns:
        out |= {"labels": label_distribution(rows, "y"), "models": model_table(rows), "confusion": confusion_table(rows)}
        out |= {f"histogram_{s}": histogram(rows, "y", s) for s in ("isof_score", "ae_error")}
    return out


def evaluate(df: DataFrame, detector: Detector, *, policy: str | None = None, by: str = "file", store: str | None = None) -> Evaluation:
    """Scores ``df`` and reports on it: rates by ``by``, and with labels metrics, areas, matrices and histograms."""
    rows = judge(df, detector, policy=policy, by=by, store=store)
    forest = {k: v for k, v in detector.thresholds.items() if k in (*LOW_IS_ODD, "zero")}
    return Evaluation(rows, reports(rows, forest))
