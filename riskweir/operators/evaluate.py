"""Exact binary metrics as distributed aggregates, per group of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskweir.operators.ranking import running_totals, value_edges
from riskweir.schema import LABEL

METRICS = ("pr_auc", "roc_auc", "accuracy", "balanced_accuracy", "precision", "recall", "f1")
THRESHOLD = 0.5


def score_histogram(scored: DataFrame, by: Sequence[str] = (), label: str = LABEL, score: str = "score") -> DataFrame:
    """One row per group and distinct score with ``pos`` and ``neg`` counts; ties vanish before the shuffle."""
    hit = F.col(label).cast("int")
    return scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(hit).cast("bigint").alias("pos"), F.sum(1 - hit).cast("bigint").alias("neg")
    )


def _div0(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def threshold_counts(threshold: float = THRESHOLD) -> list[Column]:
    """Confusion counts over a score histogram; a score equal to the threshold counts as positive."""
    above = F.col("score") >= F.lit(threshold)
    return [
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
    ]


def threshold_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    # With one class only, balanced accuracy is the recall of that class.
    sides = [F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.try_divide(tn.cast("double"), (tn + fp).cast("double"))]
    return {
        "accuracy": _div0(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": F.coalesce((sides[0] + sides[1]) / 2, sides[0], sides[1]),
        "precision": _div0(tp, tp + fp),
        "recall": _div0(tp, tp + fn),
        "f1": _div0(2 * tp, 2 * tp + fp + fn),
    }


def threshold_metrics(scored: DataFrame, by: Sequence[str] = (), label: str = LABEL, score: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """Metrics at a threshold only: one aggregate straight over the rows."""
    rows = scored.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("pos"))
    rows = rows.withColumn("neg", 1 - F.col("pos"))
    return rows.groupBy(*by).agg(*threshold_counts(threshold)).withColumns(threshold_columns()).drop("tp", "fp", "fn", "tn")


def metrics(
    scored: DataFrame, by: Sequence[str] = (), label: str = LABEL, score: str = "score",
    threshold: float = THRESHOLD, edges: list[float] | None = None,
) -> DataFrame:
    """The seven metrics for each group.

    Average Precision is the step-wise sum over distinct scores, ROC AUC counts ties half. Rows become a
    histogram of distinct scores, the histogram gets running totals, and both curves as well as the
    confusion counts are one aggregate over it. ``edges`` are bucket edges of the scores; they default to
    quantiles of ``scored``, which is one extra narrow pass.
    """
    edges = edges or value_edges(scored.select(F.col(score).cast("double").alias("score")), "score")
    hist = score_histogram(scored, by, label, score)
    curve = running_totals(hist, by, "score", ["pos", "neg"], edges, descending=True)
    cum_pos, cum_neg = F.col("cum_pos"), F.col("cum_neg")
    steps = F.col("pos") * (cum_pos / (cum_pos + cum_neg))
    pairs = F.col("neg") * (cum_pos - F.col("pos") / 2)
    sums = curve.groupBy(*by).agg(
        F.sum(steps).alias("_ap"), F.sum(pairs).alias("_pairs"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), *threshold_counts(threshold),
    )
    full = sums.withColumns({
        "pr_auc": F.coalesce(F.try_divide(F.col("_ap"), F.col("_p").cast("double")), F.lit(0.0)),
        "roc_auc": F.try_divide(F.col("_pairs"), F.col("_p").cast("double") * F.col("_n")),
        **threshold_columns(),
    })
    return full.select(*by, *METRICS)


def metric_rows(scored: DataFrame, by: Sequence[str] = (), label: str = LABEL, score: str = "score", threshold: float = THRESHOLD) -> list[dict]:
    """Metrics of model output as driver rows (one per group); the narrow scored columns are kept for both passes."""
    narrow = scored.select(*by, F.col(label).cast("int").alias(LABEL), F.col(score).cast("double").alias("score")).persist()
    try:
        return [r.asDict() for r in metrics(narrow, by, threshold=threshold).collect()]
    finally:
        narrow.unpersist()
