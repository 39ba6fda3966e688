"""Selection and comparison of models and configurations on metric tables.

Metric tables have one row per (model, configuration, split): the windows here run over such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def improvement(delta: Column) -> Column:
    """Plain words for a change of Average Precision."""
    return F.when(delta < 0, "negative").when(delta < 0.001, "negligible").when(delta < 0.005, "marginal").otherwise("meaningful")


def _all_rows():
    return Window.partitionBy(F.lit(0))


def mark_best(rows: DataFrame, score: str, by: str = "model") -> DataFrame:
    """Adds ``selected``: the row with the highest score, the first name on ties."""
    place = F.row_number().over(_all_rows().orderBy(F.col(score).desc(), by))
    return rows.withColumn("selected", place == 1)


def choose_configuration(rows: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """Smallest configuration whose mean validation Average Precision is within ``tolerance`` of the best.

    ``rows``: (model, feature_configuration, n_features, validation_pr_auc).
    """
    means = rows.groupBy("feature_configuration").agg(
        F.avg("validation_pr_auc").alias("mean_validation_pr_auc"), F.min("n_features").alias("n_features"))
    near = means.withColumn("_best", F.max("mean_validation_pr_auc").over(_all_rows())).filter(
        F.col("mean_validation_pr_auc") >= F.col("_best") - tolerance)
    return near.drop("_best").orderBy("n_features", F.col("mean_validation_pr_auc").desc(), "feature_configuration").limit(1)


def with_delta(rows: DataFrame, baseline: str, score: str = "validation_pr_auc") -> DataFrame:
    """Adds ``<score>_delta``: difference to the baseline configuration of the same model."""
    base = F.max(F.when(F.col("feature_configuration") == baseline, F.col(score))).over(Window.partitionBy("model"))
    return rows.withColumn(f"{score}_delta", F.col(score) - base)


def rank_importance(rows: DataFrame, value: str, by: str = "model") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc(), "feature")).cast("bigint"))


def mean_importance(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("feature").agg(F.avg(value).alias(value))


def top_features(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k features with the highest cross-model mean."""
    return mean_importance(rows, value).orderBy(F.col(value).desc(), "feature").limit(k)


def sum_by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(model, column, value) attributions to (model, feature, mean_abs): mean absolute value per column, summed per source.

    ``sources`` (column, feature) lists the encoded columns.
    """
    per = rows.groupBy("model", "column").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return per.join(sources, "column").groupBy("model", "feature").agg(F.sum("mean_abs").alias("mean_abs"))


def running_best(trials: DataFrame, score: str = "cv_mean_pr_auc") -> DataFrame:
    """Adds ``best_so_far`` over the trials of each model."""
    upto = Window.partitionBy("model").orderBy("trial_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("best_so_far", F.max(score).over(upto))


def freeze(rows: DataFrame) -> DataFrame:
    """(model, default, tuned) validation scores to the frozen choice: tuned only if strictly better."""
    delta = F.col("tuned_pr_auc") - F.col("default_pr_auc")
    better = delta > 0
    return rows.withColumns({
        "selected_configuration": F.when(better, "tuned").otherwise("default"),
        "validation_pr_auc": F.when(better, F.col("tuned_pr_auc")).otherwise(F.col("default_pr_auc")),
        "validation_pr_auc_delta": delta,
        "improvement_assessment": improvement(delta),
    })


def fold_summary(folds: DataFrame, by: list[str], score: str = "pr_auc") -> DataFrame:
    """Mean and population deviation over folds or repeats."""
    return folds.groupBy(*by).agg(F.avg(score).alias(f"mean_{score}"), F.stddev_pop(score).alias(f"std_{score}"))


def family_comparison(
    classical_validation: DataFrame, classical_test: DataFrame, other_validation: DataFrame, other_test: DataFrame,
) -> DataFrame:
    """Validation next to test metrics for the selected tuned models and for a second model family.

    ``classical_validation`` has one row per (model, configuration) with ``selected``; the others one row
    per model. All are metric tables of a few rows.
    """
    tests = ["pr_auc", "roc_auc", "precision", "recall", "f1", "balanced_accuracy", "accuracy"]

    def paired(validation: DataFrame, test: DataFrame, family: str) -> DataFrame:
        left = validation.select("model", *[F.col(c).alias(f"validation_{c}") for c in ("pr_auc", "roc_auc")])
        right = test.select("model", *[F.col(c).alias(f"test_{c}") for c in tests])
        return left.join(right, "model").withColumn("model_family_type", F.lit(family))

    chosen = classical_validation.filter(F.lower(F.col("selected").cast("string")) == "true")
    both = paired(chosen, classical_test, "tuned").unionByName(paired(other_validation, other_test, "default"))
    return both.withColumn("validation_minus_test_pr_auc", F.col("validation_pr_auc") - F.col("test_pr_auc"))
