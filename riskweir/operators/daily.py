"""Daily rate tables and the anomaly-window comparison."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from riskweir.schema import LABEL

# Metrics compared between the window and the other days.
WINDOW_METRICS = (
    "applications", "approvals", "frauds", "approval_rate", "application_fraud_rate",
    "approved_fraud_rate", "avg_credit_score", "avg_fraud_score",
)


def ratio(top: Column, bottom: Column) -> Column:
    """NULL for a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _counts() -> list[Column]:
    return [
        F.count("application_id").alias("applications"),
        F.sum("is_approved").cast("bigint").alias("approvals"),
        F.sum(LABEL).cast("bigint").alias("frauds"),
        F.sum("approved_fraud").cast("bigint").alias("approved_frauds"),
    ]


def _rates() -> dict[str, Column]:
    return {
        "approval_rate": ratio(F.col("approvals"), F.col("applications")),
        "application_fraud_rate": ratio(F.col("frauds"), F.col("applications")),
        "approved_fraud_rate": ratio(F.col("approved_frauds"), F.col("approvals")),
    }


def _means() -> list[Column]:
    means = []
    for score in ("credit_score", "fraud_score"):
        means.append(F.avg(score).alias(f"avg_{score}"))
        for flag, label in (("is_approved", "approvals"), (LABEL, "frauds")):
            means.append(F.avg(F.when(F.col(flag) == 1, F.col(score))).alias(f"avg_{score}_on_{label}"))
    return [*means, F.avg("date_gap_days").alias("avg_date_gap_days")]


def daily_aggregates() -> list[Column]:
    """The aggregate list shared by the batch and the streaming job."""
    return [*_counts(), *_means()]


def daily_metrics(applications: DataFrame) -> DataFrame:
    """One row per calendar day, in order; everything is partially aggregated before the shuffle."""
    return applications.groupBy("app_day").agg(*daily_aggregates()).withColumns(_rates()).orderBy("app_day")


def with_rates(daily: DataFrame) -> DataFrame:
    return daily.withColumns(_rates())


def product_metrics(applications: DataFrame) -> DataFrame:
    """One row per day and product, in order; rows without a product are left out."""
    known = applications.filter(F.col("product").isNotNull())
    return known.groupBy("app_day", "product").agg(*_counts()).withColumns(_rates()).orderBy("app_day", "product")


def daily_and_product_metrics(applications: DataFrame) -> DataFrame:
    """Both tables from one scan: grouping sets (day) and (day, product); ``is_total`` marks the day rows.

    Product rows with a missing product are removed, day totals still include them.
    """
    known = applications.withColumn("has_product", F.col("product").isNotNull())
    both = known.groupingSets(
        [["app_day"], ["app_day", "product", "has_product"]], "app_day", "product", "has_product"
    ).agg(*_counts(), F.grouping("product").alias("is_total"))
    return both.filter((F.col("is_total") == 1) | F.col("has_product")).drop("has_product").withColumns(_rates())


def _day(value: date | str) -> date:
    return date(*map(int, value.split("-"))) if isinstance(value, str) else value


def anomaly_summary(daily: DataFrame, start: date | str, end: date | str, strict: bool = True) -> DataFrame:
    """Means of each daily metric inside [start, end] and outside it, with the relative change.

    One conditional aggregate gives one row; the unpivot makes it a table of at most eight rows.
    """
    start, end = _day(start), _day(end)
    if start > end:
        raise ValueError(f"The window ends on {end}, before it starts on {start}.")
    first, last = F.lit(start), F.lit(end)
    metrics = [m for m in WINDOW_METRICS if m in daily.columns]
    inside = F.col("app_day").between(first, last)
    means = daily.agg(F.count_if(inside).alias("n_in"), F.count("*").alias("n_all"), *[
        F.avg(F.when(inside if side == "in" else ~inside, F.col(m))).alias(f"{side}_{m}")
        for m in metrics for side in ("in", "out")
    ])
    if strict:  # the one row is needed to check the window, so it is not computed again for the result
        row = means.first()
        if row["n_in"] == 0 or row["n_in"] == row["n_all"]:
            raise ValueError(f"The window holds {row['n_in']} of {row['n_all']} days; both it and the rest need some.")
        means = daily.sparkSession.createDataFrame([row], means.schema)
    rows = means.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"out_{m}").alias("baseline_mean"), F.col(f"in_{m}").alias("anomaly_mean"))
        for m in metrics
    ])).alias("r")).select("r.*")
    change = F.try_divide(F.col("anomaly_mean") - F.col("baseline_mean"), F.col("baseline_mean"))
    return rows.withColumn("pct_change", change).orderBy(F.abs("pct_change").desc_nulls_last(), "metric")
