"""Feature audit and missingness analysis: a few aggregates for all features together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweir.operators.fill import long_numbers, long_texts
from riskweir.operators.ranking import exact_quantiles, value_edges
from riskweir.schema import EXCLUDED, LABEL, MISSING, VENDOR, FeatureGroups, source_of

NEAR_CONSTANT = 0.99
ID_LIKE = 0.98
RARE_ROWS = 5
RARE_SHARE = 0.01
# Fixed value: the note of a feature that looks like an identifier.
REVIEW_NOTE = "Potential identifier or near-unique field; review before production."


def value_counts(train: DataFrame, groups: FeatureGroups) -> DataFrame:
    """(feature, value text or NULL, n, fraud) for every feature."""
    numbers = long_numbers(train, groups.continuous, [LABEL]) if groups.continuous else None
    texts = long_texts(train, list(groups.categorical), [LABEL]) if groups.categorical else None

    def counted(cells: DataFrame) -> DataFrame:
        found = cells.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum(LABEL).cast("bigint").alias("fraud"))
        return found.withColumn("value", F.col("value").cast("string"))

    parts = [counted(c) for c in (numbers, texts) if c is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _kind(groups: FeatureGroups) -> Column:
    return F.when(F.col("feature").isin(list(groups.numeric)), "numeric").when(
        F.col("feature").isin(list(groups.boolean)), "boolean").otherwise("categorical")


def audit_common(train: DataFrame, groups: FeatureGroups) -> DataFrame:
    """Missing and distinct counts, constant / near-constant / id-like flags, one row per feature.

    Values are merged by (feature, value); the second step needs sums and maxima only, so each task
    sends one row per feature.
    """
    counts = value_counts(train, groups)
    observed = F.col("value").isNotNull()
    sums = counts.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~observed, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count_if(observed).alias("unique_count"), F.count("*").alias("_kinds"), F.max("n").alias("_top"),
    )
    seen = F.col("rows") - F.col("missing_count")
    id_like = F.col("feature").endswith("_id") | F.coalesce(
        F.try_divide(F.col("unique_count").cast("double"), seen.cast("double")) >= ID_LIKE, F.lit(False))
    return sums.withColumns({
        "feature_type": _kind(groups),
        "source": F.when(F.col("feature").isin(list(VENDOR)), "vendor").otherwise("in_house"),
        "allowed_primary_benchmark": F.lit(True),
        "missing_rate": F.col("missing_count").cast("double") / F.col("rows"),
        "constant": F.col("_kinds") <= 1,
        "near_constant": F.col("_top").cast("double") / F.col("rows") >= NEAR_CONSTANT,
        "suspicious_id_like": id_like,
    }).withColumns({
        "cardinality": F.when(F.col("feature_type") != "numeric", F.col("unique_count")),
        "review_note": F.when(F.col("suspicious_id_like"), REVIEW_NOTE).otherwise(""),
    }).select(
        "feature", "feature_type", "source", "allowed_primary_benchmark", "missing_count", "missing_rate",
        "unique_count", "cardinality", "constant", "near_constant", "suspicious_id_like", "review_note",
    )


def audit_numeric(train: DataFrame, groups: FeatureGroups) -> DataFrame:
    """Mean, deviation, quantiles and per-class location of the numeric features.

    Means come from one wide aggregate row. Quantiles are exact and interpolated: overall and per class
    from the same histogram of values.
    """
    features = list(groups.numeric)
    classes = {"fraud": F.col(LABEL) == 1, "non_fraud": F.col(LABEL) == 0}
    wide = train.agg(*[
        agg.alias(f"{f}.{name}") for f in features for name, agg in (
            ("mean", F.avg(f)), ("std", F.stddev_samp(f)),
            *[(f"{c}_mean", F.avg(F.when(test, F.col(f)))) for c, test in classes.items()],
        )
    ])
    names = ["mean", "std", "fraud_mean", "non_fraud_mean"]
    moments = wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}.{n}`").alias(n) for n in names]) for f in features
    ])).alias("r")).select("r.*")
    cells = long_numbers(train, features, [LABEL]).filter(F.col("value").isNotNull())
    hist = cells.groupBy("feature", "value").agg(
        F.count("*").alias("n"), F.sum(LABEL).cast("bigint").alias("fraud"), F.sum(1 - F.col(LABEL)).cast("bigint").alias("non_fraud"))
    quantiles = exact_quantiles(
        hist, "feature", "value", {"n": [0.05, 0.25, 0.5, 0.75, 0.95], "fraud": [0.5], "non_fraud": [0.5]}, value_edges(cells, "value"))
    spots = {"q05": ("n", 0.05), "q25": ("n", 0.25), "median": ("n", 0.5), "q75": ("n", 0.75), "q95": ("n", 0.95),
             "fraud_median": ("fraud", 0.5), "non_fraud_median": ("non_fraud", 0.5)}
    placed = quantiles.groupBy("feature").agg(*[
        F.max(F.when((F.col("weight") == w) & (F.col("p") == p), F.col("quantile"))).alias(name) for name, (w, p) in spots.items()
    ])
    # Both sides hold one row per feature.
    return moments.join(placed, "feature", "left").select(
        "feature", "mean", "median", "std", "q05", "q25", "q75", "q95",
        "fraud_mean", "fraud_median", "non_fraud_mean", "non_fraud_median",
    )


def audit_values(train: DataFrame, groups: FeatureGroups) -> DataFrame:
    """(feature, value, n, fraud_rate, rare) for boolean and categorical features, missing shown as a value."""
    counts = value_counts(train, FeatureGroups((), groups.boolean, groups.categorical))
    # One row per feature: the counts of a feature add up to the number of rows.
    rows = counts.groupBy("feature").agg(F.sum("n").alias("rows"))
    limit = F.greatest(F.lit(RARE_ROWS), F.ceil(F.col("rows") * F.lit(RARE_SHARE)))
    return counts.join(F.broadcast(rows), "feature").select(
        "feature", F.coalesce("value", F.lit(MISSING)).alias("value"), "n",
        (F.col("fraud").cast("double") / F.col("n")).alias("fraud_rate"), (F.col("n") < limit).alias("rare"),
    )


def rare_rows(values: DataFrame) -> DataFrame:
    """(feature, rare_category_rows, n_values) of the long value table, which holds the values themselves, however many there are."""
    rare = F.coalesce(F.sum(F.when(F.col("rare"), F.col("n"))), F.lit(0))
    return values.groupBy("feature").agg(rare.alias("rare_category_rows"), F.count("*").alias("n_values"))


#: Columns of the numeric part of the audit.
NUMERIC_CELLS = ("mean", "median", "std", "q05", "q25", "q75", "q95", "fraud_mean", "fraud_median", "non_fraud_mean", "non_fraud_median")


def feature_audit(train: DataFrame, groups: FeatureGroups) -> DataFrame:
    """One row per feature: the common part, the numeric part and the counts of values. :func:`audit_values` lists the values."""
    full = audit_common(train, groups)
    if groups.numeric:
        full = full.join(audit_numeric(train, groups), "feature", "left")
    if groups.boolean or groups.categorical:
        full = full.join(rare_rows(audit_values(train, groups)), "feature", "left")
    return full


def missingness_analysis(train: DataFrame, features: list[str]) -> DataFrame:
    """Fraud rate when a feature is missing and when it is present; features with both kinds only.

    One aggregate row over the wide table, then one row per feature.
    """
    sums = train.agg(F.count("*").alias("n"), F.sum(LABEL).cast("bigint").alias("fraud"), *[
        agg for f in features for agg in (
            F.count_if(F.col(f).isNull()).alias(f"{f}.n"),
            F.coalesce(F.sum(F.when(F.col(f).isNull(), F.col(LABEL))), F.lit(0)).cast("bigint").alias(f"{f}.fraud"))
    ])
    rows = sums.select("n", "fraud", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}.n`").alias("missing_count"), F.col(f"`{f}.fraud`").alias("missing_fraud"))
        for f in features
    ])).alias("r")).select("n", "fraud", "r.*").filter((F.col("missing_count") > 0) & (F.col("missing_count") < F.col("n")))
    gone = F.col("missing_fraud").cast("double") / F.col("missing_count")
    there = (F.col("fraud") - F.col("missing_fraud")).cast("double") / (F.col("n") - F.col("missing_count"))
    return rows.select(
        "feature", "missing_count", (F.col("missing_count").cast("double") / F.col("n")).alias("missing_rate"),
        gone.alias("fraud_rate_when_missing"), there.alias("fraud_rate_when_present"),
        (gone - there).alias("fraud_rate_difference"),
    ).orderBy(F.abs("fraud_rate_difference").desc(), "feature")


def feature_catalog(spark, groups: FeatureGroups) -> DataFrame:
    """(feature, feature_type, source, allowed): provenance of the features, with the excluded ones."""
    rows = [(f, groups.kind(f), source_of(f), True) for f in groups.all]
    rows += [(f, "date" if f == "open_date" else "date_part", "ambiguous", False) for f in EXCLUDED]
    return spark.createDataFrame(rows, "feature string, feature_type string, source string, allowed boolean")


def feature_roles(spark, groups: FeatureGroups) -> DataFrame:
    """(role, features) summary table."""
    vendor = [f for f in VENDOR if f in groups.all]
    rows = [
        ("target", LABEL), ("identifiers", ""), ("allowed_predictive", "|".join(groups.all)), ("vendor", "|".join(vendor)),
        ("excluded_ambiguous", "|".join(EXCLUDED)),
    ]
    return spark.createDataFrame(rows, "role string, features string")
