"""Registered queries that have a SQL counterpart. Each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskweir.functions.coerce import typed_once
from riskweir.models.scoring import hash_sample
from riskweir.operators import audit, cleaning, compare, daily, decide, drift, evaluate, fill, identity, idtree, split, violations as v
from riskweir.plans.oracle import MEAN_DIGITS, WINDOW
from riskweir.schema import CATEGORICAL, FEATURES, ID, LABEL, FeatureGroups
from riskweir.session import scratch
from riskweir.sources import readers, testbed as tb, writers

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _round(df: DataFrame, digits: int, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _apps(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_applications(tb.applications_raw(spark, sf), tb.TIE_BREAK)


#: Features whose drift is watched, and where the baseline ends.
DRIFT_NUMBERS, DRIFT_TEXTS, BASELINE_END = ("credit_score", "fraud_score", "date_gap_days"), ("product", "industry", "state"), "1996-07-01"


# -- cleaning and daily tables


@query
def clean_applications(spark, sf):
    return _apps(spark, sf)


@query
def latest_record(spark, sf):
    landed = cleaning.land_applications(tb.applications_raw(spark, sf), tb.TIE_BREAK)
    checked = v.guarded(landed, cleaning.application_rules(landed))
    newest = cleaning.latest_record(cleaning.type_applications(checked), "application_id", "application_date", tb.TIE_BREAK)
    return newest.select("application_id", "application_date", "final_decision", "l_linenumber", "l_partkey", "l_suppkey")


@query
def daily_metrics(spark, sf):
    table = daily.daily_metrics(_apps(spark, sf))
    return _round(table, MEAN_DIGITS, [c for c in table.columns if c.startswith("avg_")])


@query
def product_metrics(spark, sf):
    return daily.product_metrics(_apps(spark, sf))


@query
def drift_metrics(spark, sf):
    """Monthly drift of cleaned applications against those before the end of the baseline."""
    path = scratch(spark, "drift")
    _apps(spark, sf).write.parquet(path)
    apps = spark.read.parquet(path)
    frozen = drift.profile(apps.filter(F.col("app_day") < F.lit(BASELINE_END).cast("date")), DRIFT_NUMBERS, DRIFT_TEXTS, most=5)
    table = drift.drift(apps, frozen, {"month": F.trunc("app_day", "month")})
    return _round(table, 6, ["psi", "missing_rate", "missing_shift"])


@query
def daily_and_product_metrics(spark, sf):
    return daily.daily_and_product_metrics(_apps(spark, sf)).withColumn("is_total", F.col("is_total").cast("int"))


@query
def anomaly_summary(spark, sf):
    days = tb.stored(daily.daily_metrics(_apps(spark, sf)), "daily")
    return _round(daily.anomaly_summary(days, *WINDOW), 6, ["baseline_mean", "anomaly_mean", "pct_change"])


@query
def clean_merchants(spark, sf):
    return cleaning.clean_merchants(tb.merchants_raw(spark, sf)).withColumn(LABEL, F.col(LABEL).cast("int"))


@query
def csv_landing(spark, sf):
    """Raw merchants written as CSV, read back with an all-text schema, cleaned."""
    raw = tb.merchants_raw(spark, sf).drop("OpenDate")
    path = scratch(spark, "csv")
    writers.write_table(raw, path, "csv")
    landed = readers.read_csv(spark, path, raw.columns)
    return cleaning.clean_merchants(landed).withColumn(LABEL, F.col(LABEL).cast("int"))


@query
def json_landing(spark, sf):
    """Scoring features written as JSON records, read back as text under the names they have, validated and typed."""
    path = scratch(spark, "json")
    writers.write_records(tb.merchants(spark, sf).select(ID, *FEATURES.all), path)
    return cleaning.scoring_frame(readers.read_json_text(spark, path, lines=True), carry=(ID,))


# -- violations


def _ends(column: str, digits: str):
    return F.col(column).endswith(digits)


@query
def binary_violations(spark, sf):
    bad = tb.merchants(spark, sf).select(
        F.when(_ends(ID, "3"), "maybe").when(_ends(ID, "4"), "0.5").when(_ends(ID, "5"), F.col(ID)).otherwise("Y").alias("is_connected"),
        F.when(_ends(ID, "9"), -1).otherwise(F.col(LABEL)).alias(LABEL),
    )
    return v.violations(bad, v.binary_rules(bad, ["is_connected", LABEL]))


@query
def decision_violations(spark, sf):
    landed = cleaning.land_applications(tb.applications_raw(spark, sf), ("l_linenumber", "l_suppkey"))
    bad = landed.withColumn(
        "final_decision",
        F.when(F.col("l_linenumber") == 1, None)
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("pending "), F.col("l_suppkey").cast("string")))
        .otherwise(F.col("final_decision")),
    )
    return v.violations(bad, cleaning.application_rules(bad))


def bad_merchants(spark, sf):
    level = F.col("reputation_level")
    return tb.merchants(spark, sf).withColumns({
        "identity_rank": F.when(level % 5 == 4, "4d").when(level % 5 == 3, "inf").otherwise(F.col("identity_rank").cast("string")),
        "is_valid": F.when(_ends(ID, "7"), "maybe").when(_ends(ID, "8"), "2").otherwise(F.col("is_valid").cast("int").cast("string")),
        ID: F.when(_ends(ID, "11"), None).when(_ends(ID, "12"), "  ").when(_ends(ID, "13"), "Null")
        .when(_ends(ID, "14"), "order-twin").otherwise(F.col(ID)),
    })


@query
def scoring_schema_violations(spark, sf):
    bad = bad_merchants(spark, sf)
    made, numbers, _ = typed_once(bad, FEATURES.continuous, [])
    return v.violations(made, v.scoring_rules(bad, numbers=numbers))


@query
def counted_rejections(spark, sf):
    """Bad cells counted in the pass that reads the rows, for applications and for scoring features."""
    landed = cleaning.land_applications(tb.applications_raw(spark, sf), ("l_linenumber",))
    bad = landed.withColumn("final_decision", F.when(F.col("l_linenumber") == 2, F.concat(F.lit("pending "), F.col("l_linenumber"))).otherwise(F.col("final_decision")))
    merchants = bad_merchants(spark, sf)
    rows = []
    for table, df, rules in (("applications", bad, cleaning.application_rules(bad)), ("features", merchants, v.scoring_rules(merchants))):
        sound, check = v.observed(df, rules)
        sound.write.format("noop").mode("overwrite").save()
        rows += [(table, rule, n, "|".join(shown)) for rule, n, shown in check.found()]
    return spark.createDataFrame(rows, "source string, rule string, n_bad bigint, examples string")


@query
def id_violations(spark, sf):
    return v.id_violations(bad_merchants(spark, sf))


@query
def domain_violations(spark, sf):
    bad = tb.scored_long(spark, sf).select(
        F.when(_ends(ID, "1"), 1.5).when(_ends(ID, "2"), None).otherwise(F.col("score")).alias("score"),
        F.when(_ends(ID, "3"), 2).otherwise(F.col(LABEL)).alias(LABEL),
        F.when(_ends(ID, "4"), "bogus").otherwise("approve").alias("decision"),
    )
    return v.violations(bad, [v.score_rule("score"), v.label_rule(LABEL), v.choice_rule("decision", decide.CHOICES)])


# -- splits and identity


@query
def stratified_split(spark, sf):
    return split.stratified_split(tb.merchants(spark, sf).select(ID, LABEL))


@query
def split_audit(spark, sf):
    return split.split_audit(tb.split_merchants(spark, sf))


@query
def holdout_split(spark, sf):
    return split.holdout_split(tb.merchants(spark, sf).select(ID, LABEL))


@query
def kfold_assignment(spark, sf):
    keys = tb.train_merchants(spark, sf).select(ID, LABEL)
    return split.kfold(keys)


@query
def split_overlap_check(spark, sf):
    parts = tb.split_merchants(spark, sf).select(ID, "split")
    twice = parts.filter(_ends(ID, "77")).select(ID, F.lit("test").alias("split"))
    stray = parts.filter(_ends(ID, "78")).select(F.concat(F.col(ID), F.lit("x")).alias(ID), F.lit(None).cast("string").alias("split"))
    return split.split_overlap(parts.unionByName(twice).unionByName(stray))


@query
def label_alignment_check(spark, sf):
    keys = tb.stored(tb.merchants(spark, sf).select(ID, LABEL), "keys")
    labels = keys.filter(~_ends(ID, "22")).unionByName(keys.filter(_ends(ID, "23")))
    return identity.alignment(keys.filter(~_ends(ID, "21")), labels)


@query
def attached_labels(spark, sf):
    rows = tb.stored_merchants(spark, sf)
    return identity.attach_labels(rows.select(ID, "ea_score"), rows.select(ID, LABEL))


@query
def membership_fingerprints(spark, sf):
    return identity.membership_fingerprints(tb.split_merchants(spark, sf))


@query
def manifest_check(spark, sf):
    """Development rows read from the merchants, against the record made of the stored membership; any difference is an error."""
    membership, record = _approved(spark, sf)
    verified = identity.check_manifest(split.members_of(tb.merchants(spark, sf), membership, ("train", "validation")), record)
    return spark.createDataFrame([(verified["rows"], verified["members"])], "verified_row_count bigint, verified_membership string")


def _approved(spark, sf) -> tuple[DataFrame, dict]:
    membership = tb.stored(tb.split_merchants(spark, sf).select(ID, "split"), "membership")
    return membership, identity.manifest(split.development_rows(membership), reference="development")


@query
def manifest_difference(spark, sf):
    """What the record says about a set that lacks some approved rows and holds some others."""
    membership, record = _approved(spark, sf)
    rows = tb.stored(tb.merchants(spark, sf).select(ID), "ids")  # both parts of the set and two passes over it read them
    development = split.members_of(rows, membership, ("train", "validation")).filter(~_ends(ID, "21"))
    strange = rows.filter(_ends(ID, "22")).select(F.concat(F.col(ID), F.lit("x")).alias(ID))
    found = identity.manifest_differences(tb.stored(development.unionByName(strange), "found"), record, split.development_rows(membership).select(ID))
    counts = [found["rows"][0], found["rows"][1], found["not approved"][0], found["absent"][0]]
    return spark.createDataFrame([counts], "n_found bigint, n_approved bigint, not_approved bigint, absent bigint")


@query
def membership_difference(spark, sf):
    """The ids by which a set differs from the approved one, found by their fingerprint trees."""
    membership, _ = _approved(spark, sf)
    approved = split.development_rows(membership).select(ID)
    rows = tb.merchants(spark, sf).select(ID)
    found = split.members_of(rows, membership, ("train", "validation")).filter(~_ends(ID, "21"))
    strange = rows.filter(_ends(ID, "22")).select(F.concat(F.col(ID), F.lit("x")).alias(ID))
    left, right = (idtree.build(df, scratch(spark, "id-tree"), digits=2) for df in (found.unionByName(strange), approved))
    return idtree.difference(spark, left, right).select("id", F.col("n_left").alias("n_found"), F.col("n_right").alias("n_approved"))


@query
def heldout_quarantine(spark, sf):
    return split.quarantine_test(tb.stored_merchants(spark, sf)).select(ID, LABEL, "split", *FEATURES.all)


@query
def development_rows(spark, sf):
    return split.development_rows(tb.split_merchants(spark, sf)).select(ID, LABEL, "split")


@query
def membership_selection(spark, sf):
    membership = tb.stored(tb.split_merchants(spark, sf).select(ID, "split"), "membership")
    return split.members_of(tb.merchants(spark, sf), membership, ("validation",)).select(ID, LABEL, *FEATURES.all)


@query
def content_fingerprint(spark, sf):
    return identity.content_fingerprint(tb.split_merchants(spark, sf), by="split")


@query
def representation_audit(spark, sf):
    return identity.representation_audit(tb.split_merchants(spark, sf), FEATURES.all)


@query
def hash_sample_rows(spark, sf):
    rows = tb.split_merchants(spark, sf).filter(F.col("split") == "validation")
    return hash_sample(rows.select(ID, LABEL), 500)


QUERIES["hash_sample"] = QUERIES.pop("hash_sample_rows")


# -- fills, missing values, audit


def _fill_table(spark, sf, boolean):
    found = fill.fill_values(tb.train_merchants(spark, sf), FEATURES, boolean)
    is_text = F.col("feature").isin(list(CATEGORICAL))
    return found.select(
        "feature", F.when(~is_text, F.round(F.col("fill").try_cast("double"), 6)).alias("number"), F.when(is_text, F.col("fill")).alias("text"))


@query
def train_fill_values(spark, sf):
    return _fill_table(spark, sf, "median")


@query
def onehot_fill_values(spark, sf):
    return _fill_table(spark, sf, "mode")


@query
def imputed_merchants(spark, sf):
    parts = tb.split_merchants(spark, sf)
    fills = fill.fill_dict(parts.filter(F.col("split") == "train"), FEATURES)
    rounded = {f: round(x, 6) if isinstance(x, float) else x for f, x in fills.items()}
    return fill.impute(parts, FEATURES, rounded).select(ID, "split", *FEATURES.all)


@query
def missing_rates(spark, sf):
    rates = fill.missing_rates(tb.train_merchants(spark, sf), FEATURES.all)
    return rates.withColumn("indicator", F.col("missing_rate").between(0.01, 0.95))


@query
def missing_indicators(spark, sf):
    parts = tb.split_merchants(spark, sf)
    chosen = fill.indicator_features(parts.filter(F.col("split") == "train"), FEATURES.all)
    wide, groups = fill.add_missing_features(parts, FEATURES, chosen, vendor_count=True)
    return wide.select(ID, *[f for f in groups.all if f not in FEATURES.all])


@query
def missingness_analysis(spark, sf):
    return audit.missingness_analysis(tb.train_merchants(spark, sf), FEATURES.all)


@query
def feature_audit_common(spark, sf):
    return audit.audit_common(tb.train_merchants(spark, sf), FEATURES)


@query
def feature_audit_numeric(spark, sf):
    table = audit.audit_numeric(tb.train_merchants(spark, sf), FEATURES)
    return _round(table, 6, [c for c in table.columns if c != "feature"])


@query
def feature_audit_values(spark, sf):
    return audit.audit_values(tb.train_merchants(spark, sf), FEATURES)


@query
def feature_audit_rare(spark, sf):
    values = audit.audit_values(tb.train_merchants(spark, sf), FEATURES)
    return audit.rare_rows(values)


@query
def feature_audit(spark, sf):
    table = audit.feature_audit(tb.train_merchants(spark, sf), FEATURES)
    return _round(table, 6, list(audit.NUMERIC_CELLS))


# -- metrics, decisions, selection

METRIC_KEYS = ["model", "feature_configuration", "split"]


def _metrics(spark, sf, by=METRIC_KEYS):
    return _round(evaluate.metrics(tb.scored_long(spark, sf), by), 10, list(evaluate.METRICS))


@query
def probability_metrics(spark, sf):
    return _metrics(spark, sf)


@query
def average_precision(spark, sf):
    return _metrics(spark, sf).select(*METRIC_KEYS, "pr_auc")


@query
def roc_auc(spark, sf):
    return _metrics(spark, sf).select(*METRIC_KEYS, "roc_auc")


@query
def threshold_metrics(spark, sf):
    table = evaluate.threshold_metrics(tb.scored_long(spark, sf), METRIC_KEYS)
    return _round(table, 10, [c for c in table.columns if c not in METRIC_KEYS])


@query
def fold_summary(spark, sf):
    long = tb.long_scores(split.kfold(tb.split_scores(spark, sf).drop("split")), "fold").filter(F.col("score").isNotNull())
    table = _round(evaluate.metrics(long, ["model", "feature_configuration", "fold"]), 10, ["pr_auc"])
    return _round(compare.fold_summary(table, ["model", "feature_configuration"]), 8, ["mean_pr_auc", "std_pr_auc"])


@query
def three_way_decision(spark, sf):
    scored = tb.scored_long(spark, sf)
    return decide.decide(scored, 0.8, 0.2, "score").select(ID, "model", "feature_configuration", "decision")


@query
def decision_policy(spark, sf):
    decided = decide.apply_policy(tb.scored_long(spark, sf), review_threshold=0.3, decline_threshold=0.7, score="score")
    return decided.select(ID, "model", "feature_configuration", "decision", "decision_policy")


@query
def profit_summary(spark, sf):
    test = tb.scored_long(spark, sf).filter(F.col("split") == "test")
    decided = decide.decide(test, 0.8, 0.2, "score")
    table = decide.profit(decided, ["model", "feature_configuration"], F.col("model") == "model_b")
    return _round(table, 4, ["profit"])


FULL_KEYS = ["model", "feature_configuration", "n_features", "split"]


def _validation(spark, sf):
    table = _metrics(spark, sf, FULL_KEYS).filter(F.col("split") == "validation")
    return table.select("model", "feature_configuration", "n_features", F.col("pr_auc").alias("validation_pr_auc"))


@query
def best_model(spark, sf):
    table = _metrics(spark, sf, FULL_KEYS).filter(F.col("feature_configuration") == "value")
    rows = table.groupBy("model").agg(*[
        F.max(F.when(F.col("split") == s, F.col("pr_auc"))).alias(f"{s}_pr_auc") for s in ("validation", "test")])
    return compare.mark_best(rows, "validation_pr_auc")


@query
def config_choice(spark, sf):
    return _round(compare.choose_configuration(_validation(spark, sf), tolerance=0.05), 9, ["mean_validation_pr_auc"])


@query
def ablation_delta(spark, sf):
    return _round(compare.with_delta(_validation(spark, sf), "value"), 9, ["validation_pr_auc_delta"])


@query
def improvement_label(spark, sf):
    steps = Window.partitionBy("model").orderBy("n_features")
    rows = _validation(spark, sf)
    delta = F.round(F.col("validation_pr_auc") - F.lag("validation_pr_auc").over(steps), 9)
    rows = rows.select("model", "feature_configuration", F.coalesce(delta, F.lit(0.0)).alias("delta"))
    return rows.withColumn("improvement_assessment", compare.improvement(F.col("delta")))


@query
def freeze_choice(spark, sf):
    scores = {"default_pr_auc": "quantity", "tuned_pr_auc": "lines"}
    rows = _validation(spark, sf).groupBy("model").agg(*[
        F.max(F.when(F.col("feature_configuration") == c, F.col("validation_pr_auc"))).alias(name) for name, c in scores.items()])
    return _round(compare.freeze(rows), 9, ["validation_pr_auc_delta"])


@query
def running_best(spark, sf):
    order = Window.partitionBy("model").orderBy(F.col("feature_configuration").desc(), "split")
    trials = _metrics(spark, sf, FULL_KEYS).select(
        "model", (F.row_number().over(order) - 1).cast("bigint").alias("trial_number"), F.col("pr_auc").alias("cv_mean_pr_auc"))
    return compare.running_best(trials)


def _importance(spark, sf):
    table = _metrics(spark, sf, FULL_KEYS)
    low = F.min("pr_auc").over(Window.partitionBy(F.lit(0)))  # eighteen metric rows
    rows = table.withColumn("importance", F.round(F.col("pr_auc") - low, 9)).filter(F.col("split") == "validation")
    return rows.select("model", F.col("feature_configuration").alias("feature"), "importance")


@query
def importance_rank(spark, sf):
    return compare.rank_importance(_importance(spark, sf), "importance")


@query
def topk_features(spark, sf):
    return _round(compare.top_features(_importance(spark, sf), "importance", 2), 9, ["importance"])


@query
def attribution_by_source(spark, sf):
    groups = FeatureGroups(("volume", "value"))
    names = ["onehot__value_x", "onehot__volume_lines", "onehot__volume_quantity"]
    sources = spark.createDataFrame([(n, fill.source_feature(n, groups)) for n in names], "column string, feature string")
    column = F.when(F.col("feature_configuration") == "value", names[0]).otherwise(F.concat(F.lit("onehot__volume_"), F.col("feature_configuration")))
    rows = tb.scored_long(spark, sf).select("model", column.alias("column"), (F.col("score") - 0.5).alias("value"))
    return _round(compare.sum_by_source(rows, sources), 9, ["mean_abs"])


@query
def family_comparison(spark, sf):
    table = _metrics(spark, sf, FULL_KEYS).drop("n_features")

    def part(configuration, name, prefix):
        rows = table.filter((F.col("feature_configuration") == configuration) & (F.col("split") == name))
        return rows.withColumn("model", F.concat(F.lit(prefix), F.col("model")))

    validation = part("lines", "validation", "tuned_").withColumn("selected", F.lit(True)).unionByName(
        part("value", "validation", "tuned_").withColumn("selected", F.lit(False)))
    found = compare.family_comparison(
        validation, part("lines", "test", "tuned_"), part("quantity", "validation", "default_"), part("quantity", "test", "default_"))
    return _round(found, 9, ["validation_minus_test_pr_auc"])
