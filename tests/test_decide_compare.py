import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskweir.operators import compare, decide, evaluate, fill
from riskweir.schema import FeatureGroups


def scores(spark, rows, schema="is_fraud int, fraud_probability double"):
    return spark.createDataFrame(rows, schema)


def test_three_way_and_profit(spark):
    decided = decide.decide(scores(spark, [(0, 0.19), (1, 0.2), (0, 0.5), (1, 0.8), (1, 0.1)]), 0.8, 0.2)
    assert [r["decision"] for r in decided.collect()] == ["approve", "manual_review", "manual_review", "decline", "approve"]
    row = decide.profit(decided, vendor_called=True).first()
    assert (row["n_approve"], row["n_manual_review"], row["n_decline"]) == (2, 2, 1)
    assert row["revenue"] == pytest.approx(480 + 0.3 * 480)
    assert row["fraud_loss"] == pytest.approx(500 + 0.3 * 500)
    assert row["manual_review_cost"] == 100 and row["vendor_cost"] == 2.5
    assert row["profit"] == pytest.approx(624 - 650 - 100 - 2.5)


@pytest.mark.parametrize("decline, approve", [(0.2, 0.8), (0.5, 0.5), (1.1, 0.2), (0.8, -0.1)])
def test_threshold_order(decline, approve):
    with pytest.raises(ValueError, match="is no policy"):
        decide.decision(F.lit(0.5), decline, approve)


@pytest.mark.parametrize("bad", [None, float("nan"), -0.1, 1.1])
def test_bad_probability(spark, bad):
    with pytest.raises(PySparkException, match="Rejected value in fraud_probability"):
        decide.decide(scores(spark, [(0, bad)]), 0.8, 0.2).collect()


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_a_missing_score_is_never_approved(spark, missing):
    assert decide.decide(scores(spark, [(0, missing)]), 0.8, 0.2, strict=False).first()["decision"] is None


def test_bad_label_and_choice(spark):
    schema = "is_fraud int, decision string"
    with pytest.raises(PySparkException, match="is_fraud:label: 2"):
        decide.profit(scores(spark, [(2, "approve")], schema)).collect()
    with pytest.raises(PySparkException, match="decision:choice: bogus"):
        decide.profit(scores(spark, [(1, "bogus")], schema)).collect()


def test_policy_needs_both_thresholds(spark):
    df = scores(spark, [(0, 0.4)])
    assert decide.apply_policy(df).columns == df.columns
    with pytest.raises(ValueError, match="review and a decline"):
        decide.apply_policy(df, review_threshold=0.3)
    assert decide.apply_policy(df, review_threshold=0.3, decline_threshold=0.8).first()["decision"] == "manual_review"


@pytest.mark.parametrize("delta, word", [(-0.1, "negative"), (0.0, "negligible"), (0.001, "marginal"), (0.005, "meaningful")])
def test_improvement_words(spark, delta, word):
    assert spark.range(1).select(compare.improvement(F.lit(delta)).alias("w")).first()["w"] == word


def test_configuration_choice_prefers_small(spark):
    rows = [("a", "all", 14, 0.960), ("b", "all", 14, 0.950), ("a", "top_8", 8, 0.957), ("b", "top_8", 8, 0.950), ("a", "top_5", 5, 0.90), ("b", "top_5", 5, 0.91)]
    df = spark.createDataFrame(rows, "model string, feature_configuration string, n_features int, validation_pr_auc double")
    assert compare.choose_configuration(df).first()["feature_configuration"] == "top_8"
    assert compare.choose_configuration(df, 0.0001).first()["feature_configuration"] == "all"


def test_freeze_is_strict(spark):
    df = spark.createDataFrame([("m", 0.9, 0.9), ("n", 0.9, 0.91)], "model string, default_pr_auc double, tuned_pr_auc double")
    assert {r["model"]: r["selected_configuration"] for r in compare.freeze(df).collect()} == {"m": "default", "n": "tuned"}


def test_family_comparison_pairs_rows(scored):
    keys = ["model", "feature_configuration", "split"]
    table = evaluate.metrics(scored, keys)

    def pick(configuration, split):
        return table.filter((F.col("feature_configuration") == configuration) & (F.col("split") == split))

    chosen = pick("lines", "validation").withColumn("selected", F.col("model") == "model_a")
    got = compare.family_comparison(chosen, pick("lines", "test"), pick("value", "validation"), pick("value", "test"))
    assert got.count() == 3
    assert all(r["validation_minus_test_pr_auc"] == pytest.approx(r["validation_pr_auc"] - r["test_pr_auc"]) for r in got.collect())


GROUPS = FeatureGroups(("score",), ("flag",), ("country",))


def test_fill_values_come_from_given_rows(spark):
    train = spark.createDataFrame([(1.0, 1.0, "US"), (None, None, "US"), (3.0, 0.0, None), (10.0, 0.0, "CA"), (2.0, 1.0, "CA")], "score double, flag double, country string")
    assert fill.fill_dict(train, GROUPS) == {"score": 2.5, "flag": 0.5, "country": "CA"}
    assert fill.fill_dict(train, GROUPS, "mode")["flag"] == 0.0
    unseen = spark.createDataFrame([(None, 1.0, "GB")], "score double, flag double, country string")
    assert tuple(fill.impute(unseen, GROUPS, fill.fill_dict(train, GROUPS)).first()) == (2.5, 1.0, "GB")


def test_fill_of_unobserved_features(spark):
    empty = spark.createDataFrame([(None, 1.0, None)], "score double, flag double, country string")
    assert fill.fill_dict(empty, GROUPS) == {"score": None, "flag": 1.0, "country": "__MISSING__"}


def test_missing_features(spark):
    df = spark.createDataFrame([(None, 1.0, "US"), (2.0, None, None)], "email_days double, is_valid double, country string")
    groups = FeatureGroups(("email_days",), ("is_valid",), ("country",))
    assert fill.indicator_features(df, groups.all) == ("email_days", "is_valid", "country")
    wide, more = fill.add_missing_features(df, groups, ("email_days",), vendor_count=True)
    assert [(r["email_days_missing"], r["vendor_missing_count"]) for r in wide.collect()] == [(1.0, 1.0), (0.0, 1.0)]
    assert more.all == ["email_days", "vendor_missing_count", "is_valid", "email_days_missing", "country"]
    with pytest.raises(ValueError, match="nothing to flag"):
        fill.add_missing_features(df, groups, ("nope",))


def test_source_feature_takes_the_longest_name():
    groups = FeatureGroups(("email", "email_days"), (), ("type",))
    assert [fill.source_feature(c, groups) for c in ("numeric__email_days", "categorical__type_M", "email_x", "other")] == ["email_days", "type", "email", "other"]
