"""Shapes of the physical plans that matter on large inputs."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from riskweir.operators import audit, cleaning, daily, decide, evaluate, fill, identity, ranking, split
from riskweir.schema import FEATURES, ID, LABEL
from riskweir.sources import testbed

PYTHON = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cases(spark, parts, scored):
    train = parts.filter("split = 'train'").drop("split")
    apps = testbed.applications_raw(spark, SF)
    keys = ["model", "feature_configuration"]
    return {
        "clean_applications": cleaning.clean_applications(apps, testbed.TIE_BREAK, strict=False),
        "daily": daily.daily_metrics(cleaning.clean_applications(apps, testbed.TIE_BREAK, strict=False)),
        "merchants": testbed.merchants(spark, SF),
        "split": split.stratified_split(parts.drop("split"), strict=False),
        "kfold": split.kfold(train),
        "metrics": evaluate.metrics(scored, keys),
        "audit": audit.feature_audit(train, FEATURES),
        "fills": fill.fill_values(train, FEATURES),
        "fingerprints": identity.membership_fingerprints(parts),
        "decide": decide.decide(scored, 0.8, 0.2, "score", strict=False),
        "rank": ranking.hash_rank(parts, ID, 1),
    }


@pytest.fixture(scope="module")
def plans(spark, parts, scored):
    stored = testbed.stored(parts, "plan-parts")
    return {name: plan(df) for name, df in cases(spark, stored, scored).items()}


def test_no_python_in_data_paths(plans):
    for name, text in plans.items():
        assert not [p for p in PYTHON if p in text], name


def test_no_cross_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_rows_are_never_sorted_in_one_partition(plans):
    for name in ("clean_applications", "daily", "merchants", "split", "kfold", "metrics", "fills", "fingerprints", "decide"):
        assert "SinglePartition" not in plans[name], name
    # Elsewhere only tables of a bounded size meet in one partition: aggregate rows and prefix offsets.
    for name, text in plans.items():
        for line in text.splitlines():
            if "Exchange SinglePartition" in line:
                below = text.split(line, 1)[1].splitlines()[1]
                assert re.search(r"HashAggregate|SortAggregate|ObjectHashAggregate|TakeOrdered", below), (name, below)


def test_applying_a_split_does_not_shuffle(plans):
    assert "Exchange" not in plans["split"] and "Exchange" not in plans["kfold"]
    assert "Exchange" not in plans["decide"]


def test_membership_reads_only_its_columns(spark, parts):
    stored = testbed.stored(parts, "narrow")
    text = plan(identity.membership_fingerprints(stored))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {ID, "split"}


def test_split_filter_reads_before_features_are_used(spark, parts):
    stored = testbed.stored(parts, "pushed")
    text = plan(stored.filter(F.col("split") == "train").select(LABEL, "ea_score"))
    assert "EqualTo(split,train)" in text and "ReadSchema: struct<is_fraud:int,ea_score:double,split:string>" in text


def test_hot_key_leaves_one_row_per_task(spark):
    """A third of the rows on one id: the shuffle before the newest record holds partial results only."""
    df = spark.range(0, 90_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") * 31 % 1009).alias("t"), F.col("id").alias("u"))
    text = plan(cleaning.latest_record(df, "k", "t", ("u",)))
    assert text.count("Aggregate") == 2 and text.index("Exchange") < text.rindex("partial_max")
    assert cleaning.latest_record(df, "k", "t", ("u",)).count() == 60_001
