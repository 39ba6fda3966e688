"""The code of a row stays below what the JVM compiles (8,000 bytes a method), however many rules there are."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from riskweir.operators import cleaning, violations
from riskweir.schema import FEATURES, ID, LABEL, text_schema
from riskweir.sources import testbed


def largest_method(df):
    package = df.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", package.codegenString(df._jdf.queryExecution().executedPlan()))))


def rows(spark, columns, folder, **cells):
    spark.createDataFrame([tuple(cells.get(c, "1") for c in columns)], text_schema(columns)).write.parquet(folder)
    return spark.read.parquet(folder)


def test_scoring_frame_is_compiled(spark, tmp_path):
    df = rows(spark, [ID, *FEATURES.all], str(tmp_path / "rows"), ea_score=" 1e2 ", is_valid=" 0.0")
    frame = cleaning.scoring_frame(df, carry=(ID,))
    assert largest_method(frame) < 8000
    got = frame.first()
    assert frame.columns == [ID, *FEATURES.all] and (got["ea_score"], got["is_valid"], got["type"]) == (100.0, 0.0, "1")


@pytest.mark.parametrize("name, cell, rule", [
    ("ea_score", "4d", "ea_score:not_numeric: 4d"), ("email_days", "inf", "email_days:not_finite: inf"), ("receiving_mail", "2", "receiving_mail:not_binary: 2")])
def test_bad_cells_are_named(spark, tmp_path, name, cell, rule):
    df = rows(spark, [ID, *FEATURES.all], str(tmp_path / "rows"), **{name: cell})
    with pytest.raises(Exception, match=rule):
        cleaning.scoring_frame(df, carry=(ID,)).collect()


def test_texts_of_merchants_are_typed(spark, tmp_path):
    columns = [ID, LABEL, *FEATURES.all]
    df = rows(spark, columns, str(tmp_path / "rows"), is_fraud=" Yes ", ea_score="NULL", is_valid="F", volume_score="x")
    clean = cleaning.clean_merchants(df)
    got = clean.first()
    assert clean.columns == columns and (got[LABEL], got["ea_score"], got["is_valid"], got["volume_score"]) == (1.0, None, 0.0, None)


def test_violations_read_their_rows_once(spark, tmp_path):
    df = rows(spark, [ID, *FEATURES.all], str(tmp_path / "rows"), ea_score="4d", email_days="inf", receiving_mail="2")
    found = violations.violations(df, violations.scoring_rules(df))
    assert {(r["rule"], r["n_bad"], r["examples"]) for r in found.collect()} == {
        ("ea_score:not_numeric", 1, '["4d"]'), ("email_days:not_finite", 1, '["inf"]'), ("receiving_mail:not_binary", 1, '["2"]')}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0] and "array_compact" not in plan and "filter(array" not in plan


def test_lines_are_shuffled_once(spark):
    plan = testbed.merchant_base(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 1 and "hashpartitioning(l_orderkey#" in plan and not re.search(r"hashpartitioning\([^)]*l_suppkey", plan)


def test_orders_are_counted_by_distinct_supplier(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("orders", "customer", "nation", "region"):
        testbed.table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    order = testbed.table(spark, SF, "orders").first()["o_orderkey"]
    lines = [(order, 1, 2.0, "R"), (order, 1, 3.0, "R"), (order, 2, None, "A"), (order, None, 4.0, None), (None, 3, 1.0, "R")]
    made = spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string")
    made.withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp_ntz")).write.parquet(f"{folder}/lineitem.parquet")
    assert [(r["n_lines"], r["quantity"], r["suppliers"], r["positive"]) for r in testbed.merchant_base(spark, folder).collect()] == [(4, 9.0, 2, True)]
