import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskweir.functions.coerce import as_binary, as_number, as_time, whole_days
from riskweir.operators import cleaning, daily, violations as v
from riskweir.operators.names import development_columns, exact_columns, normalize_names, single_column, snake_case
from riskweir.schema import APPLICATION_COLUMNS, FEATURES, FeatureGroups
from riskweir.session import scratch

COLUMNS = "application_id long, product string, industry string, city string, state string, application_date string, " \
          "final_decision string, is_fraud string, credit_score string, fraud_score double, first_transaction_date string"


def apps(spark, *rows):
    base = {"application_id": 1, "product": "p", "industry": "i", "city": "c", "state": "s", "application_date": "2020-05-02",
            "final_decision": "approved", "is_fraud": "0", "credit_score": "70", "fraud_score": 0.5, "first_transaction_date": None}
    return spark.createDataFrame([tuple((base | r)[c] for c in APPLICATION_COLUMNS) for r in rows], COLUMNS)


@pytest.mark.parametrize("raw, clean", [
    ("EAScore", "eascore"), ("emailDays", "email_days"), (" Final  Decision ", "final_decision"), ("IPAddressLocCity", "ipaddress_loc_city"),
    ("a-b__C", "a_b_c"), ("already_fine", "already_fine"), (7, "7"),
])
def test_snake_case(raw, clean):
    assert snake_case(raw) == clean


def test_name_checks(spark):
    with pytest.raises(ValueError, match="same snake_case name"):
        normalize_names(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))
    df = spark.createDataFrame([(1, 2)], "isFraud int, x int")
    assert single_column(df, "is_fraud") == "isFraud"
    with pytest.raises(ValueError, match="must be one column"):
        single_column(df, "id")
    with pytest.raises(ValueError, match="missing .'y'.*not expected .'x'"):
        exact_columns(df, ["isFraud", "y"])
    with pytest.raises(ValueError, match="not expected"):
        exact_columns(df, ["x"])
    with pytest.raises(ValueError, match="one of the features"):
        development_columns(df, "EmailDays", FEATURES.all)


def test_rates_and_daily_table(spark):
    raw = apps(
        spark,
        {"application_id": 1, "is_fraud": "yes", "first_transaction_date": "2020-05-03"},
        {"application_id": 2, "is_fraud": "1", "final_decision": " DECLINED"},
        {"application_id": 3, "is_fraud": "F", "credit_score": "101", "first_transaction_date": "2020-05-04T12:00:00"},
    )
    row = daily.daily_metrics(cleaning.clean_applications(raw)).first()
    assert (row["applications"], row["approvals"], row["frauds"], row["approved_frauds"]) == (3, 2, 2, 1)
    assert row["application_fraud_rate"] == pytest.approx(2 / 3)
    assert row["approved_fraud_rate"] == pytest.approx(1 / 2)
    assert row["avg_credit_score_on_frauds"] == pytest.approx(70)
    assert row["avg_date_gap_days"] == pytest.approx(1.5)


def test_day_without_approvals_has_no_rate(spark):
    row = daily.daily_metrics(cleaning.clean_applications(apps(spark, {"final_decision": "declined"}))).first()
    assert row["approved_fraud_rate"] is None and row["avg_credit_score_on_approvals"] is None


def test_implausible_newest_record_removes_the_id(spark):
    raw = apps(
        spark,
        {"application_date": "2020-05-01", "first_transaction_date": "2020-05-09"},
        {"application_date": "2020-05-08", "first_transaction_date": "2020-05-07"},
    )
    assert cleaning.clean_applications(raw).count() == 0


def test_rows_without_id_date_or_label_are_dropped(spark):
    raw = apps(spark, {"application_id": None}, {"application_id": 5, "application_date": "T10"}, {"application_id": 6, "is_fraud": None}, {"application_id": 7})
    assert [r["application_id"] for r in cleaning.clean_applications(raw).collect()] == [7]


@pytest.mark.parametrize("bad", [None, "PENDING"])
def test_bad_decision_raises_even_on_a_row_dropped_later(spark, bad):
    raw = apps(spark, {}, {"application_id": None, "final_decision": bad})
    with pytest.raises(PySparkException, match="Rejected value in final_decision"):
        cleaning.clean_applications(raw).collect()
    with pytest.raises(ValueError, match="final_decision: 1 cells"):
        cleaning.check_applications(cleaning.land_applications(raw))


def test_null_text_is_a_bad_label_for_applications(spark):
    with pytest.raises(PySparkException, match="Rejected value in is_fraud: NULL"):
        cleaning.clean_applications(apps(spark, {"is_fraud": "NULL"})).collect()


def test_validation_reads_each_input_once(spark):
    plan = cleaning.clean_applications(apps(spark, {}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "raise_error" in plan


def test_white_space_of_any_kind_is_stripped(spark):
    df = spark.createDataFrame([("Yes\t",), ("\u00a0no\n",), ("\t1.0 ",)], "x string")
    assert [r[0] for r in df.select(as_binary(df, "x")).collect()] == [1.0, 0.0, 1.0]
    ids = spark.createDataFrame([("\t",), ("a",)], "id string")
    assert v.id_violations(ids).first()["n_blank"] == 1


def test_other_spellings_of_zero_and_one_are_bad(spark):
    df = spark.createDataFrame([("00",), ("+1",), ("1e0",), ("1.00",)], "x string")
    assert [r[0] for r in df.select(v.binary_is_bad(df, "x")).collect()] == [True] * 4


def test_split_applications_routes_bad_rows(spark):
    good, bad = cleaning.split_applications(apps(spark, {}, {"is_fraud": "maybe"}, {"final_decision": None}))
    assert (good.count(), bad.count()) == (1, 2)


def test_coercions(spark):
    df = spark.createDataFrame([(" YES ",), ("1.0",), ("f",), ("2",), ("4d",), (" 1e3 ",), (None,), ("inf",)], "x string")
    got = df.select(as_binary(df, "x").alias("b"), as_number(df, "x").alias("n"), v.binary_is_bad(df, "x").alias("bad")).collect()
    assert [r["b"] for r in got] == [1.0, 1.0, 0.0, None, None, None, None, None]
    assert [r["n"] for r in got] == [None, 1.0, None, 2.0, None, 1000.0, None, float("inf")]
    assert [r["bad"] for r in got] == [False, False, False, True, True, True, False, True]
    for kind, values, want in (("boolean", [True, False, None], [1.0, 0.0, None]), ("double", [1.0, 0.5, float("nan")], [1.0, None, None])):
        typed = spark.createDataFrame([(x,) for x in values], f"x {kind}")
        assert [r[0] for r in typed.select(as_binary(typed, "x")).collect()] == want


def test_time_and_whole_days(spark):
    df = spark.createDataFrame([("2020-03-01 23:00:00", "2020-03-02 01:00:00"), ("2020-03-02", "2020-03-01"), ("05/03/2020", "x")], "a string, b string")
    typed = df.select(as_time(df, "a", ("dd/MM/yyyy",)).alias("a"), as_time(df, "b").alias("b"))
    got = typed.select("a", whole_days(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in got] == [0, -1, None]
    assert got[2]["a"].month == 3


def test_merchants_aliases_tokens_and_types(spark):
    raw = spark.createDataFrame([("0", "NULL", "4", "null", "0212"), ("yes", "N", "x", "A", "")], "isFraud string, IsConnected string, EAScore string, type string, AreaCode string")
    got = cleaning.clean_merchants(raw).collect()
    assert [r["is_fraud"] for r in got] == [0.0, 1.0]
    assert [r["is_connected"] for r in got] == [None, 0.0]
    assert [r["ea_score"] for r in got] == [4.0, None]
    assert [r["area_code"] for r in got] == ["0212", None]
    assert [r["type"] for r in got] == [None, "A"]


@pytest.mark.parametrize("column", ["is_fraud", "IsConnected"])
@pytest.mark.parametrize("bad", ["2", "-1", "0.5", "maybe"])
def test_merchants_reject_bad_binary(spark, column, bad):
    row = {"is_fraud": "0", "IsConnected": "1"} | {column: bad}
    with pytest.raises(PySparkException, match=f"Rejected value in .*: {bad}"):
        cleaning.clean_merchants(spark.createDataFrame([tuple(row.values())], "is_fraud string, IsConnected string")).collect()


def test_open_date_parts(spark):
    raw = spark.createDataFrame([("0", "2024-01-01"), ("1", "bad")], "is_fraud string, OpenDate string")
    got = cleaning.clean_merchants(raw).collect()
    assert (got[0]["open_year"], got[0]["open_month"], got[0]["open_day_of_week"]) == (2024, 1, 0)
    assert got[1]["open_date"] is None


def test_model_frame(spark):
    groups = FeatureGroups(("ea_score",), ("is_valid",), ("type",))
    clean = cleaning.clean_merchants(spark.createDataFrame(
        [("a", "0", "1", "1", "x"), ("b", "1", "2", "0", "y"), ("c", None, "3", "0", "z")], "id string, is_fraud string, ea_score string, is_valid string, type string"))
    frame, same = cleaning.model_frame(clean, groups)
    assert frame.columns == ["id", "is_fraud", "ea_score", "is_valid", "type"] and frame.count() == 2 and same == groups
    with pytest.raises(ValueError, match="must be there.*type"):
        cleaning.model_frame(clean.drop("type"), groups)
    assert cleaning.model_frame(clean.drop("type"), groups, allow_partial=True)[1].all == ["ea_score", "is_valid"]
    with pytest.raises(ValueError, match="one class only"):
        cleaning.model_frame(clean.filter("id = 'a'"), groups)
    with pytest.raises(ValueError, match="No feature of these groups"):
        groups.require(["open_date"])


def features(spark, **changes):
    row = dict.fromkeys(FEATURES.continuous, "1") | dict.fromkeys(FEATURES.categorical, "a") | changes
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))


@pytest.mark.parametrize("changes, match", [
    ({"ea_score": "abc"}, "ea_score:not_numeric"), ({"ea_score": "-inf"}, "ea_score:not_finite"), ({"is_valid": "2"}, "is_valid:not_binary"),
    ({"merchant": "m"}, "not expected.*merchant"),
])
def test_scoring_schema_errors(spark, changes, match):
    with pytest.raises((ValueError, PySparkException), match=match):
        cleaning.scoring_frame(features(spark, **changes)).collect()


def test_scoring_schema_orders_columns(spark):
    df = features(spark, ea_score=None)
    assert cleaning.scoring_frame(df.select(*reversed(df.columns))).columns == FEATURES.all


def test_violation_examples_are_limited_and_counted(spark):
    df = spark.range(100).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("x"))
    row = v.violations(df, v.binary_rules(df, ["x"])).first()
    assert row["n_bad"] == 100 and json.loads(row["examples"]) == ["v000", "v001", "v002", "v003", "v004"]


def test_latest_record_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("k"), (F.col("id") % 13).alias("t"), F.col("id").alias("u"))
    hot = df.unionByName(df.withColumn("k", F.lit(99)))
    want = {(r["k"], r["t"], r["u"]) for r in cleaning.latest_record(hot, "k", "t", ("u",)).collect()}
    again = cleaning.latest_record(hot.repartition(9, "u"), "k", "t", ("u",)).collect()
    assert want == {(r["k"], r["t"], r["u"]) for r in again} and len(want) == 8


def test_anomaly_window_checks(spark):
    days = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", 3.0)], "d string, applications double").select(F.to_date("d").alias("app_day"), "applications")
    row = daily.anomaly_summary(days, "2020-01-02", "2020-01-02").first()
    assert (row["baseline_mean"], row["anomaly_mean"], row["pct_change"]) == (1.0, 3.0, 2.0)
    with pytest.raises(ValueError, match="both it and the rest"):
        daily.anomaly_summary(days, "2021-01-01", "2021-01-02")
    with pytest.raises(ValueError, match="before it starts"):
        daily.anomaly_summary(days, "2020-01-03", "2020-01-02")
    assert daily.anomaly_summary(days, "2020-1-2", "2020-10-01").first()["anomaly_mean"] == 3.0


def test_products_without_name_are_left_out(spark):
    clean = cleaning.clean_applications(apps(spark, {"product": None}, {"application_id": 2}))
    assert daily.product_metrics(clean).count() == 1
    both = daily.daily_and_product_metrics(clean)
    assert {(r["is_total"], r["applications"]) for r in both.collect()} == {(1, 2), (0, 1)}


# -- counts in the reading pass


def applications(spark, decisions):
    rows = [(str(i), "P", "I", "C", "S", "2019-01-01", d, "yes" if i % 2 else "no", "1", "0.5", None) for i, d in enumerate(decisions)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in APPLICATION_COLUMNS))


def test_write_counts_all_bad_cells_in_one_pass(spark):
    good = applications(spark, ["approved", " Declined "] * 3)
    path = scratch(spark, "clean")
    table = cleaning.write_applications(good, path)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, cleaning.clean_applications(good).collect())) and table.count() == 6
    bad = applications(spark, ["approved", None, "maybe", "maybe", "later"] + [f"x{i}" for i in range(40)])
    path = scratch(spark, "clean")
    with pytest.raises(ValueError, match="final_decision: 44 cells, such as") as error:
        cleaning.write_applications(bad, path)
    shown = str(error.value).split("such as ")[1].split(", ")
    assert len(set(shown)) == 5 and set(shown) <= {"'<MISSING>'", "'MAYBE'", "'LATER'", *(f"'X{i}'" for i in range(40))}
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_rows_that_are_dropped_are_checked_as_well(spark):
    rows = [(None, "P", "I", "C", "S", None, "never", "yes", "1", "0.5", None)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in APPLICATION_COLUMNS))
    with pytest.raises(ValueError, match="final_decision: 1 cells, such as 'NEVER'"):
        cleaning.write_applications(raw, scratch(spark, "clean"))


def test_scoring_frame_is_written_or_refused_whole(spark):
    sound = features(spark)
    assert cleaning.write_scoring_frame(sound, scratch(spark, "typed")).count() == 1
    with pytest.raises(ValueError, match="ea_score:not_numeric: 1 cells, such as 'abc'.*is_valid:not_binary: 1 cells, such as '2'"):
        cleaning.write_scoring_frame(features(spark, ea_score="abc", is_valid="2"), scratch(spark, "typed"))


def test_check_reads_the_rows_once(spark):
    raw = applications(spark, ["approved"] * 4)
    sound, check = v.observed(cleaning.land_applications(raw), cleaning.application_rules(cleaning.land_applications(raw)))
    plan = sound._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and "Exchange" not in plan
    assert sound.count() == 4 and check.found() == []
    check.raise_if_bad()


def test_check_stays_above_the_cells_it_reads(spark):
    """Cells are made once a row: a check that is pushed into the join below has copies of their expressions, more than a compiler takes."""
    left = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, " Yes").otherwise("no ").alias("isFraud"), F.when(F.col("id") % 3 == 0, "T").otherwise("NULL").alias("isconnected"))
    right = spark.range(50).select(F.col("id").alias("other"), (F.col("id") * 1.5).cast("string").alias("EAScore"))
    clean = cleaning.clean_merchants(left.join(right, F.col("id") == F.col("other")))
    plan = clean.select("id", "is_fraud")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "raise_error" in line]
    assert len(lines) == 1 and "Filter" in lines[0]
    assert "CASE WHEN" not in next(line for line in plan.splitlines() if "Join" in line)
    rows = clean.orderBy("id").collect()
    assert [r["is_fraud"] for r in rows] == [1.0, 0.0] * 25 and rows[4]["ea_score"] == 6.0 and rows[3]["is_connected"] == 1.0 and rows[4]["is_connected"] is None


def test_guard_makes_typed_columns_and_names_the_first_broken_rule(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "n int, t string, x double")
    rules = [v.Rule("t", F.col("t").isNull(), F.col("t")), v.Rule("n", F.col("n") > 2, F.col("n"))]
    got = v.guarded(df.filter("n < 3"), rules, F.col("x").isNotNull(), typed={"t": F.upper("t"), "twice": F.col("n") * 2})
    assert got.columns == ["n", "t", "x", "twice"] and [tuple(r) for r in got.collect()] == [(1, "A", 1.0, 2)]
    with pytest.raises(PySparkException, match="Rejected value in t: <MISSING>"):
        v.guarded(df, rules, F.col("x").isNotNull()).collect()
    with pytest.raises(PySparkException, match="Rejected value in n: 3"):
        v.guarded(df, rules[1:], F.col("n") < 3).collect()


def test_guard_reads_streams(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    checked = v.guarded(rows, [v.Rule("id", F.col("id") > 9, F.col("id"))], F.col("id") > 1, typed={"twice": F.col("id") * 2})
    checked.writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet").awaitTermination()
    assert sorted(r["twice"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [4, 6, 8, 10]
