import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskweir.operators import cleaning, daily
from riskweir.schema import FEATURES
from riskweir.session import scratch
from riskweir.sources import readers, testbed, writers
from riskweir.streaming import jobs


def test_csv_keeps_digit_codes(spark, tmp_path):
    (tmp_path / "m.csv").write_text("is_fraud,AreaCode,EAScore\n0,0212,4\n1,,NULL\n")
    got = cleaning.clean_merchants(readers.read_csv(spark, str(tmp_path / "m.csv"))).collect()
    assert got[0]["area_code"] == "0212" and got[1]["area_code"] is None and got[1]["ea_score"] is None


@pytest.mark.parametrize("payload", [[{"ea_score": 1.5, "type": "a"}, {"ea_score": None, "type": "b"}], {"ea_score": 2.0, "type": "c"}])
def test_json_array_or_object(spark, tmp_path, payload):
    (tmp_path / "r.json").write_text(json.dumps(payload, indent=1))
    got = readers.read_records(spark, str(tmp_path / "r.json"))
    assert got.count() == (2 if isinstance(payload, list) else 1)


def test_csv_cells_survive_a_round_trip(spark):
    rows = [('he "x", y', " pad "), ("line\nbreak", "0012"), ("a,b", "\\")]
    path = scratch(spark, "cells")
    writers.write_table(spark.createDataFrame(rows, "a string, b string"), path, "csv")
    got = readers.read_csv(spark, path, multi_line=True)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_doubled_quotes_are_one_cell(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"he ""x"", y",2\n')
    assert tuple(readers.read_csv(spark, str(tmp_path / "q.csv")).first()) == ('he "x", y', "2")


def record(**changes):
    return dict.fromkeys(FEATURES.continuous, 1) | dict.fromkeys(FEATURES.categorical, "a") | changes


@pytest.mark.parametrize("change, match", [
    ({"ea_score": "4d"}, "ea_score:not_numeric"), ({"stray": 1}, "stray"), ({"email_days": ...}, "email_days"), ({"is_valid": 2}, "is_valid:not_binary")])
def test_json_scoring_input_is_refused(spark, tmp_path, change, match):
    cells = {k: x for k, x in record(**change).items() if x is not ...}
    (tmp_path / "r.json").write_text(json.dumps([cells]))
    with pytest.raises((ValueError, PySparkException), match=match):
        cleaning.scoring_frame(readers.read_records(spark, str(tmp_path / "r.json"))).collect()


def test_json_truth_values_and_missing_cells_are_fine(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(record(**c)) for c in ({"is_valid": True, "ea_score": None}, {"is_valid": False, "ea_score": 2.5})))
    got = cleaning.scoring_frame(readers.read_records(spark, str(tmp_path / "r.jsonl"))).orderBy("is_valid").collect()
    assert [(r["is_valid"], r["ea_score"]) for r in got] == [(0.0, 2.5), (1.0, None)]


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="must be a"):
        readers.read_records(spark, "x.xlsx")


def test_daily_csv_round_trip(spark):
    path = scratch(spark, "daily-csv")
    table = spark.createDataFrame([("2020-01-01", 0.123456, 3)], "d string, approval_rate double, applications long").select(
        F.to_date("d").alias("app_day"), "approval_rate", "applications")
    writers.write_table(table, path, "csv", digits=4)
    row = readers.read_daily(spark, path).first()
    assert str(row["app_day"]) == "2020-01-01" and row["approval_rate"] == 0.1235 and row["applications"] == 3.0


def test_outputs_are_not_overwritten(spark):
    path = scratch(spark, "out")
    writers.write_table(spark.range(3).toDF("x"), path)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_table(spark.range(3).toDF("x"), path)
    folder = scratch(spark, "final")
    writers.write_final({"a": spark.range(1), "b": spark.range(2)}, folder)
    with pytest.raises(FileExistsError, match="refusing"):
        writers.write_final({"b": spark.range(5), "c": spark.range(5)}, folder)
    assert not writers.exists(spark, f"{folder}/c")
    writers.write_final({"b": spark.range(5)}, folder, allow_overwrite=True)
    assert spark.read.parquet(f"{folder}/b").count() == 5


def _source(spark, frames, schema):
    path = scratch(spark, "source")
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_latest_over_several_batches(spark):
    rows = spark.range(300).select((F.col("id") % 11).alias("k"), (F.col("id") * 7 % 13).alias("t"), F.col("id").alias("u"))
    frames = [rows.filter(F.col("u") % 3 == i) for i in range(3)]
    out = scratch(spark, "latest")
    jobs.latest_stream(_source(spark, frames, rows.schema), "k", "t", ["u"], f"{out}/t", f"{out}/c").awaitTermination()
    got = {tuple(r) for r in jobs.latest(spark, f"{out}/t", "k", "t", ["u"]).select("k", "t", "u").collect()}
    assert got == {tuple(r) for r in cleaning.latest_record(rows, "k", "t", ("u",)).collect()}


def test_compaction_keeps_the_newest_and_lets_keys_expire(spark):
    rows = spark.range(60).select((F.col("id") % 6).alias("k"), F.col("id").alias("t"))
    out = scratch(spark, "compact")
    frames = [rows.filter(F.col("t") < 30), rows.filter(F.col("t") >= 30)]
    jobs.latest_stream(_source(spark, frames, rows.schema), "k", "t", [], f"{out}/t", f"{out}/c").awaitTermination()
    newest = jobs.latest(spark, f"{out}/t", "k", "t", [])
    want = sorted((r["k"], r["t"]) for r in newest.collect() if r["t"] >= 56)
    jobs.compact(spark, f"{out}/t", newest.filter("t >= 56"))
    assert sorted((r["k"], r["t"]) for r in jobs.latest(spark, f"{out}/t", "k", "t", []).collect()) == want
    assert spark.read.parquet(f"{out}/t").count() == len(want) == 4


def test_late_rows_inside_the_watermark_correct_a_day_and_older_ones_are_dropped(spark):
    def rows(*days):
        return spark.createDataFrame([(d, 1) for d in days], "d string, v int").select(F.to_timestamp("d").alias("ts"), "v")

    frames = [rows("2024-01-01", "2024-01-10"), rows("2024-01-09"), rows("2024-01-20"), rows("2024-01-01", "2024-01-19")]
    out = scratch(spark, "late")
    stream = _source(spark, frames, frames[0].schema)
    jobs.start(jobs.windowed(stream, "ts", [F.sum("v").alias("n")], "3 days"), f"{out}/t", f"{out}/c").awaitTermination()
    got = {str(r["day"]): r["n"] for r in jobs.current(spark, f"{out}/t", ["day"]).collect()}
    assert got["2024-01-09"] == 1 and got["2024-01-10"] == 1 and got["2024-01-19"] == 1
    assert got["2024-01-01"] == 1  # the second row of that day came after the watermark had passed


def test_daily_stream_equals_batch(spark):
    from conftest import SF

    clean = cleaning.clean_applications(testbed.applications_raw(spark, SF), testbed.TIE_BREAK, strict=False)
    path = testbed.store(clean, "clean")
    out = scratch(spark, "daily")
    source = spark.readStream.schema(clean.schema).parquet(path)
    jobs.daily_stream(source, f"{out}/t", f"{out}/c", "4000 days").awaitTermination()
    batch = daily.daily_metrics(spark.read.parquet(path))
    names = batch.columns
    got = {r["app_day"]: r for r in jobs.current(spark, f"{out}/t", ["app_day"]).select(*names).collect()}
    want = batch.collect()
    assert len(got) == len(want)
    for r in want:
        for name in names[1:]:
            assert got[r["app_day"]][name] == (pytest.approx(r[name]) if r[name] is not None else None)
