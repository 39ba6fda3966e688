import math
import random

import pytest
from pyspark.sql import functions as F

from riskweir.operators import drift
from riskweir.session import scratch
from riskweir.streaming import jobs

SCHEMA = "ts timestamp, x double, flat double, gone double, kind string"


def rows(n, seed, move=0.0, holes=0.1):
    rng = random.Random(seed)
    return [(f"2024-01-{1 + k % 20:02d} 10:00:00", None if rng.random() < holes else rng.gauss(move, 1), 3.0, None, rng.choice("aaabbcde") if rng.random() > 0.05 else None) for k in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "ts string, x double, flat double, gone double, kind string").withColumn("ts", F.to_timestamp("ts"))


def brute(base, now, edges):
    """Population stability of one number by hand."""
    def counts(data):
        out = [0] * (len(edges) + 1)
        for v in data:
            if v is not None:
                out[sum(v > e for e in edges)] += 1
        return out

    p, q = counts(now), counts(base)
    p, q = ([(c + 0.5) / (sum(x) + 0.5 * len(x)) for c in x] for x in (p, q))
    return sum((a - b) * math.log(a / b) for a, b in zip(p, q))


def test_numbers_texts_and_missing_rates(spark):
    base, now = rows(800, 1), rows(500, 2, 0.8, 0.3)
    frozen = drift.profile(frame(spark, base), ["x", "flat", "gone"], ["kind"], bins=10, most=3)
    values = sorted(r[1] for r in base if r[1] is not None)
    assert len(frozen.edges["x"]) == 9 and frozen.edges["flat"] == [3.0] and frozen.edges["gone"] == [] and frozen.values["kind"][0] == "a"
    at = 0.5 * (len(values) - 1)
    assert math.isclose(frozen.edges["x"][4], values[int(at)] + (at % 1) * (values[math.ceil(at)] - values[int(at)]), rel_tol=1e-9)
    got = {r["feature"]: r for r in drift.drift(frame(spark, now), frozen, {}).collect()}
    assert math.isclose(got["x"]["psi"], brute([r[1] for r in base], [r[1] for r in now], frozen.edges["x"]), rel_tol=1e-9) and got["x"]["drift"] == "large"
    assert math.isclose(got["x"]["missing_rate"], sum(r[1] is None for r in now) / 500)
    assert math.isclose(got["x"]["missing_shift"], sum(r[1] is None for r in now) / 500 - sum(r[1] is None for r in base) / 800)
    assert got["flat"]["psi"] < 0.01 and got["gone"]["psi"] is None and got["gone"]["missing_rate"] == 1 and got["gone"]["drift"] == "none"


def test_same_rows_do_not_drift_in_any_order(spark):
    data = rows(400, 5)
    df = frame(spark, data)
    frozen = drift.profile(df, ["x"], ["kind"])
    assert frozen == drift.profile(df.repartition(7).orderBy(F.rand(3)), ["x"], ["kind"])
    assert all(r["psi"] == 0 and r["missing_shift"] == 0 and r["drift"] == "none" for r in drift.drift(df, frozen, {}).collect())


def test_new_values_share_the_last_bin(spark):
    base = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4 + [("c",)], "kind string")
    frozen = drift.profile(base, texts=["kind"], most=2)
    assert frozen.values["kind"] == ["a", "b"] and frozen.counts["kind"] == [6, 4, 1, 0]
    now = spark.createDataFrame([("a",), ("new",), ("c",), (None,)], "kind string")
    row = drift.histograms(now, frozen, {}).first()
    assert row["counts"] == [1, 0, 2] and row["missing"] == 1


def test_nan_is_missing_and_ties_go_to_the_smaller_text(spark):
    df = spark.createDataFrame([(float("nan"), "b"), (1.0, "a"), (2.0, "b"), (None, "a")], "x double, kind string")
    frozen = drift.profile(df, ["x"], ["kind"], bins=2, most=1)
    assert frozen.values["kind"] == ["a"] and frozen.counts["x"] == [1, 1, 2]


def test_empty_baseline_and_empty_window(spark):
    df = frame(spark, rows(50, 1))
    none = drift.profile(df.limit(0), ["x"], ["kind"])
    assert none.counts == {"x": [0, 0], "kind": [0, 0]}
    assert all(r["psi"] is None and r["missing_shift"] is None for r in drift.drift(df, none, {}).collect())
    assert drift.drift(df.limit(0), none, {"day": F.to_date("ts")}).count() == 0
    with pytest.raises(ValueError, match="two bins"):
        drift.profile(df, ["x"], bins=1)


def test_profile_is_stored_and_read_back(spark):
    frozen = drift.profile(frame(spark, rows(100, 9)), ["x", "gone"], ["kind"])
    path = scratch(spark, "profile")
    drift.save_profile(spark, frozen, path)
    assert drift.load_profile(spark, path) == frozen


def test_counters_are_summed_before_the_shuffle(spark):
    df = frame(spark, rows(50, 1))
    plan = drift.drift(df, drift.profile(df, ["x"], ["kind"]), {"day": F.to_date("ts")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "Python" not in plan


def test_stream_equals_batch_over_several_runs(spark):
    """Files that come one after the other: counters of a window go on, and the newest version of each is what the batch gives."""
    data = rows(300, 4)
    frozen = drift.profile(frame(spark, data[:100]), ["x"], ["kind"])
    root = scratch(spark, "drift-test")
    for part in (data[:120], data[120:]):
        frame(spark, part).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        jobs.drift_stream(source, frozen, "ts", "7 days", f"{root}/out", f"{root}/check").awaitTermination()
    got = jobs.current(spark, f"{root}/out", ["window_start", "feature"])
    want = drift.drift(frame(spark, data), frozen, {"window": F.window("ts", "7 days")}).select(F.col("window.start").alias("window_start"), "feature", *jobs.DRIFT)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
