import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweir.operators import evaluate, ranking


def numbers(spark, values):
    return spark.createDataFrame([(float(x),) for x in values], "value double")


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_running_totals_on_clustered_values(spark, buckets):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(300, 0.25), 1e-9 + rng.random(300) * 1e-12, rng.random(300)])
    hist = numbers(spark, values).groupBy("value").agg(F.count("*").alias("n"))
    edges = ranking.value_edges(numbers(spark, values), "value", buckets)
    got = {r["value"]: r["cum_n"] for r in ranking.running_totals(hist, [], "value", ["n"], edges, descending=True).collect()}
    for x in np.unique(values):
        assert got[x] == int((values >= x).sum())


def test_buckets_stay_balanced_when_values_cluster(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.random(4000) * 1e-6, rng.random(2000)])
    df = numbers(spark, values)
    sizes = ranking.with_bucket(df, "value", ranking.value_edges(df, "value", 16)).groupBy("_b").count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * len(values) / 16


@pytest.mark.parametrize("size", [1, 2, 5, 100, 1001])
def test_exact_quantiles(spark, size):
    rng = np.random.default_rng(size)
    values = np.round(rng.normal(size=size) * 10, 1)
    weight = rng.integers(0, 2, size)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(values, weight)], "g string, value double, w int")
    hist = df.groupBy("g", "value").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    ps = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {(r["weight"], r["p"]): r["quantile"] for r in ranking.exact_quantiles(
        hist, "g", "value", {"n": ps, "w": [0.5]}, ranking.value_edges(df, "value", 9)).collect()}
    for p in ps:
        assert got["n", p] == pytest.approx(np.quantile(values, p))
    if weight.any():
        assert got["w", 0.5] == pytest.approx(np.median(values[weight == 1]))
    else:
        assert ("w", 0.5) not in got


def test_hash_rank_is_a_permutation_and_stable(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    first = {r["id"]: r["rank"] for r in ranking.hash_rank(ids, "id", 1).collect()}
    assert sorted(first.values()) == list(range(3000))
    assert first == {r["id"]: r["rank"] for r in ranking.hash_rank(ids.repartition(11), "id", 1).collect()}


def brute(y, p, threshold=0.5):
    y, p = np.asarray(y), np.asarray(p)
    ap, seen = 0.0, 0
    for cut in np.unique(p)[::-1]:
        above = p >= cut
        hits = int(y[above].sum())
        ap += (hits - seen) / y.sum() * hits / above.sum()
        seen = hits
    pos, neg = p[y == 1], p[y == 0]
    auc = float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))
    d = (p >= threshold).astype(int)
    tp, fp, fn = int((d & y).sum()), int((d & (1 - y)).sum()), int(((1 - d) & y).sum())
    tn = len(y) - tp - fp - fn
    return {
        "pr_auc": ap, "roc_auc": auc, "accuracy": (tp + tn) / len(y), "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2,
        "precision": tp / (tp + fp) if tp + fp else 0.0, "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn) if tp else 0.0,
    }


@pytest.mark.parametrize("kind", ["ties", "smooth", "cluster", "low"])
def test_metrics_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 700)
    p = {"ties": rng.integers(0, 5, 700) / 4, "smooth": rng.random(700), "cluster": np.where(rng.random(700) < 0.4, 0.5, 1e-7 * rng.random(700)),
         "low": rng.random(700) * 0.3}[kind]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "is_fraud int, score double")
    row = evaluate.metrics(df).first().asDict()
    for name, value in brute(y, p).items():
        assert row[name] == pytest.approx(value, abs=1e-12), name


def test_metrics_with_one_class(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "is_fraud int, score double")
    row = evaluate.metrics(df).first()
    assert row["roc_auc"] is None and row["pr_auc"] == 0.0 and row["balanced_accuracy"] == 0.5


def test_threshold_metrics_agree_with_full_metrics(scored):
    keys = ["model", "feature_configuration", "split"]
    full = {tuple(r[k] for k in keys): r.asDict() for r in evaluate.metrics(scored, keys).collect()}
    for r in evaluate.threshold_metrics(scored, keys).collect():
        for name in ("accuracy", "balanced_accuracy", "precision", "recall", "f1"):
            assert r[name] == pytest.approx(full[tuple(r[k] for k in keys)][name])
