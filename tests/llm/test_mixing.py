from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskweir.llm import mixing
from riskweir.llm.queries import op8_mixing
from helpers import ODD, SF


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, again and again, until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        target = {s: cap * sizes[s] for s in capped} | {s: left * weight[s] / total for s in open_}
        above = {s for s in open_ if target[s] > cap * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 2, None: 30}, {"a": 0, "b": 10}, {None: 7}, {"é": 3, "z": 900, "A": 1, "": 4}, {"a": 0}])
def test_targets(spark, sizes):
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in found} == pytest.approx(brute_targets(sizes))


def check(rows, cap=3):
    taken, size, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= cap * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for source in size:
        assert abs(taken[source] - target[source]) <= largest[source] + 1e-6, source
    return size, target


def test_sources_come_within_a_document_of_their_target(spark, docs, table):
    rows = mixing.mix(docs).collect()
    size, target = check(rows)
    want = Counter()
    for r in table:
        want[r["source"]] += len(r["text"].encode().split())
    assert size == want and target == pytest.approx(brute_targets(want)) and len(rows) == len(table)
    assert sum(target.values()) == pytest.approx(sum(want.values()))


def test_a_tree_of_many_levels(spark):
    """A hot source whose units need several levels."""
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") * 7919 % 40).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    rows = mixing.mix(df).collect()
    check(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(11)).collect()))


def test_rounding_keeps_expectations(spark):
    """Over many seeds a unit is taken as often as its fraction says."""
    units = spark.createDataFrame([("a", 5, i, i, s, 1, x) for i, (s, x) in enumerate([(10, 0.3), (40, 0.3), (5, 0.3), (25, 0.3), (20, 0.3)])], "source string, n long, h long, doc_id long, size long, copies long, x double")
    hits, runs = defaultdict(int), 60
    for seed in range(runs):
        rows = mixing.round_units(units, 5, seed, fan_in=3).collect()
        assert abs(sum(r["x"] * r["size"] for r in rows) - 30) <= 40 and {r["x"] for r in rows} <= {0.0, 1.0} and len(rows) == 5
        for r in rows:
            hits[r["doc_id"]] += r["x"]
    assert all(0.08 <= hits[i] / runs <= 0.55 for i in range(5))


def test_native_plan(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop") if p in plan]


def test_query_columns(spark):
    assert op8_mixing(spark, SF).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_odd_rows(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert Counter(str(r["doc_id"]) for r in rows) == Counter(str(i) for i, *_ in ODD)
    assert {r["doc_id"]: r["size"] for r in rows if r["doc_id"]} == {i: len((t or "").encode().split()) for i, t, *_ in ODD if i}
    assert len({r["taken"] for r in rows if r["doc_id"] == 7}) == 1  # repeated rows share their draw
    assert mixing.mix(empty).count() == 0
    mixed = mixing.taken(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    """Sixty texts of one size and no id: their source comes within one of them of its target, not within all of them."""
    rows = [(None, " ".join(f"w{i}x{k}" for k in range(100)), "a") for i in range(60)] + [(1000 + i, " ".join(["v"] * 50), "b") for i in range(75)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check(mixing.mix(df).collect())
    assert mixing.taken(df).count() == sum(r["copies"] for r in mixing.mix(df).collect())


def test_very_many_equal_rows_come_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 7)
    df = spark.range(100).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(df).collect()
    assert len(rows) == 100 and {r["copies"] for r in rows} == {1}
