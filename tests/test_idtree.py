import random

import pytest
from pyspark.sql import functions as F

from riskweir.operators import idtree
from riskweir.session import scratch


def tree(spark, ids, digits=None):
    return idtree.build(spark.createDataFrame([(i,) for i in ids], "id string").repartition(3), scratch(spark, "tree"), digits=digits)


def found(spark, a, b):
    return sorted(map(tuple, idtree.difference(spark, a, b).collect()), key=repr)


IDS = [f"r{i}" for i in range(3000)]


def test_names_the_ids_that_differ_and_reads_few_others(spark):
    other = [i for i in IDS if i not in ("r7", "r2500")] + ["new", "r9"]
    a, b = tree(spark, IDS, 2), tree(spark, random.Random(1).sample(other, len(other)), 2)
    assert found(spark, a, b) == sorted([("r7", 1, 0), ("r2500", 1, 0), ("new", 0, 1), ("r9", 1, 2)], key=repr)
    ranges = [r["prefix"] for r in idtree.differing(spark, a, b).collect()]
    read = a.ids(spark).filter(F.substring("h", 1, 2).isin(ranges)).count()
    assert len(ranges) <= 4 and read < 0.05 * len(IDS)
    plan = idtree.difference(spark, a, b)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters: [")[1]


def test_equal_sets_in_any_order_read_nothing(spark):
    a, b = tree(spark, IDS[:500], 1), tree(spark, IDS[:500][::-1], 1)
    assert a.root(spark) == b.root(spark) and a.root(spark)[0] == 500
    assert idtree.differing(spark, a, b).count() == 0 and found(spark, a, b) == []


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_any_depth_gives_the_same_difference(spark, digits):
    a, b = tree(spark, IDS[:200], digits), tree(spark, [*IDS[1:200], "x"], digits)
    assert found(spark, a, b) == [("r0", 1, 0), ("x", 0, 1)]


def test_odd_ids(spark):
    """Null ids, blanks, ids that are trimmed, repeated ones, no ids at all."""
    a, b = tree(spark, [None, None, " a ", "b", "b", ""], 1), tree(spark, [None, "a", "b", "null"], 1)
    assert found(spark, a, b) == sorted([(None, 2, 1), ("b", 2, 1), ("", 1, 0), ("null", 0, 1)], key=repr)
    none = tree(spark, [], 1)
    assert none.root(spark) == (0, "") and len(found(spark, none, b)) == 4 and found(spark, none, tree(spark, [], 1)) == []


def test_depth_follows_the_number_of_ids(spark, monkeypatch):
    monkeypatch.setattr(idtree, "RANGE_IDS", 10)
    a = tree(spark, IDS[:1000])
    assert a.digits == 2 and idtree.load(spark, a.path) == a
    sizes = a.nodes(spark).groupBy("level").agg(F.sum("n").alias("n"), F.count("*").alias("nodes")).orderBy("level").collect()
    assert [r["n"] for r in sizes] == [1000] * 3 and sizes[0]["nodes"] == 1 and sizes[1]["nodes"] == 16
    with pytest.raises(ValueError, match="different ranges"):
        idtree.differing(spark, a, tree(spark, ["a"], 1))
