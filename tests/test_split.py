import pytest
from pyspark.sql import functions as F

from riskweir.operators import identity, split
from riskweir.plans import modeling
from riskweir.schema import ID, LABEL


def labelled(spark, n0, n1):
    return spark.range(n0 + n1).select(F.concat(F.lit("id-"), F.col("id")).alias(ID), (F.col("id") >= n0).cast("int").alias(LABEL))


def members(df, column="split"):
    return {r[ID]: r[column] for r in df.collect()}


def test_published_class_quotas():
    ranks = split.part_ranks({0: 1433, 1: 1342})
    assert ranks == {0: [1003, 1218], 1: [939, 1140]}


def test_split_is_exact_and_order_free(spark):
    df = labelled(spark, 60, 40)
    parts = split.stratified_split(df)
    sizes = {r["split"]: (r["n"], r["fraud"]) for r in split.split_audit(parts).collect()}
    assert {k: n for k, (n, _) in sizes.items()} == {"train": 70, "validation": 15, "test": 15}
    assert sizes["train"][1] == 28
    assert members(parts) == members(split.stratified_split(df.orderBy(F.rand(3)).repartition(5)))
    assert members(parts) != members(split.stratified_split(df, seed=7))
    assert split.split_overlap(parts).first().asDict() == {
        "n_ids": 100, "train_and_validation": 0, "train_and_test": 0, "validation_and_test": 0, "n_unassigned": 0}


def test_rule_gives_the_same_part_to_a_single_row(spark):
    df = labelled(spark, 50, 50)
    rule = split.fit_split(df)
    whole = members(rule.apply(df))
    one = rule.apply(df.filter(F.col(ID) == "id-17")).first()
    assert whole["id-17"] == one["split"]


def test_rows_with_a_stored_hash_are_split_alike(spark, tmp_path, monkeypatch):
    split.with_hash(labelled(spark, 60, 40), "h").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    whole = members(split.stratified_split(df.drop("h")))
    monkeypatch.setattr(split, "stored_keys", lambda *_: pytest.fail("the keys are stored again"))
    parts = split.stratified_split(df, hashed="h")
    assert members(parts) == whole and "sha2" not in parts._jdf.queryExecution().toString()


@pytest.mark.parametrize("bad, match", [(None, "without an id"), ("  ", "blank id"), ("Null", "blank id"), ("id-3", "sharing an id")])
def test_bad_ids(spark, bad, match):
    df = labelled(spark, 20, 20).withColumn(ID, F.when(F.col(ID) == "id-0", F.lit(bad)).otherwise(F.col(ID)))
    with pytest.raises(ValueError, match=f"must name every row once.*{match}"):
        split.stratified_split(df)


def test_split_needs_ids_and_enough_rows(spark):
    with pytest.raises(ValueError, match="column 'id' is absent"):
        split.stratified_split(labelled(spark, 20, 20).drop(ID))
    with pytest.raises(ValueError, match="Too few rows"):
        split.stratified_split(labelled(spark, 20, 3))


@pytest.mark.parametrize("n0, n1, k", [(11, 7, 5), (100, 33, 4), (9, 9, 3)])
def test_folds_are_balanced(spark, n0, n1, k):
    folds = split.kfold(labelled(spark, n0, n1), k)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == k and max(sizes) - min(sizes) <= 1
    for label in (0, 1):
        per = [r["count"] for r in folds.filter(F.col(LABEL) == label).groupBy("fold").count().collect()]
        assert max(per) - min(per) <= 1


def test_holdout_quota(spark):
    parts = split.holdout_split(labelled(spark, 57, 43))
    assert {r["split"]: r["n"] for r in split.split_audit(parts).collect()} == {"train": 80, "test": 20}


def test_set_fingerprint_ignores_order_and_sees_changes(spark):
    df = labelled(spark, 30, 30)
    base = identity.set_fingerprint(df).first()["fingerprint"]
    assert base == identity.set_fingerprint(df.repartition(7).orderBy(F.rand(1))).first()["fingerprint"]
    assert base != identity.set_fingerprint(df.filter(F.col(ID) != "id-1")).first()["fingerprint"]
    assert base != identity.set_fingerprint(df.unionByName(df.limit(1))).first()["fingerprint"]


def test_folds_and_holdouts_need_ids_that_name_rows(spark):
    df = labelled(spark, 50, 50)
    for broken in (df.withColumn(ID, F.when(F.col(ID) != "id-3", F.col(ID))), df.withColumn(ID, F.lit("same"))):
        with pytest.raises(ValueError, match="must name every row once"):
            split.kfold(broken)
        with pytest.raises(ValueError, match="must name every row once"):
            split.holdout_split(broken)


def test_content_fingerprint_sees_values_and_nulls(spark):
    schema = "id string, x string"
    same = [identity.content_fingerprint(spark.createDataFrame(rows, schema)).first()["fingerprint"] for rows in
            ([("a", "1"), ("b", None)], [("b", None), ("a", "1")], [("a", "1"), ("b", "null")])]
    assert same[0] == same[1] != same[2]


def test_manifest_check(spark):
    df = labelled(spark, 20, 20)
    document = identity.manifest(df, reference="ref")
    assert identity.check_manifest(df, document)["rows"] == 40
    with pytest.raises(ValueError, match=r"rows \(39, 40\).*absent \(1, 0\)"):
        identity.check_manifest(df.filter(F.col(ID) != "id-1"), document, df)
    swapped = df.withColumn(ID, F.when(F.col(ID) == "id-1", "other").otherwise(F.col(ID)))
    assert set(identity.manifest_differences(swapped, document)) == {"members"}
    with pytest.raises(ValueError, match="protocol"):
        identity.check_manifest(df, document | {"protocol": "other"})


def test_alignment(spark):
    df = labelled(spark, 5, 5)
    joined = identity.attach_labels(df.select(ID), df)
    assert joined.count() == 10
    with pytest.raises(ValueError, match="name different rows"):
        identity.attach_labels(df.select(ID), df.unionByName(df.limit(1)))


def test_staged_rows_never_hold_test_ids(spark, parts):
    from conftest import SF
    from riskweir.sources import testbed

    raw = testbed.stored(testbed.merchants_raw(spark, SF), "raw")
    rows, membership = modeling.development_stage(raw)
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "validation"}
    assert members(rows.select(ID, "split")) == members(parts.filter("split <> 'test'").select(ID, "split"))
    assert modeling.test_stage(raw, membership).count() == parts.count()
    with pytest.raises(ValueError, match="isn't the frozen one"):
        modeling.test_stage(raw.filter("ID <> 'order-1'"), membership)
