import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweir.llm import leakage, sharding, simhash
from riskweir.session import scratch
from helpers import SF


@pytest.fixture(scope="module")
def stages(spark, docs):
    """The rows before and after every stage."""
    out, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{scratch(spark, 'stage')}"
        stage(spark, now, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, now, after))
        now = after
    return out


def test_names_and_columns(stages, docs):
    assert [name for name, *_ in stages] == ["language_id", "simhash_dedup", "decontamination", "mixing", "sharding"]
    for _, _, after in stages[:-1]:
        assert after.columns == docs.columns


def test_language_stage_keeps_clean_documents(stages):
    _, before, after = stages[0]
    assert after.count() >= 0.97 * before.filter(F.col("text").rlike(r"\p{L}")).count()


def test_one_document_of_each_class_stays(stages):
    _, before, after = stages[1]
    names = {r["component_id"] for r in simhash.classes(before).collect()}
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(names)


def test_no_benchmark_item_is_left(spark, stages):
    _, before, after = stages[2]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    gone = {r["doc_id"] for r in leakage.matches(before, items).collect()}
    assert leakage.matches(after, items).count() == 0
    assert {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in after.select("doc_id").collect()} == gone


def test_mix_takes_the_words_of_its_input(stages):
    _, before, after = stages[3]

    def words(df):
        return df.select(F.sum(F.size(F.array_remove(F.split("text", r"\s+"), "")))).first()[0]

    assert abs(words(after) - words(before)) <= 0.25 * words(before)
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_shards_take_every_row(stages):
    _, before, after = stages[4]
    sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert sum(sizes) == before.count() and max(sizes) - min(sizes) <= 1
    assert sharding.assign(before).count() == after.count()


def test_run_repeats(spark, stages):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "shard", "slot").collect()))
    assert first == sorted(map(tuple, stages[-1][2].select("doc_id", "shard", "slot").collect()))


def test_columns_named_like_the_stages_own(spark, docs):
    """Rows keep columns that are called like those that a stage adds inside."""
    names = ("lang_pred", "score", "row", "fp", "same", "first", "own", "size", "item.id")
    plain = {r["doc_id"] for r in docs.limit(60).collect()}
    clash = docs.filter(F.col("doc_id").isin(*plain)).withColumns({c: F.lit("clash") for c in names})
    for _, stage in corpus_pipeline.STAGES[:2]:
        after = stage(spark, clash, SF)
        assert after.columns == clash.columns
        assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in stage(spark, docs.filter(F.col("doc_id").isin(*plain)), SF).collect()}


def test_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.known_language(spark, plain, SF)
    assert {r["doc_id"] for r in kept.collect()} >= {4, 7, 10, None} and not kept.filter("doc_id in (1, 2, 3, 9)").count()
    single = corpus_pipeline.one_of_each(spark, plain, SF)
    assert single.filter("doc_id = 7").count() == 1 and not single.filter("doc_id = 10").count() and single.filter("doc_id is null").count() == 1
    assert single.filter("doc_id in (1, 2, 3)").count() == 1
