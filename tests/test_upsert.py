"""The keyed table: restarts, readers beside a running stream, and what a batch touches."""
import pytest
from pyspark.sql import functions as F

from riskweir.session import scratch
from riskweir.streaming.upsert import BUCKET, KeyedTable

SCHEMA = "k long, at int, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def newest(*batches):
    best = {}
    for k, at, v in (r for b in batches for r in b):
        best[k] = max(best.get(k, (at, v)), (at, v))
    return sorted((k, at, v) for k, (at, v) in best.items())


@pytest.fixture
def table(spark):
    return KeyedTable(scratch(spark, "keyed"), ("k",), ("at",), 8)


def test_newest_row_of_each_key_over_batches(spark, table):
    a = [(k, 1, "a") for k in range(50)]
    b = [(k, 2, "b") for k in range(0, 50, 7)] + [(100, 1, "new")]
    c = [(0, 1, "late"), (7, 2, "z"), (7, 2, "c")]  # older, and ties that the whole row decides
    for i, batch in enumerate((a, b, c)):
        table.upsert(frame(spark, batch).repartition(3), i)
        assert rows_of(table.read(spark, SCHEMA)) == newest(*(a, b, c)[:i + 1])
    assert table.versions(spark) == [0, 1, 2]
    assert rows_of(table.read(spark, SCHEMA, 0)) == newest(a)


def test_a_batch_rewrites_the_buckets_of_its_keys_alone(spark, table):
    table.upsert(frame(spark, [(k, 1, "a") for k in range(200)]), 0)
    before = table.places(spark)
    table.upsert(frame(spark, [(3, 2, "b")]), 1)
    after = table.places(spark)
    own = frame(spark, [(3, 0, "")]).select(table.bucket().alias("b")).first()["b"]
    assert {b for b in after if after[b] != before[b]} == {own} and len(before) == 8
    written = spark.read.option("basePath", f"{table.path}/batch=1").parquet(f"{table.path}/batch=1")
    assert {r[BUCKET] for r in written.select(BUCKET).distinct().collect()} == {own}


def test_a_reader_keeps_its_version_while_the_stream_goes_on(spark, table):
    table.upsert(frame(spark, [(1, 1, "a"), (2, 1, "a")]), 0)
    held = table.read(spark, SCHEMA)
    table.upsert(frame(spark, [(1, 2, "b"), (3, 1, "b")]), 1)
    assert rows_of(held) == [(1, 1, "a"), (2, 1, "a")] and rows_of(table.read(spark, SCHEMA)) == [(1, 2, "b"), (2, 1, "a"), (3, 1, "b")]


def test_a_batch_that_was_broken_off_is_done_again(spark, table, monkeypatch):
    table.upsert(frame(spark, [(1, 1, "a"), (2, 1, "a")]), 0)

    def broken(self, *_):
        raise OSError("lost")

    monkeypatch.setattr(KeyedTable, "_publish", broken)
    with pytest.raises(OSError):
        table.upsert(frame(spark, [(1, 9, "half")]), 1)
    monkeypatch.undo()
    assert rows_of(table.read(spark, SCHEMA)) == [(1, 1, "a"), (2, 1, "a")]  # its folder is there, but no version names it
    table.upsert(frame(spark, [(1, 9, "whole")]), 1)
    table.upsert(frame(spark, [(1, 9, "whole")]), 1)  # and once more, after it was published
    assert rows_of(table.read(spark, SCHEMA)) == [(1, 9, "whole"), (2, 1, "a")]


def test_vacuum_leaves_what_the_last_versions_need(spark, table):
    batches = [[(k, i, str(i)) for k in range(i, 40, i + 1)] for i in range(5)]
    for i, batch in enumerate(batches):
        table.upsert(frame(spark, batch), i)
    assert table.vacuum(spark, keep=2) > 0 and table.versions(spark) == [3, 4]
    assert rows_of(table.read(spark, SCHEMA)) == newest(*batches) and rows_of(table.read(spark, SCHEMA, 3)) == newest(*batches[:4])
    table.upsert(frame(spark, [(0, 99, "z")]), 5)
    assert rows_of(table.read(spark, SCHEMA)) == newest(*batches, [(0, 99, "z")])
    with pytest.raises(ValueError, match="stays"):
        table.vacuum(spark, 0)


def test_lookup_reads_the_buckets_of_the_wanted_keys(spark, table):
    table.upsert(frame(spark, [(k, 1, "a") for k in range(100)]), 0)
    got = table.lookup(spark, SCHEMA, spark.createDataFrame([(5,), (5,), (77,), (-1,)], "k long"))
    assert rows_of(got) == [(5, 1, "a"), (77, 1, "a")]
    assert len(got.inputFiles()) <= 3


def test_nothing_and_null_keys(spark, table):
    assert table.read(spark, SCHEMA).count() == 0 and table.versions(spark) == []
    table.upsert(frame(spark, []), 0)
    assert table.versions(spark) == []
    table.upsert(frame(spark, [(None, 1, "a"), (None, 2, None), (None, None, "c")]), 1)
    assert rows_of(table.read(spark, SCHEMA)) == [(None, 2, None)]


def test_a_stream_over_two_runs(spark, table):
    root = scratch(spark, "keyed-in")
    parts = [[(k, 1, "a") for k in range(30)], [(k, 2, "b") for k in range(10, 40)]]
    for part in parts:
        frame(spark, part).write.mode("append").parquet(root)
        table.start(spark.readStream.schema(SCHEMA).parquet(root), f"{table.path}-check").awaitTermination()
    assert rows_of(table.read(spark, SCHEMA)) == newest(*parts)
    assert table.read(spark, SCHEMA).select(F.count_distinct("k")).first()[0] == 40
