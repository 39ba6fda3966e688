import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from riskweir.llm import leakage
from riskweir.llm.queries import op10_decontamination
from helpers import SF


def brute(doc, item, k):
    """Greedy string tiling by comparing every place with every place."""
    doc_marks, item_marks, tiles = set(), set(), []
    while True:
        best = (0,)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in item_marks and j + n not in doc_marks:
                    n += 1
                best = max(best, (n, -i, -j))
        n = best[0]
        if n < k:
            return tiles
        i, j = -best[1], -best[2]
        item_marks |= set(range(i, i + n))
        doc_marks |= set(range(j, j + n))
        tiles.append((j, i, n))


def windows(doc, item, k):
    found = [(j, i) for j in range(len(doc) - k + 1) for i in range(len(item) - k + 1) if doc[j:j + k] == item[i:i + k]]
    return np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)


@pytest.mark.parametrize("k", [2, 3])
def test_tiles_equal_brute_force(k):
    rng = random.Random(k)
    for _ in range(150):
        doc, item = [rng.randrange(4) for _ in range(rng.randint(k, 25))], [rng.randrange(4) for _ in range(rng.randint(k, 12))]
        doc_at, item_at = windows(doc, item, k)
        if len(doc_at):
            got, want = leakage.tile(doc_at, item_at, k, len(item)), brute(doc, item, k)
            assert [t[2] for t in got[:1]] == [t[2] for t in want[:1]]
            assert sum(t[2] for t in got) == sum(t[2] for t in want)


def frames(spark, texts, items):
    return (spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def test_reordered_and_changed_passages(spark):
    half = ITEM.split()
    texts = [f"before {ITEM} after", " ".join(half[8:] + ["x"] + half[:8]), ITEM.upper(), " ".join(half[:8]), "nothing of it", " ".join(w for x in half for w in (x, "y")), None, ""]
    got = {r["doc_id"]: r for r in leakage.matches(*frames(spark, texts, [ITEM])).collect()}
    assert set(got) == {0, 1, 2} and got[1]["n_tiles"] == 2 and got[1]["coverage"] == 1.0 and got[0]["first_word"] == 1
    kept = leakage.without(*frames(spark, texts, [ITEM])).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 4, 5, 6, 7]


def test_short_and_empty_items(spark):
    docs, items = frames(spark, ["say hello world again", "hello", "world hello"], ["Hello world", "", None, "  ", "again"])
    got = {(r["doc_id"], r["item_id"]) for r in leakage.matches(docs, items).collect()}
    assert got == {(0, 0), (0, 4)}
    assert leakage.matches(docs, items.limit(0)).count() == 0 and leakage.matches(docs.limit(0), items).count() == 0
    assert leakage.without(docs, items.limit(0)).count() == 3


def test_blocks_find_the_same(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, leakage.matches(docs, items).collect()))
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 3000)
    blocks = list(leakage.blocks(items, 5, 3000))
    assert len(blocks) > 1 and sum(len(b.item_ids) for b in blocks) == items.count()


def test_query_finds_the_planted_items(spark, table):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    got = {(r["doc_id"], r["item_id"]) for r in op10_decontamination(spark, SF).collect()}
    flat = {r["doc_id"]: " " + " ".join(r["text"].lower().split()) + " " for r in table}
    planted = {(d, i["item_id"]) for i in items for d, t in flat.items() if " ".join(i["text"].lower().split()[1:-1]) in t}
    assert planted <= got
    for d, i in got - planted:  # others are nearly whole as well
        words = next(x["text"] for x in items if x["item_id"] == i).lower().split()
        assert sum(w in flat[d].split() for w in words) >= 0.6 * len(words)


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "The same row twice. The same row twice."), (1, "w10 w11 w12 w13 w14 w15")], "item_id long, text string").withColumnRenamed("item_id", "item_id")
    rows = leakage.matches(odd, items).collect()
    assert sorted(r["doc_id"] for r in rows) == [4, 7, 7, 10]
    assert leakage.without(odd, items).count() == 8 and leakage.without(odd, items).columns == odd.columns


@pytest.mark.parametrize("seed", range(12))
def test_tiles_by_length_are_the_listed_ones(seed):
    """Texts of few different words, so that windows repeat, tiles overlap and lengths tie."""
    rng = np.random.default_rng(seed)
    doc, item = rng.integers(1, 3 + seed % 3, 120).astype(np.uint64), rng.integers(1, 3 + seed % 3, 30).astype(np.uint64)
    k = 3 + seed % 3
    pairs = [(d, i) for d in range(len(doc) - k + 1) for i in range(len(item) - k + 1) if (doc[d:d + k] == item[i:i + k]).all()]
    if pairs:
        want = leakage.tile(np.array([d for d, _ in pairs]), np.array([i for _, i in pairs]), k, len(item))
        assert sorted(leakage.tile_by_length(doc, item, k)) == sorted(want)


def test_long_repetitive_texts(spark, monkeypatch):
    """Memory follows the length of the text, and a low limit of listed pairs gives the same rows."""
    import tracemalloc

    spam = "spam " * 300
    items = spark.createDataFrame([(1, spam), (2, "a b c d e f g h"), (3, "spam " * 6 + "eggs " * 6)], "item_id long, text string")
    own = next(leakage.blocks(items, 5))
    peaks = []
    for n in (50_000, 100_000):
        tracemalloc.start()
        found = leakage.search(own, pa.array([spam * (n // 300)]), 0.6)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert [own.item_ids[i].as_py() for _, i, _ in found] == [1]
    assert peaks[1] < 2.5 * peaks[0] < 2.5 * 60e6
    docs = spark.createDataFrame([(1, spam * 3), (2, "eggs " * 9 + "spam " * 8), (3, "x a b c d e y d e f g h"), (4, "spam eggs " * 50)], "doc_id long, text string")
    want = sorted(map(tuple, leakage.matches(docs, items).collect()))
    monkeypatch.setattr(leakage, "LISTED", 0)
    got = [(r, own.item_ids[i].as_py(), sum(t[2] for t in tiles)) for r, i, tiles in leakage.search(own, pa.array([x["text"] for x in docs.orderBy("doc_id").collect()]), 0.6)]
    assert sorted((r + 1, i, n) for r, i, n in got) == [(w[0], w[1], w[3]) for w in want] and want
