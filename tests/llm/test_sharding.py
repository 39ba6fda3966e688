import hashlib
import zlib
from collections import Counter

import pytest

from riskweir.llm import sharding
from riskweir.llm.queries import op3_sharding
from helpers import SF


def md5(*parts):
    return hashlib.md5(":".join(parts).encode()).hexdigest()


def brute(rows, n_shards, seed="shards"):
    """One sort per source, then one sort of everything."""
    line = []
    for source in {r["source"] for r in rows}:
        own = sorted((md5(seed, str(r["doc_id"])), r["doc_id"]) for r in rows if r["source"] == source)
        start = (int(md5(seed, "start", source or "")[:8], 16) + 0.5) / float(1 << 32)
        line += [((rank + start) / len(own), source is None, source, rank, doc) for rank, (_, doc) in enumerate(own)]
    return {x[-1]: p * n_shards // len(rows) for p, x in enumerate(sorted(line))}


@pytest.mark.parametrize("rows_per_bucket", [10_000, 7])
def test_equals_plain_sorting(spark, docs, table, rows_per_bucket):
    got = sharding.assign(docs, 24, rows_per_bucket=rows_per_bucket).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == brute(table, 24)


def test_query_digests_and_law(spark, table):
    got = op3_sharding(spark, SF).collect()
    by_id = {r["doc_id"]: r for r in table}
    for r in got:
        data = by_id[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_every_shard_has_the_mixture(spark):
    """A source with half of all rows, some equal ones, and many of one row."""
    rows = [(i, "t", "hot") for i in range(1200)] + [(2000 + i, "t", f"s{i % 4}") for i in range(600)] + [(5000 + i, "t", f"one{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kinds = Counter()
    for r in sharding.assign(df, 24, rows_per_bucket=50).collect():
        kinds[r["shard"], r["source"] if not r["source"].startswith("one") else "one"] += 1
    assert all(abs(kinds[s, "hot"] - 50) <= 12 for s in range(24)) and all(kinds[s, "one"] > 5 for s in range(24))
    assert all(kinds[s, f"s{k}"] > 2 for s in range(24) for k in range(4))


def test_odd_rows(spark, odd, empty):
    got = sharding.assign(odd, 5).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [2, 2, 2, 3, 3] and len(got) == 12
    assert sharding.assign(empty, 5).count() == 0
    assert sum(r["size"] == 8 for r in got) == 3
    assert sorted(map(str, got)) == sorted(map(str, sharding.assign(odd.repartition(7), 5).collect()))
    with pytest.raises(ValueError, match="at least 1"):
        sharding.assign(odd, 0)
