from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskweir.llm import simhash
from riskweir.llm.queries import op5_simhash_dedup
from helpers import ODD, SF


def brute(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(prints, radius=2):
    """Component names by comparing all pairs."""
    ids, name = list(prints), {}
    for i in ids:
        if i in name:
            continue
        todo, group = [i], {i}
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in group and (prints[x] ^ prints[y]).bit_count() <= radius:
                    group.add(y)
                    todo.append(y)
        name |= dict.fromkeys(group, min(group))
    return name


def test_fingerprints_and_classes_equal_brute_force(spark, table):
    got = {r["doc_id"]: r for r in op5_simhash_dedup(spark, SF).collect()}
    prints = {r["doc_id"]: brute(r["text"]) for r in table}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints and all(len(r["fingerprint"]) == 16 for r in got.values())
    assert {i: r["component_id"] for i, r in got.items()} == closure(prints)


@pytest.mark.parametrize("radius, values", [(0, 1), (1, 65), (2, 2081)])
def test_ball(spark, radius, values):
    ball = spark.range(1).select(simhash.ball(F.lit(-5).cast("long"), radius).alias("b")).first()["b"]
    assert len(set(ball)) == values and max((((x & (1 << 64) - 1) ^ (-5 & (1 << 64) - 1)).bit_count()) for x in ball) == radius


@pytest.mark.parametrize("radius", [2, 4])
def test_links_reach_whatever_is_within_the_radius(spark, radius):
    import random

    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(40):
        prints.append(prints[rng.randrange(len(prints))] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1))))
    signed = {x - (1 << 64) if x >> 63 else x for x in prints}
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius))
    got = {r["node"]: r["root"] for r in found.collect()}
    want = closure({x: x & (1 << 64) - 1 for x in signed}, radius)
    assert {x: got.get(x, x) for x in signed} == want
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_long_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(300)]
    star = [(1000 + i, 999) for i in range(1, 400)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[x] for x, _ in star} == {999} and len(got) == 301 + 400


def test_odd_rows(spark, odd, empty):
    got = simhash.classes(odd).collect()
    assert len(got) == 12 and simhash.classes(empty).count() == 0
    names = Counter((r["component_id"], r["doc_id"]) for r in got)
    assert names[7, 7] == 2 and names[7, 10] == 1  # repeated rows and equal texts
    assert names[1, 1] == names[1, 2] == names[1, 3] == names[1, None] == 1  # no words: fingerprint zero
    assert {r["fp"] & (1 << 64) - 1 for r in got} == {brute(t) for _, t, *_ in ODD}


def test_many_equal_texts(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text that all of these share").otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = simhash.classes(df).filter("component_id = 0").count()
    assert got >= 1000


def test_one_row_of_each_component_stays(spark):
    """Against all pairs: copies, near copies, rows without an id, rows of one id with other texts, and equal rows."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        text = [f"w{rng.integers(500)}" for _ in range(150)]
        near = [*text[:-1], "end"]
        rows += [(3 * i, " ".join(text), "en"), (3 * i + 1, " ".join(near), "en"), (3 * i + 2, " ".join(text).upper(), "de")]
    rows += [(None, rows[0][1], "en"), (None, "only here and without an id", "en"), (500, "a text of its own", "en"), (500, "another text of the same id", "en"), (500, "another text of the same id", "en"), (501, None, None), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = closure({i: brute(t) for i, (_, t, _) in enumerate(rows)}, 2)
    groups = {}
    for i, (doc_id, text, _) in enumerate(rows):
        groups.setdefault(want[i], []).append((doc_id is None, doc_id or 0))
    for parts in (2, 5):
        got = simhash.one_of_each(df.repartition(parts)).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(min(g) for g in groups.values())
    assert simhash.one_of_each(df.limit(0)).count() == 0
