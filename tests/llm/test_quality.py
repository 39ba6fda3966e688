import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from riskweir.llm import quality
from riskweir.llm.queries import op9_quality_rules
from helpers import ODD, SF


def brute(text):
    data = (text or "").encode()
    words = data.split()
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in data.split(b"\n") if x.split()]
    return {
        "n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": len(re.findall(rb"[#*$%&|<>]", data)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(spark, table):
    rows = {r["doc_id"]: r for r in op9_quality_rules(spark, SF).collect()}
    assert len(rows) == len(table)
    for r in table:
        got, want = rows[r["doc_id"]], brute(r["text"])
        assert {n: got[n] for n in NAMES} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got["base_failed"] == failed and (not got["kept"] or not failed)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b", "x\n\nx\n \nx y\nx y", "a b c d a b c e a b c", "é\x0bü | <b>"])
def test_counts_of_small_texts(spark, text):
    row = quality.features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {n: row[n] for n in NAMES} == brute(text)


def test_verdict_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op9_quality_rules(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    judged = [(rows[i]["kept"], q) for i, q in labels.items() if not rows[i]["base_failed"]]
    good, bad = [k for k, q in judged if q == 1], [k for k, q in judged if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_model_finds_the_rates_of_a_simulation(spark):
    """Votes drawn from known rates: precise rules get large odds, random ones none."""
    import random

    rng, rows = random.Random(3), []
    for _ in range(4000):
        good = rng.random() < 0.8
        precise = [rng.choices((1, 0, -1), (0.9, 0.09, 0.01) if good else (0.2, 0.1, 0.7))[0] for _ in range(3)]
        rows.append((*precise, rng.choice((1, 0, -1))))
    counts = [(*votes, n) for votes, n in Counter(rows).items()]
    share, odds = quality.fit(spark.createDataFrame(counts, "a int, b int, c int, noise int, n long"), ["a", "b", "c", "noise"])
    assert share == pytest.approx(0.8, abs=0.04)
    assert all(odds[r][-1] < -2.5 and odds[r][1] > 1 for r in "abc") and all(abs(x) < 0.4 for x in odds["noise"].values())


def test_native_plan(spark):
    frame = quality.features(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in ("Python", "Arrow", "Pandas", "Exchange") if p in plan]


def test_odd_rows(spark, odd, empty):
    rows = quality.judge(odd).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_repeat_words"]) for r in rows) == sorted((str(i), brute(t)["n_words"], brute(t)["n_repeat_words"]) for i, t, *_ in ODD)
    assert not [r for r in rows if r["kept"] and r["n_words"] < 50]
    assert quality.judge(empty).count() == 0
