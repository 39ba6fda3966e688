from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import words
from riskweir.llm import phrases

BREAKS = set(".,;:!?\n\x0b\x0c\r")


def brute(table, longest=4, least=30, keep=2000, cover=80):
    counts, total = defaultdict(Counter), Counter()
    for row in table:
        lang = row["lang"] if row["lang"] is not None else "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"] or "")
        text = "".join("\n" if c in BREAKS else c for c in text)
        for piece in text.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(ws)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if 2 <= len(p) <= longest and a >= least}
        gone = {
            p[i:i + n] for p, b in candidates.items() for n in range(2, len(p)) for i in range(len(p) - n + 1)
            if 100 * b >= cover * f[p[i:i + n]]
        }
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_documents(docs, table):
    assert found(phrases.mine(docs)) == brute(table)
    assert brute(table)


@pytest.mark.parametrize("longest, least, keep, cover", [(2, 3, 5, 80), (3, 2, 50, 100), (5, 4, 2000, 50)])
def test_other_settings(docs, table, longest, least, keep, cover):
    assert found(phrases.mine(docs, longest, least, keep, cover)) == brute(table, longest, least, keep, cover)


def test_many_ranges(docs, table, monkeypatch):
    """A word's phrases lie in several ranges of the sorted streams."""
    monkeypatch.setattr(phrases, "RANGE_ROWS", 40)
    assert found(phrases.mine(docs, least=5)) == brute(table, least=5)


def test_odd_rows(spark, odd, empty):
    rows = [r.asDict() for r in odd.collect()]
    assert found(phrases.mine(odd, least=2)) == brute(rows, least=2)
    assert phrases.mine(empty).count() == 0


def test_ties_pieces_and_overlaps(spark):
    rows = [("a a a a", None), ("x y. x y! x y\tx  y", None), ("É É é é", "fr"), ("b c,b c", "en"), ("B C", "en"), ("d e f\nd e f", "en"), (None, "en"), ("", None)] * 3
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert found(phrases.mine(df, least=3)) == brute([{"text": t, "lang": l} for t, l in rows], least=3)


def test_counts_past_64_bits(spark):
    """2000000 a may pass 64 bits; the cut is computed in decimals."""
    row = spark.createDataFrame([(6_000_000_000_000_000, 1 << 62, 1 << 62)], "f long, p1 long, r long")
    got = row.selectExpr("cast(f as decimal(20,0)) * 2000000 div (cast(p1 as decimal(20,0)) + cast(r as decimal(20,0))) as s").first()["s"]
    assert got == 2000000 * 6_000_000_000_000_000 // (1 << 63)


def test_words_that_share_an_id_get_another_salt(spark, monkeypatch):

    text = (words(50) + " ") * 3
    df = spark.createDataFrame([(text, "en")], "text string, lang string")
    vocabulary = phrases.vocabulary(df)
    assert phrases._salt(vocabulary, 3) == 0
    monkeypatch.setattr(phrases, "named", lambda words_, salt: words_.selectExpr("lang", "word", "f", "7L as id") if salt < 2 else words_.selectExpr("lang", "word", "f", "hash(word) as id"))
    assert phrases._salt(vocabulary, 3) == 2


def test_walk_gives_beginnings_and_extensions():
    rows = [[1, 0, 0, 9], [1, 2, 0, 7], [1, 2, 3, 4], [1, 2, 5, 6], [2, 0, 0, 8], [2, 1, 0, 5]]
    got = {tuple(r[:3]): (before, most) for r, before, most in phrases.walk(iter(rows), 3)}
    assert got == {(1, 0, 0): ([], 7), (1, 2, 0): ([9], 6), (1, 2, 3): ([9, 7], 0), (1, 2, 5): ([9, 7], 0), (2, 0, 0): ([], 5), (2, 1, 0): ([8], 0)}
