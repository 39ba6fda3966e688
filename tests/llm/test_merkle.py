from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from riskweir.llm import merkle
from riskweir.llm.queries import op12_merkle_manifest
from helpers import SF


def digest(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def proof(row, at):
    """Siblings of each level, bottom up, and the digest above."""
    out = []
    while len(row) > 1:
        run = at // 8 * 8
        out.append((row[run:at], row[at + 1:run + 8]))
        row, at = [digest("".join(row[i:i + 8])) for i in range(0, len(row), 8)], at // 8
    return out, row[0]


def brute(table):
    leaf = lambda r, text: digest("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    trees = {}
    for r in table:
        other = leaf(r, lower(r["text"])) if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 0 else None
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), other))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    subroots = [proof([x[2] for x in trees[n]], 0)[1] for n in names]
    out = []
    for i, name in enumerate(names):
        upper, root = proof(subroots, i)
        for at, (named, doc_id, own, other) in enumerate(trees[name]):
            steps = proof([x[2] for x in trees[name]], at)[0] + upper
            folded = other or own
            for before, after in steps:
                folded = digest("".join([*before, folded, *after]))
            out.append((doc_id if named else None, own, subroots[i], root, digest("".join("".join(b + a) for b, a in steps)), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def test_documents(spark, table):
    got = found(op12_merkle_manifest(spark, SF))
    assert got == brute(table)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 130])
def test_sizes_of_one_tree(spark, n):
    rows = [(i, f"T{i}", "en", "a", i) for i in range(n)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert found(merkle.manifest(spark.createDataFrame(rows, schema).repartition(3), tampered())) == want


def test_many_languages_and_lone_leaves(spark):
    rows = [(i, "t", f"l{i % 70:02d}" if i % 71 else None, None, None) for i in range(90)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert found(merkle.manifest(spark.createDataFrame(rows, schema), tampered())) == want


def test_odd_rows(odd, empty):
    """Null ids come first, rows of one id by digest, identical rows side by side."""
    rows = [r.asDict() for r in odd.collect()]
    got = found(merkle.manifest(odd, tampered()))
    # Identical rows are interchangeable: the same proofs, whichever has which place.
    assert got == brute(rows)
    assert merkle.manifest(empty, tampered()).count() == 0


def test_ranges_of_ids(spark, monkeypatch):
    """Small ranges, one id with a third of all rows, null ids, and ids that doubles can't tell apart."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    ids = [5] * 40 + [None] * 15 + list(range(60)) + [(1 << 60) + k for k in range(20)] + [-3, -3]
    rows = [(i, f"Text {k}", "en" if k % 3 else "de", "a", k) for k, i in enumerate(ids)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert found(merkle.manifest(spark.createDataFrame(rows, schema).repartition(5), tampered())) == want


def test_siblings_are_the_rest_of_the_parents_interval(spark):
    leaves = spark.createDataFrame([("t", i, f"h{i}") for i in range(20)], "tree string, at long, h string")
    stored = merkle.levels(leaves)
    assert [[(r["lo"], r["hi"]) for r in level.orderBy("lo").collect()] for level in stored] == [[(0, 8), (8, 16), (16, 20)], [(0, 20)]]
    above = merkle.tops(stored).select("tree", F.array().cast(merkle.STEPS).alias("steps"))
    steps = {r["at"]: r["steps"] for r in merkle.leaf_paths(leaves, stored, above).collect()}
    assert [tuple(s) for s in steps[17]][0] == ("h16", "h18h19")
    assert len(steps[17]) == 2 and not steps[17][1]["after"]
