import numpy as np
import pyarrow as pa
import pytest

from riskweir.llm import common


def column(*texts):
    return pa.array(texts, pa.string())


def test_words_are_those_of_plain_splitting(table):
    texts = [r["text"] for r in table] + ["", None, " \t", "Ä b C\x0bd", "x" * 5000]
    hashes, begins, first = common.hash_words(*common.raw(column(*texts)))
    seen, back, k = {}, {}, 0
    for text, a, b in zip(texts, first, first[1:]):
        words = (text or "").encode().lower().split()
        assert b - a == len(words)
        for word in words:
            assert seen.setdefault(word, hashes[k]) == hashes[k] and back.setdefault(int(hashes[k]), word) == word
            k += 1
    assert k == len(hashes) == len(begins)


def test_chunks_do_not_matter(monkeypatch):
    texts = column("one two THREE", None, "y" * 200 + " one " + "z" * 90, "three", "y" * 200)
    whole = common.hash_words(*common.raw(texts))[0]
    assert whole[2] == whole[6] and whole[0] == whole[4] and whole[3] == whole[7]
    common._tables.cache_clear()
    monkeypatch.setattr(common, "CHUNK", 64)
    parts = common.hash_words(*common.raw(texts))[0]
    common._tables.cache_clear()
    assert [list(whole).index(x) for x in whole] == [list(parts).index(x) for x in parts]


def test_kgrams_stay_within_rows():
    words, first = np.array([1, 2, 3, 1, 2, 3, 9], np.uint64), np.array([0, 3, 3, 7])
    hashes, inside = common.kgrams(words, first, 3)
    assert inside.tolist() == [True, False, False, True, True] and hashes[0] == hashes[3] != hashes[4]


@pytest.mark.parametrize("rows", [1 << 30, 2])
def test_pieces_cover_a_batch_once(rows):
    batch = pa.record_batch({"text": column("a" * 10, None, "b" * 100, "", "c")})
    parts = list(common.pieces(batch, 20, rows=rows))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows <= rows for p in parts)
    sliced = parts[-1].column("text")
    assert common.raw(sliced)[1][0] == 0
