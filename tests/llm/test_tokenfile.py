import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskweir.llm import tokenfile
from riskweir.llm.queries import op6_token_file
from riskweir.session import scratch
from helpers import ODD, SF

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("ends", [[], [0], [1], [5, 5, 5], list(range(1, 2000)), [10**6], [3, 10**6, 10**6 + 1, 10**9], np.cumsum(np.arange(900) % 37).tolist()])
def test_elias_fano(ends):
    low_bits, low, high, samples = tokenfile.elias_fano(np.array(ends, np.int64))
    found = tokenfile.Boundaries(len(ends), low_bits, low, high, samples)
    some = np.arange(0, len(ends), 3)
    assert found.select_many(np.arange(len(ends))).tolist() == ends == [found.select(i) for i in range(len(ends))] and found.select_many(some).tolist() == ends[::3]
    if len(ends) > 500:
        assert 8 * (len(low) + len(high)) <= len(ends) * (3 + max(0, int(ends[-1] // len(ends)).bit_length()))


def test_every_plain_letter_is_split_as_the_library_does():
    letters = [chr(i) for i in range(0x180) if tokenfile.PLAIN.fullmatch(chr(i))]
    texts = [f"a{c}b {c}{c} 1{c}" for c in letters]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenfile.encoder(PATH).encode(texts)] == [ids(x) for x in texts]


@pytest.mark.parametrize("text", ["Don't STOP!! it's 2024, we'll see 'sally", "Straße ÀÉ ſ İ", "日本 😀 x", "a<|endoftext|>b <|startoftext|>", " \t\n", "é ½", "!!'s''t"])
def test_remembered_pieces_give_the_ids_of_the_library(text):
    assert np.frombuffer(tokenfile.encoder(PATH).encode([text])[0], "<u4").tolist() == ids(text)


def test_query_equals_the_library(spark, table):
    start, got = 0, {r["doc_id"]: r for r in op6_token_file(spark, SF).collect()}
    for r in sorted(table, key=lambda r: r["doc_id"]):
        own = np.array([*ids(r["text"]), 1], "<u4")
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert len(got) == len(table)


def test_blocks_and_ids_come_back(spark, docs, table):
    path = scratch(spark, "blocks")
    tokenfile.write(docs, path, PATH, partitions=3, block_bytes=5000)
    assert tokenfile.blocks(spark, path).count() > 20
    got = sorted(tokenfile.read(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in table)
    text = {r["doc_id"]: r["text"] for r in table}
    assert all(r["ids"] == [*ids(text[r["doc_id"]]), 1] for r in got[::17])


def test_wide_ids(spark):
    path = scratch(spark, "wide")
    tokenfile.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path, PATH, end_id=70_000)
    assert spark.read.parquet(path).first()["width"] == 4 and tokenfile.read(spark, path, with_ids=True).first()["ids"][-1] == 70_000


def test_odd_rows(spark, odd, empty):
    path = scratch(spark, "odd")
    tokenfile.write(odd, path, PATH)
    got = tokenfile.read(spark, path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len(ids(t)) + 1) for i, t, *_ in ODD)
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == [None, None, *sorted(i for i, *_ in ODD if i is not None)]
    path = scratch(spark, "none")
    tokenfile.write(empty, path, PATH)
    assert tokenfile.read(spark, path).count() == 0


def test_one_document_by_select(spark, docs):
    """A look-up finds the document's place and ids as a reading of all files does."""
    path = scratch(spark, "select")
    tokenfile.write(docs, path, PATH, block_bytes=2000)
    every = {r["doc_id"]: r for r in tokenfile.read(spark, path, with_ids=True).collect()}
    for doc_id in (0, 17, 199):
        row = tokenfile.document(spark, path, doc_id).first()
        assert (row["start"], row["n_tokens"], row["ids"]) == (every[doc_id]["start"], every[doc_id]["n_tokens"], every[doc_id]["ids"])
    assert tokenfile.document(spark, path, -5).count() == 0
    plan = tokenfile.blocks(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
