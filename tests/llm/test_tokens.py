import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskweir.llm import tokens
from riskweir.llm.queries import op2_token_counts
from helpers import ODD, SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [
    "a   b  \n\n c", "don't we're I'll 'll they've'", "  ", "\n \n", "x<|endoftext|>y  <|endoftext|><|endoftext|> z", "日本語 テキスト 😀😀 ok", "   x\x1c\x85y",
    "'re'r're 'll", "áé İstanbul 12345 ²³", "!!!!!!!!----------          end", "<|endoftext|", "   \t\t  <|endoftext|>   ", "<|endoftext|>", "",
])
def test_every_prefix_is_counted_as_the_library_does(text):
    got = tokens.counter(PATH).counts(text).tolist()
    assert got == [count(text[:i + 1]) for i in range(len(text))]


def test_small_memory_gives_the_same(monkeypatch, table):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    own = tokens.PrefixCounter(PATH)
    texts = [r["text"][:600] for r in table[:20]]
    assert [int(t[-1]) for t in own.many(texts)] == [count(x) for x in texts]


def test_query_equals_the_library(spark, table):
    got = {r["doc_id"]: r for r in op2_token_counts(spark, SF).collect()}
    assert len(got) == len(table)
    for r in table:
        row = got[r["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"]) == (len(r["text"].encode()), count(r["text"])) and row["over_limit"] == (row["n_tokens"] > 1024)


def test_budget_questions(spark):
    text = "The quick brown fox jumps over the lazy dog. " * 3
    found = tokens.prefix_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH)
    row = found.select(tokens.tokens_of_prefix(9).alias("a"), tokens.chars_within(5).alias("b"), tokens.n_tokens().alias("n"), tokens.tokens_of_prefix(10**6).alias("all"), tokens.tokens_of_prefix(0).alias("none")).first()
    assert (row["a"], row["n"], row["all"], row["none"]) == (count(text[:9]), count(text), count(text), 0)
    assert row["b"] == max(i for i in range(len(text) + 1) if count(text[:i]) <= 5)


def test_odd_rows(spark, odd, empty):
    got = tokens.prefix_counts(odd, PATH).select("doc_id", "n_bytes", tokens.n_tokens().alias("n")).collect()
    assert len(got) == 12 and tokens.prefix_counts(empty, PATH).count() == 0
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n"]) for r in got) == sorted((str(i), len((t or "").encode()), count(t or "")) for i, t, *_ in ODD)
