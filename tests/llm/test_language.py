import math
import zlib
from collections import Counter, defaultdict

import pytest

from riskweir.llm import language
from riskweir.llm.queries import op1_language_id
from helpers import SF


def grams(text, sizes=(1, 2, 3)):
    chars = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in f" {text} ")
    while "  " in chars:
        chars = chars.replace("  ", " ")
    return Counter(chars[i:i + n] for n in sizes for i in range(len(chars) - n + 1))


def test_model_is_naive_bayes_over_hashed_ngrams(spark):
    """With more buckets than n-grams, the posterior is that of plain counting."""
    rows = [("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), ("der Hund und die Katze", "de"), ("the dog", "en")]
    buckets = 1 << 20
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), buckets=buckets)
    counts, n_docs = defaultdict(Counter), Counter(lang for _, lang in rows)
    for text, lang in rows:
        counts[lang] += grams(text)
    query = "die the tapis"
    joint = {lang: math.log(n_docs[lang] / 4) + sum(n * math.log((counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * buckets)) for g, n in grams(query).items()) for lang in counts}
    top = max(joint.values())
    want = {lang: math.exp(j - top) / sum(math.exp(x - top) for x in joint.values()) for lang, j in joint.items()}
    got = language.score(model, [language.ngram_counts(query, model.sizes, buckets)])[0]
    assert dict(zip(model.languages, got)) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("chunk", [7, 64])
def test_chunks_do_not_matter(chunk):
    text = "Über den Wolken, 12 muss die FREIHEIT wohl grenzenlos sein!"
    whole, parts = language.ngram_counts(text, (1, 2, 3), 4096), language.ngram_counts(text, (1, 2, 3), 4096, chunk)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
    assert whole[1].sum() == sum(grams(text).values())


def test_query_on_held_out_documents(spark, table):
    got = {r["doc_id"]: r for r in op1_language_id(spark, SF).collect()}
    assert len(got) == len(table)
    held = [r for r in table if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_rows(spark, odd, empty):
    model = language.fit(odd)
    got = language.predict(odd, model).collect()
    assert len(got) == 12 and model.languages == ("de", "en")  # fr has no text with a letter
    unknown = [r["doc_id"] for r in got if r["lang_pred"] == language.UNKNOWN]
    assert sorted(unknown, key=str) == [1, 2, 3, 9, None] and {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}
    assert language.predict(empty, model).count() == 0
    nothing = language.fit(empty)
    assert nothing.languages == () and {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    rows = spark.createDataFrame([("abcdefghij klm", str(i)) for i in range(40)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.fit(rows, buckets=16)
