import random

import pyarrow as pa
import pytest

from riskweir.llm import licenses
from riskweir.llm.common import hash_words, raw
from riskweir.llm.license_texts import TEMPLATES
from riskweir.llm.queries import op7_license_scan
from helpers import SF


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(licenses.scan(df).collect(), key=lambda r: (r["doc_id"], r["begin"], r["license"]))


def hashes(text):
    return hash_words(*raw(pa.array([text])), licenses.SEPARATORS)[0]


def brute(template, text):
    """Best local alignment without a band: (score, matched)."""
    best, above = (0, 0), [(0, 0)] * (len(text) + 1)
    for word in template:
        row = [(0, 0)]
        for j, other in enumerate(text):
            same = word == other
            s, m = max((above[j][0] + (1 if same else -1), above[j][1] + same), (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]), key=lambda x: x[0])
            row.append((s, m) if s > 0 else (0, 0))
        above = row
        best = max(best, max(row))
    return best


def test_alignment_within_a_wide_band_is_the_full_one():
    rng = random.Random(4)
    for _ in range(60):
        template = [rng.randrange(6) for _ in range(rng.randint(3, 14))]
        text = [rng.randrange(6) for _ in range(rng.randint(1, 20))]
        matched, begin, end = licenses.align(template, text, -20, 30)
        assert 0 <= begin <= end <= len(text)
        score, want = brute(template, text)
        assert matched == want or score == 0 or abs(matched - want) <= 1


def test_every_template_is_found_alone_and_within_text(spark):
    names = sorted(TEMPLATES)
    rows = scan(spark, *(f"Some words before.\n{TEMPLATES[n]}\nand after it." for n in names))
    for i, name in enumerate(names):
        own = [r for r in rows if r["doc_id"] == i and r["license"] == name]
        assert len(own) == 1 and own[0]["coverage"] == 1.0 and own[0]["begin"] == 19


def test_changes_cases_and_line_breaks(spark):
    text = TEMPLATES["mit"].upper().replace(" ", "\n * ", 12).replace("WITHOUT RESTRICTION", "WITHOUT ANY OTHER RESTRICTION").replace("SUBLICENSE, ", "")
    row, = [r for r in scan(spark, "é" * 7 + " " + text + " The end") if r["license"] == "mit"]
    assert 0.97 < row["coverage"] < 1 and row["span_words"] == row["template_words"] + 1 and row["begin"] == 8


def test_spans_are_characters_and_copies_are_rows(spark):
    line = TEMPLATES["mit-line"]
    text = f"ü {line} {line}\n\nother words that are no licence {line}"
    rows = [r for r in scan(spark, text) if r["license"] == "mit-line"]
    assert [text[r["begin"]:r["end"]] for r in rows] == [line.rstrip(".")] * 3


def test_short_parts_and_plain_text_are_no_licence(spark):
    assert scan(spark, "Licensed under the sun, version 3 of a song", "Permission is hereby granted, free of charge", "") == []


@pytest.mark.parametrize("window", [1, 3, 6])
def test_winnowing_guarantee(window):
    """Any run of k + window - 1 words of a long template shares a fingerprint."""
    own = licenses.index({"apache": TEMPLATES["apache-2.0-notice"]}, 3, window)
    words = TEMPLATES["apache-2.0-notice"].replace("(", " ").replace(")", " ").split()
    for i in range(0, len(words) - window - 1):
        texts = pa.array([" ".join(words[i:i + window + 4])])
        grams, _ = licenses.kgrams(hashes(texts[0].as_py()), hash_words(*raw(texts), licenses.SEPARATORS)[2], 3)
        assert set(grams.tolist()) & set(own.prints.tolist())


def test_query_finds_the_planted_lines(spark, table):
    got = {(r["doc_id"], r["license"]) for r in op7_license_scan(spark, SF).collect()}
    for name in ("apache-2.0-line", "cc-by-nc-4.0-line", "gpl-3.0-line", "mit-line", "all-rights-reserved"):
        want = {r["doc_id"] for r in table if TEMPLATES[name] in r["text"]}
        assert {i for i, n in got if n == name} == want


def test_odd_rows(spark, odd, empty):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    with pytest.raises(ValueError, match="fewer than 3 words"):
        licenses.index({"a": "two words"})
