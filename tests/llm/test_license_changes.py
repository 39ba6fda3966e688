from itertools import combinations

import pyarrow as pa
import pytest
from riskweir.llm import licenses
from riskweir.llm.common import hash_words, raw
from riskweir.llm.license_texts import TEMPLATES


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).split()


def changes(n):
    """Each allowed change of one word, of two words of short templates, and of as many as are allowed, evenly and in one run."""
    spare = n - licenses.wanted(n, 0.8)
    out = [(i,) for i in range(n)] if spare else []
    out += list(combinations(range(n), 2)) if spare > 1 and n <= 16 else []
    for step in (2, 3, 4, 5):
        out += [tuple(range(at, n, step))[:spare] for at in range(step) if spare > 1]
    return out + ([tuple(range(at, at + spare)) for at in range(0, n - spare, 7)] if spare > 1 else [])


@pytest.mark.parametrize("name", sorted(TEMPLATES))
@pytest.mark.parametrize("missing", [False, True])
def test_allowed_changes_are_found_as_by_unbanded_alignment(name, missing):
    own = licenses.index(TEMPLATES)
    t, plain = own.names.index(name), words(TEMPLATES[name])
    texts = []
    for places in changes(len(plain)):
        new = [None if missing and i in places else f"changed{i}" if i in places else w for i, w in enumerate(plain)]
        texts.append("Some words before " + " ".join(w for w in new if w) + " and after it")
    got = {r for r, found, *_ in licenses.search(own, pa.array(texts, pa.string()), 0.8) if found == t}
    want = set()
    for i, text in enumerate(texts):
        seen = hash_words(*raw(pa.array([text])), licenses.SEPARATORS)[0]
        need = licenses.wanted(len(plain), 0.8)
        if max(licenses.align(x, y, -len(plain), len(seen))[0] for x, y in ((own.words[t], seen), (own.words[t][::-1], seen[::-1]))) >= need:
            want.add(i)
    assert got == want


@pytest.mark.parametrize("name, text", [
    ("apache-2.0-line", "Licensed under the Apache Licence, Version 2.0."), ("cc-by-nc-4.0-line", "Licensed under Cc-BY NC 4.0."),
    ("cc-by-nc-4.0-line", "Licensed under C BY NC 4.0."), *(("mit-line", x) for x in ("Released beneath the MIT License.", "Released under an MIT License.", "Released under the MTI License.")),
])
def test_changed_lines_are_found(name, text):
    own = licenses.index(TEMPLATES)
    assert name in {own.names[x[1]] for x in licenses.search(own, pa.array([text]), 0.8)}
