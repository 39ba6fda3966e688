"""Licence texts and notices in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskweir.llm.common import hash_words, kgrams, pieces, raw
from riskweir.llm.license_texts import TEMPLATES

#: Anything in ASCII but letters and digits ends a word, so punctuation and line breaks don't matter.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
FILTER_BITS = 20
#: All template words that one scan may broadcast.
MAX_WORDS = 2_000_000


@dataclass(frozen=True)
class Index:
    """Inverted index: fingerprint i is at words place[start[i]:start[i + 1]] of templates owner[...]; sizes: words of a fingerprint."""

    names: list[str]
    words: list[np.ndarray]
    sizes: tuple[int, ...]
    prints: np.ndarray
    start: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    filter: np.ndarray


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash, the last one of equals, of every window; of all hashes if they fill no window."""
    if len(hashes) <= window:
        return np.arange(len(hashes)) if len(hashes) < window else np.array([window - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def least_run(n: int, coverage: float) -> int:
    """Words in a row that stay equal wherever as many of ``n`` words are changed or missing as the coverage allows."""
    need = wanted(n, coverage)
    return -(-need // (n - need + 1))


def wanted(n: int, coverage: float) -> int:
    """The fewest words of ``n`` that are the coverage."""
    return math.ceil(coverage * n - 1e-9)


def index(templates: Mapping[str, str], k: int = 3, window: int = 3, coverage: float = 0.8) -> Index:
    """Fingerprints are of ``k`` words, or fewer where the changed words that the coverage allows can leave no k in a row, and a template is
    winnowed only as far as the words that must stay in a row allow. So a text with ``coverage`` of a template's words, the others changed or missing, shares
    a fingerprint with it."""
    names, words, found, used = sorted(templates), [], [], set()
    for t, name in enumerate(names):
        own, _, first = hash_words(*raw(pa.array([templates[name]])), SEPARATORS)
        if len(own) < k:
            raise ValueError(f"template {name} has fewer than {k} words")
        words.append(own)
        run = least_run(len(own), coverage)
        size = max(1, min(k, run))
        used.add(size)
        hashes, _ = kgrams(own, first, size)
        at = winnow(hashes, max(1, min(window, run - size + 1)))
        found.append(np.rec.fromarrays([hashes[at], np.full(len(at), t), at], names="h,t,p"))
    if sum(map(len, words)) > MAX_WORDS:
        raise ValueError(f"templates have more than {MAX_WORDS} words; scan with parts of them")
    every = np.concatenate(found) if found else np.rec.fromarrays([np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)], names="h,t,p")
    every = every[np.argsort(every["h"], kind="stable")]
    prints, start = np.unique(every["h"], return_index=True)
    table = np.zeros(1 << FILTER_BITS, bool)
    table[(prints >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(names, words, tuple(sorted(used)), prints, np.r_[start, len(every)], every["t"], every["p"], table)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched, begin, end): the best local alignment of a template with a text within the band of diagonals low to high (text word - template word).

    A match scores 1, a changed, missing or extra word -1; equal scores go to the longer match, then to the earlier end. Rows of the band are filled
    one by one; each cell carries its score, matched words and begin, so nothing is traced back.
    """
    width = high - low + 1
    score, matched, begin = [0] * (width + 1), [0] * (width + 1), [0] * (width + 1)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        new_score, new_matched, new_begin = [0] * (width + 1), [0] * (width + 1), [0] * (width + 1)
        for b in range(width):
            j = i + low + b
            if not 0 <= j < len(text):
                continue
            same = bool(word == text[j])
            # Diagonal: same band cell of the row above. Missing template word: next cell above. Extra text word: cell to the left.
            s, m, at = (score[b] + (1 if same else -1), matched[b] + same, begin[b] if score[b] > 0 else j)
            if b + 1 < width and score[b + 1] - 1 > s:
                s, m, at = score[b + 1] - 1, matched[b + 1], begin[b + 1]
            if b and new_score[b - 1] - 1 > s:
                s, m, at = new_score[b - 1] - 1, new_matched[b - 1], new_begin[b - 1]
            if s > 0:
                new_score[b], new_matched[b], new_begin[b] = s, m, at
                if (s, m) > best[:2]:
                    best = (s, m, at, j + 1)
        score, matched, begin = new_score, new_matched, new_begin
    return best[1], best[2], best[3]


def align_both(template: np.ndarray, text: np.ndarray, low: int, high: int, need: int) -> tuple[int, int, int]:
    """:func:`align`, and where it matches fewer than ``need`` words, from the back too: a first part that costs what it matches is a tie only seen from there."""
    found = align(template, text, low, high)
    if found[0] >= need:
        return found
    n, behind = len(text), len(text) - len(template)
    matched, begin, end = align(template[::-1], text[::-1], behind - high, behind - low)
    return (matched, n - end, n - begin) if matched > found[0] else found


def search(own: Index, texts: pa.Array, coverage: float) -> list[tuple[int, int, int, int, int, int]]:
    """(row, template, matched words, words of the span, first byte, byte after the last) of all spans in the texts."""
    data, offsets = raw(texts)
    words, begins, first = hash_words(data, offsets, SEPARATORS)
    hits = []
    for size in own.sizes:
        grams, inside = kgrams(words, first, size)
        spots = np.flatnonzero(own.filter[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & inside)
        hits.append((spots, grams[spots]))
    if not sum(len(x) for x, _ in hits) or not len(own.prints):
        return []
    at, hashes = (np.concatenate(x) for x in zip(*hits))
    entry = np.minimum(np.searchsorted(own.prints, hashes), len(own.prints) - 1)
    same = own.prints[entry] == hashes
    at, entry = at[same], entry[same]
    many = own.start[entry + 1] - own.start[entry]
    if not many.sum():
        return []
    spot = np.repeat(own.start[entry] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    at, owner, place = np.repeat(at, many), own.owner[spot], own.place[spot]
    row = np.searchsorted(first, at, "right") - 1
    diagonal = at - first[row] - place
    order = np.lexsort((diagonal, owner, row))
    row, owner, diagonal = row[order], owner[order], diagonal[order]
    slack = np.array([max(2, len(w) // 6, len(w) - wanted(len(w), coverage)) for w in own.words])[owner]
    new = np.r_[True, (np.diff(row) != 0) | (np.diff(owner) != 0) | (np.diff(diagonal) > slack[1:])]
    edges = np.r_[np.flatnonzero(new), len(row)]
    found = []
    for a, b in zip(edges, edges[1:]):
        r, t, pad = int(row[a]), int(owner[a]), int(slack[a])
        template, text = own.words[t], words[first[r]:first[r + 1]]
        # Hits that chain over many copies are taken one template length at a time, so a band stays as wide as the template.
        low, top = int(diagonal[a]), int(diagonal[b - 1])
        while low <= top:
            high = min(top, low + len(template) - 1)
            need = wanted(len(template), coverage)
            matched, begin, end = align_both(template, text, low - pad, high + pad, need)
            if matched >= need:
                s, e = first[r] + begin, first[r] + end
                stop = int(offsets[r + 1] if e == first[r + 1] else begins[e])
                while stop > begins[e - 1] and data[stop - 1] in SEPARATORS:
                    stop -= 1
                found.append((r, t, matched, end - begin, int(begins[s] - offsets[r]), stop - int(offsets[r])))
            rest = diagonal[a:b][diagonal[a:b] > high]
            low = int(rest[0]) if len(rest) else top + 1
    return apart(found)


def apart(found: list[tuple]) -> list[tuple]:
    """Of spans of one template that overlap in a row, the one with the most matched words, then the shortest, then the first."""
    kept: dict[tuple[int, int], list[tuple]] = {}
    for x in sorted(found, key=lambda x: (x[0], x[1], -x[2], x[5] - x[4], x[4])):
        own = kept.setdefault(x[:2], [])
        if all(x[5] <= y[4] or x[4] >= y[5] for y in own):
            own.append(x)
    return [x for own in kept.values() for x in sorted(own, key=lambda x: x[4])]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8, k: int = 3, window: int = 3) -> DataFrame:
    """(doc_id, license, coverage, matched_words, template_words, span_words, begin, end) of every licence text found.

    A row is a span of the document that aligns with at least ``coverage`` of a template's words; ``begin`` and ``end`` are its characters, the end
    excluded. Words are runs of letters and digits with A-Z lower-cased. All windows of ``k`` words of a document, or fewer as :func:`index` says, are looked up
    in the broadcast index of the templates (at most MAX_WORDS words); only around shared fingerprints are words aligned, within a band as wide as
    a sixth of the template or the words that may be missing, besides the fingerprints' own spread. Documents are scanned where they are, so nothing is shuffled. Null and empty texts give
    no row, repeated rows repeat, a licence found twice in a text gives two rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index(templates, k, window, coverage))
    schema = docs.select("doc_id").schema.add("license", "string").add("coverage", "double").add("matched_words", "long")
    schema = schema.add("template_words", "long").add("span_words", "long").add("begin", "long").add("end", "long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in rows:
            for part in pieces(batch):
                found = search(own, part.column("text"), coverage)
                column = part.column("text").cast(pa.binary())
                text = {r: column[r].as_py() for r in {x[0] for x in found}}
                sizes = [len(own.words[x[1]]) for x in found]
                longs = [[x[2] for x in found], sizes, [x[3] for x in found]] + [[len(text[x[0]][:x[i]].decode("utf-8", "replace")) for x in found] for i in (4, 5)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())), pa.array([own.names[x[1]] for x in found], pa.string()),
                    pa.array([x[2] / n for x, n in zip(found, sizes)], pa.float64()), *(pa.array(v, pa.int64()) for v in longs),
                ], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
