"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweir.llm.common import hash_words, kgrams, pieces, raw

#: Text bytes of benchmark items in one broadcast index.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
#: Pairs of equal windows of a document and all items that are listed; where there would be more, tiles are found by length.
LISTED = 1 << 20


@dataclass(frozen=True)
class Seeds:
    """Sorted hashes of the k-word windows of items; those of hash i are at places[start[i]:start[i + 1]] as (item, word)."""

    k: int
    hashes: np.ndarray
    start: np.ndarray
    item: np.ndarray
    word: np.ndarray
    filter: np.ndarray


@dataclass(frozen=True)
class Index:
    item_ids: pa.Array
    n_words: np.ndarray
    seeds: list[Seeds]
    words: np.ndarray
    first: np.ndarray


def index(item_ids: pa.Array, texts: pa.Array, min_match: int) -> Index:
    """Windows of ``min_match`` words of each item; an item with fewer words is one window."""
    words, _, first = hash_words(*raw(texts))
    n = np.diff(first)
    seeds = []
    for k in sorted({min(int(x), min_match) for x in n if x}):
        own = (n >= min_match) if k == min_match else (n == k)
        hashes, inside = kgrams(words, first, k)
        at = np.flatnonzero(inside)
        item = np.searchsorted(first, at, "right") - 1
        at, item = at[own[item]], item[own[item]]
        order = np.argsort(hashes[at], kind="stable")
        at, item = at[order], item[order]
        unique, start = np.unique(hashes[at], return_index=True)
        table = np.zeros(1 << FILTER_BITS, bool)
        table[(unique >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        seeds.append(Seeds(k, unique, np.r_[start, len(at)], item, at - first[item], table))
    return Index(item_ids, n, seeds, words, first)


def tile(doc_at: np.ndarray, item_at: np.ndarray, k: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc word, item word, length) from matching windows of ``k`` words at (doc_at, item_at).

    Windows that follow each other in both texts form a match. The longest match is marked first; one that overlaps what is marked is cut to its
    unmarked stretches, which are tried again if they still have ``k`` words. So moved passages count wherever they stand.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    new = np.flatnonzero(np.r_[True, (np.diff(d) != 1) | (np.diff(i) != 1)])
    lengths = np.diff(np.r_[new, len(d)]) + k - 1
    heap = [(-int(n), int(i[a]), int(d[a])) for a, n in zip(new, lengths)]
    heapq.heapify(heap)
    item_marks, doc_marks, tiles = np.zeros(n_item, bool), set(), []
    while heap:
        n, at, doc = heapq.heappop(heap)
        free = [not item_marks[at + t] and doc + t not in doc_marks for t in range(-n)]
        if all(free):
            item_marks[at:at - n] = True
            doc_marks.update(range(doc, doc - n))
            tiles.append((doc, at, -n))
            if item_marks.all():
                break
            continue
        run = 0
        for t, ok in enumerate([*free, False]):
            if ok:
                run += 1
                continue
            if run >= k:
                heapq.heappush(heap, (-run, at + t - run, doc + t - run))
            run = 0
    return tiles


class _Rolling:
    """Hashes of all windows of any length of a text, from running sums."""

    def __init__(self, words: np.ndarray):
        base = 0x9E3779B97F4A7C15
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(words), base, np.uint64)], dtype=np.uint64)
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(len(words), pow(base, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(words * up[:-1], dtype=np.uint64)]

    def windows(self, n: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows of n words without a mark."""
        upto = np.r_[0, np.cumsum(marks)]
        at = np.flatnonzero(upto[n:] == upto[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.down[at]


def tile_by_length(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The tiles of :func:`tile` from the word hashes of both texts, without listing the pairs of windows they share.

    From the longest common length of unmarked words down (found by halving, as every part of a match is one), windows of that length are
    compared by running Karp-Rabin hashes, and the first free one of the item is marked with the first free one of the document. Takes memory in proportion to the texts.
    """
    a, b = _Rolling(doc), _Rolling(item)
    doc_marks, item_marks, tiles = np.zeros(len(doc), bool), np.zeros(len(item), bool), []

    def shared(n: int) -> bool:
        return n <= min(len(doc), len(item)) and bool(np.isin(b.windows(n, item_marks)[1], a.windows(n, doc_marks)[1]).any())

    high = min(len(doc), len(item))
    while high >= k and shared(k) and not item_marks.all():
        low = k  # shared; what is longer than high isn't
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        at, hashes = a.windows(low, doc_marks)
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        for place, h in zip(*(x.tolist() for x in b.windows(low, item_marks))):
            if item_marks[place:place + low].any():
                continue
            start, stop = np.searchsorted(hashes, np.uint64(h), "left"), np.searchsorted(hashes, np.uint64(h), "right")
            free = next((d for d in at[start:stop].tolist() if not (doc_marks[d] or doc_marks[d + low - 1])), None)
            if free is not None:  # marks at this length are as long as the window, so its ends tell
                doc_marks[free:free + low] = True
                item_marks[place:place + low] = True
                tiles.append((free, place, low))
        high = low - 1
    return tiles


def _many(own: Index, seeds: Seeds, doc: np.ndarray, p: np.ndarray, threshold: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(item, tiles) of a document whose windows are those at the given places of the index; an item is looked at only if they can cover enough of it."""
    kinds = np.unique(p)
    many = seeds.start[kinds + 1] - seeds.start[kinds]
    entry = np.repeat(seeds.start[kinds] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    for which in np.unique(seeds.item[entry]).tolist():
        n = int(own.n_words[which])
        if _reach(seeds.word[entry][seeds.item[entry] == which], seeds.k, n) >= threshold * n:
            yield which, tile_by_length(doc, own.words[own.first[which]:own.first[which + 1]], seeds.k)


def _reach(places: np.ndarray, k: int, n: int) -> int:
    """Words of an item that windows at these places can cover at most."""
    reach = np.zeros(n + 1, np.int64)
    starts = np.unique(places)
    reach[starts] += 1
    reach[starts + k] -= 1
    return int(np.count_nonzero(np.cumsum(reach[:-1])))


def search(own: Index, texts: pa.Array, threshold: float) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tiles) for all items of which tiles cover at least the threshold."""
    words, _, first = hash_words(*raw(texts))
    out = []
    for seeds in own.seeds:
        hashes, inside = kgrams(words, first, seeds.k)
        at = np.flatnonzero(seeds.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & inside)
        place = np.minimum(np.searchsorted(seeds.hashes, hashes[at]), len(seeds.hashes) - 1)
        same = seeds.hashes[place] == hashes[at]
        at, place = at[same], place[same]
        row = np.searchsorted(first, at, "right") - 1
        for r in np.unique(row):
            mine = row == r if len(row) < 64 else slice(*np.searchsorted(row, [r, r + 1]))
            a, p = at[mine] - first[r], place[mine]
            many = seeds.start[p + 1] - seeds.start[p]
            if many.sum() > LISTED:
                found = _many(own, seeds, words[first[r]:first[r + 1]], p, threshold)
                out += [(int(r), which, tiles) for which, tiles in found if sum(t[2] for t in tiles) >= threshold * own.n_words[which]]
                continue
            doc_at = np.repeat(a, many)
            entry = np.repeat(seeds.start[p] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            item, word = seeds.item[entry], seeds.word[entry]
            order = np.argsort(item, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
                which, n = int(item[group[0]]), int(own.n_words[item[group[0]]])
                if _reach(word[group], seeds.k, n) < threshold * n:
                    continue
                tiles = tile(doc_at[group], word[group], seeds.k, n)
                if sum(t[2] for t in tiles) >= threshold * n:
                    out.append((int(r), which, tiles))
    return out


def blocks(benchmark: DataFrame, min_match: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of all items, one bounded block after the other; most benchmarks are one block."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))))
    for b in range(n):
        found = dealt.filter(F.col("block") == b).orderBy("item_id", "text").toArrow()
        if found.num_rows:
            yield index(found.column("item_id").combine_chunks(), found.column("text").combine_chunks(), min_match)


def matches(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.6) -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, item_words, n_tiles, longest, first_word) of every document and benchmark item it holds.

    A row says that non-overlapping passages of at least ``min_match`` words, wherever they stand in the text, cover ``threshold`` of the item's words
    (A-Z lower-cased, between ASCII white space). Documents are scanned where they are: a broadcast index of the items' windows finds shared seeds,
    and tiling runs within the row, so nothing is shuffled and a passage that every document shares is no hot key. A benchmark above
    BLOCK_BYTES is taken in blocks, with one scan each, so what is broadcast doesn't grow with it. Items with fewer than ``min_match`` words
    must occur whole; null texts, and items without words, match nothing. Ties among equally long tiles go to the first in the item, then in the document. Long texts that
    repeat an item's words take memory in proportion to their length. Repeated rows or items repeat. Other columns are ignored.
    """
    schema = docs.select("doc_id").schema
    schema = schema.add("item_id", benchmark.schema["item_id"].dataType).add("coverage", "double").add("matched_words", "long").add("item_words", "long")
    schema = schema.add("n_tiles", "long").add("longest", "long").add("first_word", "long")
    out = docs.sparkSession.createDataFrame([], schema)
    for n, own in enumerate(blocks(benchmark, min_match)):
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def run(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own: Index = shared.value
            for batch in rows:
                for part in pieces(batch):
                    found = search(own, part.column("text"), threshold)
                    sums = [sum(t[2] for t in tiles) for _, _, tiles in found]
                    size = [int(own.n_words[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(pa.array([r for r, _, _ in found], pa.int64())), own.item_ids.take(pa.array([i for _, i, _ in found], pa.int64())),
                        pa.array([a / b for a, b in zip(sums, size)], pa.float64()), pa.array(sums, pa.int64()), pa.array(size, pa.int64()),
                        pa.array([len(t) for _, _, t in found], pa.int64()), pa.array([max(x[2] for x in t) for _, _, t in found], pa.int64()),
                        pa.array([min(x[0] for x in t) for _, _, t in found], pa.int64()),
                    ], names=schema.names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if n == 0 else out.unionByName(part)
    return out


def without(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.6) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no benchmark item in the sense of :func:`matches`."""
    for own in blocks(benchmark, min_match):
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def run(rows: Iterator[pa.RecordBatch], shared=shared, at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for part in pieces(batch, column=at):
                    drop = {r for r, _, _ in search(shared.value, part.column(at), threshold)}
                    yield part.filter(pa.array([i not in drop for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
