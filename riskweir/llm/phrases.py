"""Collocations: count streams of word sequences, merged in lockstep in prefix order and in suffix order.

All counts are per language, as the id of a word is a hash of its language and itself. The ids of all words of the corpus are checked
against each other before they are used, and hashed anew with another salt if a frequent word shares its id, so ids are exact names.

1. Words are counted; those below the threshold can be in no phrase (a phrase is no more frequent than its parts).
2. Sequences of n words are counted only where both parts of n - 1 words may be frequent. A bitmap of fixed size says so: it has every
   frequent part, so nothing is lost, and an infrequent one only by chance, which costs time and no correctness.
3. The frequent sequences of all lengths are one stream. Sorted by words from the first on, every sequence stands behind its
   prefixes and before its extensions to the right; sorted from the last word on, behind its suffixes. One walk with a stack of at most
   ``longest`` rows reads off the counts of all parts and the largest extension. Streams are cut into ranges of equal size; a single word
   is repeated in every range that it begins.
4. Both walks are merge-joined, and each phrase has its best cut and its extensions in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from riskweir.llm.common import hash_words, mix, pieces, raw, saved

BREAKS = b".,;:!?\n\x0b\x0c\r"
SEPARATORS = b"\t " + BREAKS
UNKNOWN = "und"
#: Sizes of the bitmaps of frequent words and of frequent longer sequences: 2 MB and 8 MB, whatever the corpus.
WORD_BITS, GRAM_BITS = 24, 26
#: Rows of a range of a sorted stream.
RANGE_ROWS = 200_000
#: Sequences that a task counts before it hands them on.
HELD = 1 << 19
#: Rows that it hands on at once.
SENT = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPLITS = np.isin(np.arange(256), list(SEPARATORS))
_ENDS = np.isin(np.arange(256), list(BREAKS))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        yield from pieces(batch, 1 << 20)


# -- words ------------------------------------------------------------------------------------------------------------------------


def _counted(part: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, word, f): the words of a batch, lower-cased, as exact strings."""
    data, offsets = raw(part.column("text"))
    solid = ~_SPLITS[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    letters = _LOWER[data[solid]]
    at = np.r_[np.cumsum(solid)[starts] - 1, len(letters)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(letters)).dictionary_encode()
    langs = part.column("lang").dictionary_encode()
    row = np.searchsorted(offsets, starts, "right") - 1
    both = words.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()[row]
    found, n = np.unique(both, return_counts=True)
    word, lang = np.divmod(found, max(1, len(langs.dictionary)))
    return pa.RecordBatch.from_arrays([langs.dictionary.take(lang), words.dictionary.take(word).cast(pa.string()), n], names=["lang", "word", "f"])


def _ids(hashes: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Positive 63-bit ids; 0 stands for no word."""
    return np.maximum(mix(hashes ^ langs) >> np.uint64(1), np.uint64(1)).astype(np.int64)


def _lang_hashes(column: pa.Array) -> np.ndarray:
    encoded = column.dictionary_encode()
    known = np.array([xxh64_intdigest(x.encode()) for x in encoded.dictionary.to_pylist()], np.uint64)
    return known[encoded.indices.to_numpy()] if len(column) else np.empty(0, np.uint64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words of all documents."""
    counted = _texts(docs).mapInArrow(lambda rows: map(_counted, _parts(rows)), "lang string, word string, f long")
    return saved(counted.groupBy("lang", "word").agg(F.sum("f").alias("f")), "phrase-words")


def named(words: DataFrame, salt: int) -> DataFrame:
    """The vocabulary with the id of each word."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in rows for p in pieces(batch, column="word")):
            hashes = hash_words(*raw(part.column("word")), SEPARATORS, salt)[0]
            yield part.append_column("id", pa.array(_ids(hashes, _lang_hashes(part.column("lang")))))

    return words.select("lang", "word", "f").mapInArrow(run, "lang string, word string, f long, id long")


def _salt(words: DataFrame, least: int) -> int:
    """A salt with which no frequent word shares its id with any other word."""
    for salt in range(8):
        if named(words, salt).groupBy("id").agg(F.count("*").alias("n"), F.max("f").alias("f")).filter(f"n > 1 and f >= {least}").isEmpty():
            return salt
    raise ArithmeticError("Eight hashes in a row have two words with one id; the words of this corpus were made to collide.")


# -- sequences --------------------------------------------------------------------------------------------------------------------


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """Bytes with a bit set for the low ``bits`` of each value (one long column); aggregated in Spark, so the driver gets the bitmap alone."""
    value = F.col(values.columns[0]).bitwiseAND((1 << bits) - 1)
    rows = values.select(F.shiftright(value, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(`{values.columns[0]}` & 63 as int))").alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def _has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """A 63-bit hash of sequences, one array per place."""
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = mix(out * _BASE + w.view(np.uint64))
    return (out >> np.uint64(1)).astype(np.int64)


def _sequences(part: pa.RecordBatch, salt: int, known: dict[int, np.ndarray], n: int) -> list[np.ndarray]:
    """Ids, by place, of the sequences of n words within pieces both of whose parts of n - 1 words may be frequent."""
    data, offsets = raw(part.column("text"))
    hashes, starts, first = hash_words(data, offsets, SEPARATORS, salt)
    if len(starts) < n:
        return [np.empty(0, np.int64)] * n
    ids = _ids(hashes, np.repeat(_lang_hashes(part.column("lang")), np.diff(first)))
    piece = np.cumsum(_ENDS[data], dtype=np.int32)[starts]
    joined = piece[1:] == piece[:-1]
    joined[first[(first > 0) & (first < len(ids))] - 1] = False
    may = _has(known[1], ids)
    at = np.flatnonzero(may[:-1] & may[1:] & joined)  # where two words may begin a sequence
    for order in range(2, n):
        good = at[_has(known[order], gram_hash([ids[at + k] for k in range(order)]))]
        at = good[np.isin(good + 1, good, assume_unique=True)] if len(good) else good
    return [ids[at + k] for k in range(n)]


def _merged(held: list[list[np.ndarray]], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns added up, in order."""
    columns, n = [np.concatenate(x) for x in zip(*held)], np.concatenate(counts)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], (np.add.reduceat(n[order], starts) if len(starts) else n)


def _combined(streams: Iterator[list[np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows of columns, added up in the task before they are handed on with their counts."""
    held, counts, size = [], [], 0
    for columns in streams:
        rows, n = _merged([columns], [np.ones(len(columns[0]), np.int64)])
        held, counts, size = [*held, rows], [*counts, n], size + len(n)
        if size > HELD:
            rows, n = _merged(held, counts)
            held, counts, size = [rows], [n], len(n)
            if size > HELD // 2:
                held, counts, size = [], [], 0
                yield rows, n
    if size:
        yield _merged(held, counts)


def _frequent(docs: DataFrame, salt: int, known: dict[int, np.ndarray], n: int, longest: int, least: int) -> DataFrame:
    """(w1..., f) of the frequent sequences of n words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = [f"w{k}" for k in range(1, longest + 1)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _combined(_sequences(p, salt, shared.value, n) for p in _parts(rows)):
            for at in range(0, len(counts), SENT):
                some = slice(at, at + SENT)
                none = np.zeros(len(counts[some]), np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(w[some]) for w in words), *[pa.array(none)] * (longest - n), pa.array(counts[some])], names=[*names, "f"])

    counted = _texts(docs).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "f"]))
    return saved(counted.groupBy(*names).agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrase-counts")


def streams(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All words (lang, word, f), the frequent ones with ids, and the count stream (w1..., f) of all frequent sequences; 0 for no word."""
    words = vocabulary(docs)
    salt = _salt(words, least)
    frequent = saved(named(words.filter(F.col("f") >= least), salt), "phrase-ids")
    known = {1: bitmap(frequent.select("id"), WORD_BITS)}
    stream = frequent.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(f"w{k}") for k in range(2, longest + 1)), "f")
    for n in range(2, longest + 1):
        found = _frequent(docs, salt, known, n, longest, least)
        stream = stream.union(found)
        if n < longest:
            known[n] = bitmap(_hashed(found, n), GRAM_BITS)
    return words, frequent, saved(stream, "phrase-stream")


def _hashed(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(gram_hash([batch.column(k).to_numpy() for k in range(n)]))], names=["h"])

    return rows.select(*(f"w{k}" for k in range(1, n + 1))).mapInArrow(run, "h long")


# -- walks ------------------------------------------------------------------------------------------------------------------------


def _coarse(words: np.ndarray) -> np.ndarray:
    """Rises with the first two words of a row; equal for all rows that begin with the same two."""
    return (words[:, 0] >> 31 << 31) | (words[:, 1] >> 32)


def _flipped(words: np.ndarray) -> np.ndarray:
    """Each row's words from the last to the first."""
    at = (words > 0).sum(1)[:, None] - 1 - np.arange(words.shape[1])
    return np.where(at >= 0, np.take_along_axis(words, np.maximum(at, 0), 1), 0)


def _matrix(batch: pa.RecordBatch, longest: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy() for k in range(longest)], 1)


def walk(rows: Iterator[list[int]], longest: int) -> Iterator[tuple[list[int], list[int], int]]:
    """(row, counts of its beginnings, largest count of a row one word longer) of rows (words..., f > 0) in order; a stack holds the open ones."""
    stack: list[tuple[list[int], int, list[int], list[int]]] = []

    def close() -> tuple[list[int], list[int], int]:
        row, _, before, most = stack.pop()
        return row, before, most[0]

    for row in rows:
        n = longest - row.count(0)
        while stack and (stack[-1][1] >= n or stack[-1][0][:stack[-1][1]] != row[:stack[-1][1]]):
            yield close()
        if stack and stack[-1][1] == n - 1:
            stack[-1][3][0] = max(stack[-1][3][0], row[longest])
        stack.append((row, n, [s[0][longest] for s in stack], [0]))
    while stack:
        yield close()


def merged(stream: DataFrame, longest: int, backwards: bool) -> DataFrame:
    """(w1..., p1..., ext) of every sequence of two words or more: the counts of its first 1, 2, ... words, or its last ones, and of its most
    frequent extension on the other side."""
    names = [f"w{k}" for k in range(1, longest + 1)]
    turn = _flipped if backwards else lambda words: words

    def keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array(_coarse(turn(_matrix(batch, longest))))], names=["key"])

    n = stream.count()
    parts = max(1, -(-n // RANGE_ROWS))
    bounds = np.empty(0, np.int64)
    if parts > 1:
        share = [k / parts for k in range(1, parts)]
        bounds = np.array(stream.mapInArrow(keys, "key long").agg(F.percentile_approx("key", share, max(10_000, 4 * parts))).first()[0], np.int64)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words = turn(_matrix(batch, longest))
            low = _coarse(words)
            high = np.where(words[:, 1] > 0, low, low | (1 << 31) - 1)
            a, b = np.searchsorted(bounds, low, "right"), np.searchsorted(bounds, high, "right")
            row = np.repeat(np.arange(len(words)), b - a + 1)
            part = np.arange(len(row)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1) + a[row]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(words[row, k]) for k in range(longest)), batch.column(longest).take(pa.array(row))], names=["part", *names, "f"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            words = turn(np.array([x[0][:longest] for x in found], np.int64).reshape(-1, longest))
            before = np.array([x[1] + [0] * (longest - 1 - len(x[1])) for x in found], np.int64).reshape(-1, longest - 1)
            columns = [*(words[:, k] for k in range(longest)), *(before[:, k] for k in range(longest - 1)), np.array([x[0][longest] for x in found], np.int64), np.array([x[2] for x in found], np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=out)

        every = (list(row) for b in rows for row in zip(*(b.column(k).to_pylist() for k in range(1, longest + 2))))
        for row in walk(every, longest):
            if row[1]:
                found.append(row)
            if len(found) == 50_000:
                yield batch()
                found = []
        if found:
            yield batch()

    out = [*names, *(f"p{k}" for k in range(1, longest)), "f", "ext"]
    dealt = stream.select(*names, "f").mapInArrow(deal, ", ".join(["part int", *(f"{c} long" for c in names), "f long"]))
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", *names)
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in out))


# -- phrases ----------------------------------------------------------------------------------------------------------------------


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def mine(docs: DataFrame, longest: int = 4, least: int = 30, keep: int = 2000, cover: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    Words are runs without space or tab within pieces, pieces the text between ``BREAKS``; A-Z are lower-cased and nothing else. A phrase has
    a >= ``least`` occurrences, overlaps included. Its score is floor(2000000 a / (l + r)) of its lowest cut, in exact arithmetic; the first of
    equal cuts counts. A phrase goes if a longer candidate that holds it has ``cover`` percent of its occurrences or more; as parts are never
    rarer than the whole, one word longer is enough to look at. Best means score, then a, both descending, then the phrase by its bytes.

    A null text has no words, a null language is ``und``. Ties have an order, repeated rows count as often as they are there, an
    empty table gives no rows, other columns are ignored. No group is ever in one task: counts are added up before their shuffle, sorted streams
    are cut by size, and of a language's phrases each task hands on the best ``keep`` only.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    words, frequent, stream = streams(docs, longest, least)
    names, cuts = [f"w{k}" for k in range(1, longest + 1)], range(1, longest)
    left = merged(stream, longest, backwards=False)
    right = merged(stream, longest, backwards=True).select(*names, *(F.col(f"p{k}").alias(f"s{k}") for k in cuts), F.col("ext").alias("ext_left"))
    both = left.join(right.hint("merge"), names)
    n = sum((F.col(c) > 0).cast("int") for c in names)
    options = []
    for k in cuts:
        size_of_rest = n - k
        rest = F.coalesce(*(F.when(size_of_rest == j, F.col(f"s{j}")) for j in cuts))
        score = F.expr(f"cast(f as decimal(20,0)) * 2000000 div (cast(p{k} as decimal(20,0)) + cast(__rest{k} as decimal(20,0)))")
        both = both.withColumn(f"__rest{k}", rest)
        options.append(F.when(n > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"p{k}").alias("l"), F.col(f"__rest{k}").alias("r"))))
    best = both.withColumn("cut", F.array_min(F.array(*options)))
    whole = best.filter(F.greatest(_wide("ext"), _wide("ext_left")) * 100 < _wide("f") * cover)
    found = whole.select(*names, F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    name = frequent.select("id", "lang", "word")
    found = found.join(name.withColumnRenamed("word", "__word1"), F.col("w1") == F.col("id")).drop("id")
    order = [F.col("score").desc(), F.col("a").desc()]
    found = found.withColumn("__place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("__place") <= keep)
    for k in range(2, longest + 1):
        found = found.join(name.select(F.col("id").alias(f"__id{k}"), F.col("word").alias(f"__word{k}")), F.col(f"w{k}") == F.col(f"__id{k}"), "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *(f"__word{k}" for k in range(1, longest + 1))))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.col("phrase"))).cast("long")).filter(F.col("rank") <= keep)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
