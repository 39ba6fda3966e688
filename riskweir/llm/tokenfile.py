"""Token ids of documents in files with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from riskweir.llm.common import pieces

REMEMBERED = 600_000
#: Pieces that the library encodes as one text.
TOGETHER = 1000
BLOCK_BYTES = 4 << 20
SAMPLE = 256
#: Text of these characters alone is split into pieces here; any other is encoded whole by the library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*")
LETTERS = "".join(sorted({chr(i).lower() for i in range(0x180) if chr(i).isalpha() and PLAIN.fullmatch(chr(i))}))
#: The published pattern of the vocabulary, for plain lower-case text.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t\n\r 0-9{LETTERS}]+")

SCHEMA = "part int, block int, inside long, n_docs int, n_ids long, width int, ids binary, low_bits int, low binary, high binary, samples binary, doc_ids array<long>"


class Memory:
    """What was learned lately: two generations of at most ``limit`` entries, so that what is asked for again and again stays."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def make_room(self, n: int) -> None:
        if len(self.new) + n > self.limit:
            self.old, self.new = self.new, {}

    def unknown(self, keys: set[str]) -> set[str]:
        """Those of the keys that must be learned; the others are in ``new`` afterwards."""
        asked = keys.difference(self.new)  # a look-up for each key; a view of the dictionary would be gone through whole
        if self.old:
            known = [k for k in asked if k in self.old]
            self.new.update(zip(known, map(self.old.__getitem__, known)))
            asked.difference_update(known)
        return asked


class Encoder:
    """Ids as the library gives them. Words of plain text are put together from pieces that the library has encoded once, and remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memory(REMEMBERED)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _each(self, pieces: list[str]) -> list[bytes]:
        """Ids of every piece. They are encoded as one text, which is cheaper, and told apart by the tokens that end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) != len(pieces):
            return [array("I", code.ids).tobytes() for code in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        data, cuts = ids.tobytes(), cuts.tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, words: set[str]) -> None:
        """Remembers words: no piece of plain text goes over white space, so a word's ids are those of its pieces, and a piece is a word, too."""
        cut = {w: PIECES.findall(w) for w in words if not w.isalpha()}
        parts = set(chain.from_iterable(cut.values()))
        unknown = list(words.difference(cut) | self.words.unknown(parts - words))
        unknown += [w for w, own in cut.items() if len(own) == 1]
        new = self.words.new
        for at in range(0, len(unknown), TOGETHER):
            some = unknown[at:at + TOGETHER]
            new.update(zip(some, self._each(some)))
        get = new.__getitem__
        new.update([(w, b"".join(map(get, own))) for w, own in cut.items() if len(own) > 1])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain lower-case texts: only their distinct words are looked up, numpy puts the ids of all words together."""
        data = np.frombuffer(" ".join(texts).encode(), np.uint8)
        white = (data == 32) | (data == 9) | (data == 10) | (data == 13)
        first = ~white
        first[1:] &= white[:-1]
        starts = np.flatnonzero(first)
        places = np.r_[np.cumsum(~white)[starts] - 1, len(data) - white.sum()].astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[~white])).dictionary_encode()
        known = words.dictionary.to_pylist()
        self.words.make_room(2 * len(known))  # for their pieces as well
        self._learn(self.words.unknown(set(known)))
        codes = list(map(self.words.new.__getitem__, known))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) >> 2
        ids, begins = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        size = sizes[at]
        upto = np.cumsum(size)
        out = ids[np.repeat(begins[at] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        ends = np.cumsum([len(x.encode()) + 1 for x in texts])  # of each text and the space behind it
        cuts = (4 * np.r_[0, upto][np.searchsorted(starts, ends)]).tolist()
        return [out[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text, without added tokens."""
        plain = [PLAIN.fullmatch(x) is not None and not any(s in x for s in self.special) for x in texts]
        simple = iter(self._plain([x.lower() for x, p in zip(texts, plain) if p]) if any(plain) else [])
        whole = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [next(simple) if p else array("I", next(whole).ids).tobytes() for p in plain]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(low_bits, low, high, samples) of a rising sequence of non-negative ints.

    The low bits of every value are packed as they are; the high parts are a bit vector with a one for each value after as many zeros as its
    high part: about 2 + log2(last / n) bits a value. ``samples`` holds the place of every 256th one, 4 bytes each.
    """
    n, last = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, (last // max(1, n)).bit_length() - 1)
    low = ((ends[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
    ones = (ends >> low_bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return low_bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()


#: Place of the k-th one of every byte.
_PLACES = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[:8] for x in range(256)], np.int64)


class Boundaries:
    """Reads an Elias-Fano sequence in place."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    def _low(self, at: np.ndarray) -> np.ndarray:
        bits = at[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bits >> 3] >> (bits & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """Value i: from the sampled one before it, ones are counted in the bytes that follow."""
        start = int(self.samples[i // SAMPLE])
        byte, need = start >> 3, i % SAMPLE
        first = int(self.high[byte]) >> (start & 7) << (start & 7)
        while (have := first.bit_count()) <= need:
            need, byte = need - have, byte + 1
            first = int(self.high[byte])
        for _ in range(need):
            first &= first - 1
        one = byte * 8 + (first & -first).bit_length() - 1
        return (one - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places: their bytes from running counts of ones, their bits from a table."""
        counts = np.bitwise_count(self.high).astype(np.int64)
        upto = np.cumsum(counts)
        byte = np.searchsorted(upto, at, "right")
        ones = byte * 8 + _PLACES[self.high[byte], at - (upto[byte] - counts[byte])] if len(at) else at
        return (ones - at) << self.low_bits | self._low(at)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, partitions: int | None = None, block_bytes: int = BLOCK_BYTES) -> None:
    """Encodes every whole text, adds ``end_id``, and writes the ids of all documents in ascending doc_id order to ``path``.

    The files are Parquet, so a task's output appears only when it commits and any store that Spark writes to will do. A row is a block of
    whole documents: ``ids`` is their concatenated ids as little-endian uint16, or uint32 where an id needs it (``width`` bytes each);
    the ends of the documents in it are an Elias-Fano sequence (``low_bits``, ``low``, ``high``, ``samples``), and ``doc_ids`` names them. ``part`` and ``block`` order
    the blocks, ``inside`` is the number of ids before a block in its part. Documents are ordered by a range shuffle, and a task holds one block at a time, or one document if that is longer.
    A null text is an empty one. Null ids come first; rows with the same id are ordered by text. Other columns are ignored.
    """
    spark = docs.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")

    def block(part: int, number: int, inside: int, ids: list[int | None], codes: list[bytes]) -> dict:
        tail = np.array([end_id], "<u4").tobytes()
        every = np.frombuffer(b"".join(chain.from_iterable((c, tail) for c in codes)), "<u4")
        width = 2 if every.max() < 1 << 16 else 4
        low_bits, low, high, samples = elias_fano(np.cumsum([len(c) // 4 + 1 for c in codes]))
        return {"part": part, "block": number, "inside": inside, "n_docs": len(ids), "n_ids": len(every), "width": width, "ids": every.astype(f"<u{width}").tobytes(),
                "low_bits": low_bits, "low": low, "high": high, "samples": samples, "doc_ids": ids}

    types = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("inside", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()),
                       ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number, inside = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        codes: list[bytes] = []
        held = 0
        for batch in rows:
            for piece in pieces(batch, 6 << 20):
                for doc, code in zip(piece.column("doc_id").to_pylist(), own.encode(piece.column("text").to_pylist())):
                    if ids and held + len(code) + 4 > block_bytes:
                        done = block(part, number, inside, ids, codes)
                        yield pa.RecordBatch.from_pylist([done], types)
                        ids, codes, held, number, inside = [], [], 0, number + 1, inside + done["n_ids"]
                    ids.append(doc)
                    codes.append(code)
                    held += len(code) + 4
        if ids:
            yield pa.RecordBatch.from_pylist([block(part, number, inside, ids, codes)], types)

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the files with ``start``: the ids of all blocks before each. One total per part is summed over all parts; ids aren't moved.

    There are as many parts as the files were written with partitions, so their totals are a table of bounded size, which is broadcast.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = totals.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("part_start"))
    return stored.join(F.broadcast(parts), F.col("part") == F.col("p")).withColumn("start", F.col("part_start") + F.col("inside")).drop("p", "part_start")


def document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids array) of the documents with that id: two selects in the block that names it, nothing else is decoded."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                ends = Boundaries(*(row[c] for c in ("n_docs", "low_bits", "low", "high", "samples")))
                found = [i for i, x in enumerate(row["doc_ids"]) if x == doc_id]
                cuts = [(ends.select(i - 1) if i else 0, ends.select(i)) for i in found]
                ids = [np.frombuffer(row["ids"], f"<u{row['width']}", b - a, a * row["width"]).tolist() for a, b in cuts]
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "start": row["start"] + a, "n_tokens": b - a, "ids": x} for (a, b), x in zip(cuts, ids)], types)

    types = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    held = blocks(spark, path).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    return held.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files: where its ids begin among all, how many, their checksum."""
    cols = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("n_docs", "width", "ids", "low_bits", "low", "high", "samples", "start")}
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                ends = Boundaries(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"]).select_many(np.arange(row["n_docs"]))
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                out = [batch.column("doc_ids").slice(i, 1).flatten(), pa.array(row["start"] + begins), pa.array(ends - begins), pa.array(sums, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    needed = blocks(spark, path).select("n_docs", "width", "ids", "low_bits", "low", "high", "samples", "doc_ids", "start")
    return needed.mapInArrow(run, cols)
