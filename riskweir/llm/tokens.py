"""Exact token counts of every prefix of a text, for byte-level BPE."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from riskweir.llm.common import pieces as slices

#: Tables of pieces that a worker remembers at most; it starts anew when they are reached.
REMEMBERED = 700_000
#: Text of these characters alone is split by the pattern here; any other by the tokenizer's own splitter.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS}]*")
#: The published pattern that splits text before merges, for plain text.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t\n\r 0-9{LETTERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
GAPS = regex.compile(r"\s{2,}")
#: These pieces fall apart when they are cut before their last letter.
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Counts the tokens of all prefixes of a text.

    Within a piece, the encoding of a prefix is one token more than that of a shorter prefix: its last token is the only token that ends
    there and is compatible with the last token before it. Two tokens are compatible if their joint bytes encode
    to just them. So the table of a piece is filled from left to right and no prefix is encoded on its own.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        self.rank = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.longest = max(map(len, self.rank))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.tables: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}  # keyed by both tokens' ranks

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes: the best-ranked neighbours are merged until none can be."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 40:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether the joint bytes of two tokens encode to just them."""
        return self.merge(a + b) == [a, b]

    def learn(self, texts: Iterable[str]) -> dict[str, bytes]:
        """int32 token counts at each character end of each piece.

        Pieces are taken in order, so that each one goes on from the prefix it shares with the one before it.
        """
        rank, pairs, out = self.rank, self.pairs, {}
        before, last, count, starts = b"", [0], [0], [0]  # per prefix: its last token, its token count, where the last token begins
        for data, text in sorted((t.encode("utf-8", "surrogatepass"), t) for t in texts):
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del last[same + 1:], count[same + 1:], starts[same + 1:]
            before = data
            for end in range(same + 1, len(data) + 1):
                for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                    token = rank.get(data[start:end])
                    if token is None:
                        continue
                    if start:
                        fits = pairs.get(key := last[start] << 20 | token)
                        if fits is None:
                            if len(pairs) >= REMEMBERED:
                                pairs.clear()
                            fits = pairs[key] = self.compatible(data[starts[start]:start], data[start:end])
                        if not fits:
                            continue
                    last.append(token)
                    starts.append(start)
                    count.append(count[start] + 1)
                    break
            if text in CONTRACTIONS:
                ends = [count[1], 2, count[3]]
            elif text.isascii():
                ends = count[1:]
            else:
                ends = [c for c, b in zip(count[1:], [*data[1:], 0x40]) if b & 0xC0 != 0x80]
            out[text] = np.array(ends, np.int32).tobytes()
        return out

    def joined(self, found: list[str]) -> np.ndarray:
        """The tables of pieces one after the other."""
        tables = list(map(self.tables.get, found))
        if None in tables:
            new = self.learn({p for p, t in zip(found, tables) if t is None})
            tables = [new[p] if t is None else t for p, t in zip(found, tables)]
            if len(self.tables) + len(new) > REMEMBERED:
                self.tables.clear()
            self.tables.update((p, t) for p, t in new.items() if len(p) <= 64)
        return np.frombuffer(b"".join(tables), np.int32)

    def split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def ordinary(self, texts: list[str]) -> list[np.ndarray]:
        """Counts at all prefixes of texts without special strings."""
        found = [self.split(x) for x in texts]
        every = list(chain.from_iterable(found))
        if not every:
            return [np.empty(0, np.int32) for _ in texts]
        counts = self.joined(every)
        lengths = np.fromiter(map(len, every), np.int64, len(every))
        totals = counts[np.cumsum(lengths) - 1].astype(np.int64)
        sums = np.cumsum(totals) - totals
        first = np.cumsum([0, *map(len, found)])[:-1]
        sums -= np.repeat(sums[np.minimum(first, len(sums) - 1)], [*map(len, found)])  # every text counts from 0
        counts = counts + np.repeat(sums, lengths).astype(np.int32)
        out = np.split(counts, np.cumsum([len(x) for x in texts])[:-1])
        for text, own in zip(texts, out):
            # A prefix that ends inside white space has all of the white space as one piece.
            for gap in GAPS.finditer(text):
                a, b = gap.span()
                own[a:b] = (own[a - 1] if a else 0) + self.joined([gap[0]])
        return out

    def counts(self, text: str) -> np.ndarray:
        """int32 array: item i is the number of tokens of the first i + 1 characters.

        A special string is one token once it is complete; a part of it is ordinary text.
        """
        found = list(self.special_split.finditer(text)) if self.special_split else []
        out, base, at = [], 0, 0
        for special in found:
            a, b = special.span()
            part = self.ordinary([text[at:b - 1]])[0] + np.int32(base)
            base = (int(part[a - at - 1]) if a > at else base) + 1
            out += [part, np.array([base], np.int32)]
            at = b
        return np.concatenate([*out, self.ordinary([text[at:]])[0] + np.int32(base)])


    def many(self, texts: list[str]) -> list[np.ndarray]:
        """:meth:`counts` of each text."""
        special = [bool(self.special_split and self.special_split.search(x)) for x in texts]
        plain = iter(self.ordinary([x for x, odd in zip(texts, special) if not odd]))
        return [self.counts(x) if odd else next(plain) for x, odd in zip(texts, special)]


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, prefix_tokens) of every row: the number of tokens of each prefix of the whole text.

    ``tokenizer`` is the path of a byte-level BPE file that all executors have. ``prefix_tokens`` has one int per character, counted without begin, end
    or added tokens; empty for null or empty text. Counts may fall when a character completes a longer token. Other columns are ignored;
    repeated rows repeat.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in rows:
            for part in slices(batch, 2 << 20):
                texts = part.column("text")
                tables = own.many([x or "" for x in texts.to_pylist()])
                ends = np.cumsum([0, *map(len, tables)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tables) if tables else np.empty(0, np.int32)))
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, lists], names=["doc_id", "n_bytes", "prefix_tokens"])

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("prefix_tokens", T.ArrayType(T.IntegerType()))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def n_tokens(prefix_tokens: Column | str = "prefix_tokens") -> Column:
    """Tokens of the whole text."""
    table = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    return F.coalesce(F.try_element_at(table, F.lit(-1)), F.lit(0)).cast("long")


def tokens_of_prefix(n_chars: Column | int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the first ``n_chars`` characters; of the whole text if it is shorter."""
    n = n_chars if isinstance(n_chars, Column) else F.lit(n_chars)
    return F.when(n <= 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(F.col(prefix_tokens), F.least(n, F.size(prefix_tokens))), F.lit(0))).cast("long")


def chars_within(limit: int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Length in characters of the longest prefix with at most ``limit`` tokens."""
    table = F.col(prefix_tokens)
    fits = F.filter(F.sequence(F.lit(0), F.size(table)), lambda i: (i == 0) | (F.try_element_at(table, i) <= limit))
    return F.when(F.size(table) == 0, 0).otherwise(F.array_max(fits)).cast("long")
