"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweir.llm.common import batches, pieces

UNKNOWN = "und"
#: The matrix has one row per language; more values than this in the language column are a data error.
MAX_LANGUAGES = 256


@dataclass(frozen=True)
class Model:
    """languages: sorted. log_prob: (buckets, languages), log P(n-gram bucket | language). prior: log P(language)."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    prior: np.ndarray
    sizes: tuple[int, ...]


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case if it is a letter, else a space; and whether it is a letter."""
    to, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            to[point], letter[point] = ord(low) if len(low) == 1 else point, True
    return to, letter


def ngram_counts(text: str, sizes: tuple[int, ...], buckets: int, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with n-grams of the whole text, and their counts. Empty if the text has no letter.

    Letters are lower-cased and every run of other characters is one space, with a space at both ends.
    The text is taken in chunks that overlap by the longest n-gram, so memory doesn't follow its length.
    """
    to, letter = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[points].any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    chars = to[np.r_[np.uint32(32), points, np.uint32(32)]]
    chars = chars[np.r_[True, (chars[1:] != 32) | (chars[:-1] != 32)]].astype(np.uint64)
    total, longest = np.zeros(buckets, np.int64), max(sizes)
    for at in range(0, len(chars), chunk):
        part = chars[at:at + chunk + longest - 1]
        for size in sizes:
            n = min(chunk, len(part) - size + 1)
            if n <= 0:
                continue
            key = np.full(n, size, np.uint64)
            for k in range(size):
                key = (key ^ part[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            total += np.bincount((key % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]


def fit(docs: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 14, smoothing: float = 0.5) -> Model:
    """Counts n-grams of all given (text, lang) rows; rows without a language, text or letter don't count.

    Every task sums its rows to one count per language and bucket, so the shuffle carries at most
    languages x buckets rows per task however the languages are spread. The driver gets the summed matrix,
    of at most MAX_LANGUAGES x buckets numbers.
    """
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches(rows):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                at, n = ngram_counts(text, sizes, buckets)
                if len(at):
                    own = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    own[at] += n
                    own[buckets] += 1
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": own[at]})

    known = docs.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.limit(MAX_LANGUAGES * (buckets + 1) + 1).toArrow()
    if found.num_rows > MAX_LANGUAGES * (buckets + 1):
        raise ValueError(f"more than {MAX_LANGUAGES} languages among the labels")
    languages = tuple(sorted(set(found.column("lang").to_pylist())))
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((buckets + 1, len(languages)))
    table[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    grams, n_docs = table[:buckets], table[buckets]
    log_prob = np.log(grams + smoothing) - np.log(grams.sum(0) + smoothing * buckets)
    return Model(languages, log_prob, np.log(n_docs / max(1, n_docs.sum())), sizes)


def score(model: Model, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Posterior P(language | text) of a batch: its sparse count matrix times the log-probability matrix."""
    ends = np.cumsum([len(at) for at, _ in counts])
    joint = np.tile(model.prior, (len(counts), 1))
    if ends[-1]:
        terms = np.concatenate([n for _, n in counts])[:, None] * model.log_prob[np.concatenate([at for at, _ in counts])]
        full = [i for i, (at, _) in enumerate(counts) if len(at)]
        joint[full] += np.add.reduceat(terms, [ends[i] - len(counts[i][0]) for i in full], axis=0)
    joint = np.exp(joint - joint.max(1, keepdims=True))
    return joint / joint.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., lang_pred, score) of every row, from its whole text alone.

    ``score`` is the posterior probability of the predicted language. A text that is null, empty or without any letter,
    or a model without languages, gives ``und`` with score 0. Ties go to the language that sorts first.
    Columns of the input other than ``keep`` and ``text`` are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # The text goes to the workers once, among the kept columns or behind them.
    at = keep.index("text") if "text" in keep else len(keep)
    sent = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        buckets = len(model.log_prob)
        for batch in rows:
            for part in pieces(batch, 1 << 20, at):
                counts = [ngram_counts(x, model.sizes, buckets) if x else (np.empty(0, np.int64),) * 2 for x in part.column(at).to_pylist()]
                if model.languages:
                    post = score(model, counts)
                    best = post.argmax(1)
                    told = [model.languages[b] if len(c[0]) else UNKNOWN for b, c in zip(best, counts)]
                    sure = [float(p[b]) if len(c[0]) else 0.0 for p, b, c in zip(post, best, counts)]
                else:
                    told, sure = [UNKNOWN] * len(counts), [0.0] * len(counts)
                own = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(told, pa.string()), pa.array(sure, pa.float64())], names=schema.names)

    return sent.mapInArrow(run, schema)


def identify(docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",), **settings) -> DataFrame:
    """Fit on the labelled rows of ``training`` and predict every row of ``docs``."""
    return predict(docs, fit(training, **settings), keep)
