"""Column access, Arrow batches as bytes, word hashing, and intermediate tables shared by the text operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweir.session import scratch, shared_dir

#: ASCII white space, the only separator of words. ``bytes.split()`` splits on the same six characters.
WHITE = r"[\x20\x09-\x0D]"
#: Bytes of text hashed at once by :func:`hash_words`.
CHUNK = 1 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    # Workers find the package beside the driver's unless the cluster has it installed or gets it with --py-files.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(modulus: int, fold: int, key: str = "doc_id") -> Column:
    """True where the CRC-32 of the id, written as text, leaves that remainder. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == fold


def saved(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there and lost executors cost nothing.

    The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to any more, which Spark would do at its next garbage collection."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)  # objects of the JVM are let go in the background
        spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder; for small frames of iterative jobs."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def pieces(batch: pa.RecordBatch, size: int = 4 << 20, column: str | int = "text", rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text and ``rows`` rows each, one row at least."""
    data = batch.column(column)
    ends = np.cumsum(np.nan_to_num(pc.binary_length(data).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + size, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.binary()).to_pylist()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array with the offsets of its rows; a null has no bytes."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


@lru_cache(4)
def _tables(separators: bytes, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte (A-Z as a-z), separator flags, powers of an odd base and of its inverse mod 2^64."""
    values = np.random.default_rng(20240517 + salt).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    white = np.zeros(256, bool)
    white[list(separators)] = True
    base = 0x9E3779B97F4A7C15
    up = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, base, np.uint64)], dtype=np.uint64)
    down = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, pow(base, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    return values, white, up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, offsets: np.ndarray, separators: bytes = b"\t\n\x0b\f\r ", salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased), the byte where each begins, and the first word of each row.

    The hash is a polynomial in an odd base over random byte values, taken from running sums, so that no
    step runs per word. Texts are read in chunks cut at row ends or between words; only a single word longer than
    a chunk is hashed on its own.
    """
    values, white, up, down = _tables(separators, salt)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~white[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    ends = np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + CHUNK, "right")))
        if ends[j - 1] - at <= CHUNK:
            sums = np.zeros(ends[j - 1] - at + 1, np.uint64)
            np.cumsum(values[data[at:ends[j - 1]]] * up[:len(sums) - 1], out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        else:
            out[i] = mix(np.array([_long(data[at:ends[i]], values, up)], np.uint64))[0]
        i = j
    return out, starts, np.searchsorted(starts, offsets)


def _long(word: np.ndarray, values: np.ndarray, up: np.ndarray) -> int:
    total, scale = 0, 1
    for at in range(0, len(word), CHUNK):
        part = word[at:at + CHUNK]
        total += scale * int(np.sum(values[part] * up[:len(part)], dtype=np.uint64))
        scale = scale * pow(int(up[1]), len(part), 1 << 64) % (1 << 64)
    return (total + len(word)) % (1 << 64)


def kgrams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all windows of ``k`` word hashes, and whether each lies within one row."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for t in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[t:t + n]
    inside = np.ones(len(words), bool)
    for t in range(1, k):
        inside[np.maximum(first[1:] - t, 0)[first[1:] >= t]] = False
    return out, inside[:n]


def batches(rows: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        yield from pieces(batch, size)
