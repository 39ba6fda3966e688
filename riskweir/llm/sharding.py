"""Shards that all match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweir.llm.common import saved
from riskweir.llm.ranks import with_rank

LAW = "rows"


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary"))


def _top(digest: Column, bits: int = 32) -> Column:
    """The first 32 bits of a hexadecimal digest as a number, or its first ``bits``."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / (1 << (32 - bits)))


def assign(docs: DataFrame, n_shards: int = 24, seed: str = "shards", rows_per_bucket: int = 10_000) -> DataFrame:
    """(doc_id, source, size, text_crc32, position, shard, slot) of every row.

    Rows are shuffled within their source by a seeded hash of the id and ranked; the rank as a fraction of the source places each
    row on a common line, which is cut into shards whose row counts differ by one at most. A source's ranks start at a
    seeded part of one step, so that sources of one row each are spread as well. Only narrow rows are shuffled, and each
    is ranked in a bucket of about ``rows_per_bucket`` rows, so neither a hot source nor the whole line is ever sorted in one task.
    Identical rows are interchangeable and take places next to each other; rows without an id are shuffled by their text. A null text has no
    bytes (size 8, CRC-32 0), a null source is a source. Slots run from 0 without gaps. Other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("text_crc32").cast("string")))
    rows = saved(rows.withColumn("__key", _key(seed, named)), "shards")  # both counts and ranks read it; texts are read once
    n = rows.count()
    bits = max(0, min(32, (max(1, n // rows_per_bucket) - 1).bit_length()))
    # Sources are few rows with counts; AQE broadcasts them if they are as small as they should be.
    totals = rows.groupBy(F.col("source").alias("__source")).agg(F.count("*").alias("__total"))
    totals = totals.withColumn("__start", (_top(_key(seed, "start", F.coalesce("__source", F.lit("")))) + 0.5) / float(1 << 32))
    tie = [F.col(c) for c in ("__key", "doc_id", "text_crc32", "size")]
    ranked = with_rank(rows, "source", _top(F.col("__key"), bits), tie, "__rank")
    ranked = ranked.join(F.broadcast(totals) if _few(totals) else totals, F.col("source").eqNullSafe(F.col("__source")))
    line = ranked.withColumn("__at", (F.col("__rank") + F.col("__start")) / F.col("__total"))
    buckets = 1 << bits
    order = [F.col("__at"), F.col("source").asc_nulls_last(), F.col("__rank")]
    placed = with_rank(line, None, F.least(F.floor(F.col("__at") * buckets), F.lit(buckets - 1)), order, "position")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", "position",
        F.expr(f"cast((position * {n_shards}) div {max(1, n)} as int)").alias("shard"),
    ).withColumn("slot", F.expr(f"position - ((cast(shard as long) * {n} + {n_shards - 1}) div {n_shards})"))


#: Sources up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000


def _few(table: DataFrame) -> bool:
    return table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
