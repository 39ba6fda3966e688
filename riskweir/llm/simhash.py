"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from riskweir.llm.common import as_bytes, cut, pieces, saved

SEED = 42
BLOCK = 1 << 16


def simhash(data: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes; 0 without words."""
    words = (data or b"").lower().split()  # bytes: lower-cases A-Z alone and splits at ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:at + BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., fp): the signed 64-bit form of the fingerprint of each whole text."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in pieces(batch):
                found = np.fromiter((simhash(x, shingle) for x in as_bytes(part.column("text"))), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found.view(np.int64))], names=[*keep, "fp"])

    schema = docs.select(*keep).schema.add("fp", "long")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def ball(fp: Column, radius: int) -> Column:
    """Array of all 64-bit values within ``radius`` bits of ``fp``; 65 values for 1, 2081 for 2."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in signed)), lambda mask: fp.bitwiseXOR(mask))


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints whose components are those of all links within ``radius``.

    Two fingerprints are within an even radius exactly if the balls of half of it around them meet. Every value of every ball is
    shuffled; fingerprints that share one are all within the radius of each other, so each is linked to the smallest of them
    instead of listing all pairs. A value has at most as many fingerprints as a ball has values, however
    many copies there are. Colliding pairs are deduplicated and their distance is verified.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even, so that both sides emit the same ball")
    near = distinct.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("variant"))
    joint = near.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    found = joint.filter("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b), a > b: root is the smallest node of the component.

    Alternates two star steps until nothing moves: every node's larger neighbours, then its smaller ones, are linked to the smallest
    node around it. The number of rounds follows the logarithm of the graph, and only minima and joins by node are used,
    so a node with very many links is aggregated before its shuffle and split by the skew join.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low"))

    state, edges = None, cut(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = smallest(both).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = smallest(down)
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).filter("a != b").union(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        state = now


def classes(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id that links reach, its own included.

    Texts that are null or have no word have fingerprint 0 and link like any other. Texts are never shuffled: exact copies meet as
    equal fingerprints, which are reduced to one row with the smallest id before anything else.
    A null doc_id is never a component's name unless no row of the component has an id. Repeated rows repeat.
    Other columns are ignored.
    """
    prints = saved(fingerprints(docs, shingle), "simhash")
    label = firsts(prints, F.col("doc_id"), radius)
    joined = prints.join(label, prints.fp == label.same, "left")
    return joined.select("doc_id", "fp", F.coalesce("first", "doc_id").alias("component_id"))


def firsts(prints: DataFrame, order: Column, radius: int) -> DataFrame:
    """(same, first): for each fingerprint of more than one row or with a link, the smallest ``order`` of the rows of its component."""
    distinct = prints.groupBy("fp").agg(F.min(order).alias("own"), F.count("*").alias("n"))
    roots = components(links(distinct.select("fp"), radius))
    grouped = distinct.join(roots, distinct.fp == roots.node, "left").filter("n > 1 or root is not null")
    grouped = saved(grouped.select("fp", "own", F.coalesce("root", "fp").alias("root")), "simhash-groups")
    least = grouped.groupBy("root").agg(F.min("own").alias("first"))
    return grouped.join(least, "root").select(F.col("fp").alias("same"), "first")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component of :func:`classes`: the one with the smallest doc_id, null last, then by hash of the row.

    Rows are told apart by 128 bits of hash over all columns, so rows that share an id, or have none, but differ anywhere are different
    rows; of rows that are equal throughout one stays. Texts without a word are one component. The columns stay as they are.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = [*names, *(c.isNull() for c in names)]  # nulls leave a hash as it is
    keys = {"__one": F.xxhash64(F.lit(1), *marked), "__two": F.xxhash64(F.lit(2), *marked)}
    keyed = docs.select(*names, *(c.alias(k) for k, c in keys.items()))
    prints = saved(fingerprints(keyed, shingle, ("doc_id", "__one", "__two")), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__one", "__two")
    label = firsts(prints, order, radius)
    gone = prints.join(label, prints.fp == label.same).filter(order != F.col("first")).select(F.col("__one").alias("a"), F.col("__two").alias("b")).distinct()
    # A row that is equal to the one that stays is not among the rows that go: of those, one is kept here.
    kept = keyed.join(gone, (F.col("__one") == F.col("a")) & (F.col("__two") == F.col("b")), "left_anti")
    return kept.dropDuplicates(["__one", "__two"]).select(*names)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
