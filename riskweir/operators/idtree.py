"""Fingerprint trees over id sets: two sets are compared from the root down, and only ranges that differ are read.

Ids lie in ranges by the first hexadecimal digits of their SHA-256. A leaf's digest is the SHA-256 of its ids' hashes in order, each with the number of its rows;
a node's is that of its children's digests. Equal digests mean equal sets, short of a SHA-256 collision, unlike sums of hash pieces. A tree
of n ids has about n / RANGE_IDS leaves, so it is some thousand times smaller than the ids beside it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweir.functions.coerce import trimmed_id
from riskweir.schema import ID

#: Ids of a leaf, about; a leaf's hashes are put together in one row.
RANGE_IDS = 4096
MOST_DIGITS = 7
#: Digits that folders of stored ids are named by.
FOLDER_DIGITS = 2


@dataclass(frozen=True)
class IdTree:
    """A stored tree: ``ids`` (folder, h, id, n) in folders by the first digits of the hash, ``nodes`` (level, prefix, n, digest)."""

    path: str
    digits: int

    def ids(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("h string, id string, n bigint, folder string").parquet(f"{self.path}/ids")

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("prefix string, n bigint, digest string, level int").parquet(f"{self.path}/nodes")

    def root(self, spark: SparkSession) -> tuple[int, str]:
        """Number of rows and digest of the whole set."""
        row = self.nodes(spark).filter("level = 0").first()
        return (row["n"], row["digest"]) if row else (0, "")


def build(df: DataFrame, path: str, key: str = ID, digits: int | None = None) -> IdTree:
    """Stores the tree of the ids in ``key``, cut as everywhere here; rows of one id are counted, before anything is shuffled, and null ids are one id of their own.

    ``digits`` fixes the ranges; trees that are to be compared need the same. Without it, it follows the number of ids.
    """
    spark = df.sparkSession
    name = trimmed_id(F.col(key))
    counted = df.select(name.alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    hashed = counted.select(F.coalesce(F.sha2(F.concat(F.lit("="), "id"), 256), F.sha2(F.lit(""), 256)).alias("h"), "id", "n")
    rows = hashed.withColumn("folder", F.substring("h", 1, FOLDER_DIGITS))
    rows.repartition("folder").sortWithinPartitions("folder", "h").write.partitionBy("folder").parquet(f"{path}/ids")
    stored = IdTree(path, 0).ids(spark)
    if digits is None:
        digits, n = 0, stored.count()
        while n > RANGE_IDS * 16 ** digits and digits < MOST_DIGITS:
            digits += 1
    tree = IdTree(path, digits)
    each = F.concat_ws(":", "h", F.col("n").cast("string"))
    level = stored.groupBy(F.substring("h", 1, digits).alias("prefix")).agg(F.sort_array(F.collect_list(each)).alias("parts"), F.sum("n").alias("n"))
    for depth in range(digits, -1, -1):
        nodes = level.select("prefix", "n", F.sha2(F.concat_ws(";", "parts"), 256).alias("digest"))
        nodes.write.parquet(f"{path}/nodes/level={depth}")
        below = spark.read.parquet(f"{path}/nodes/level={depth}")
        part = F.struct("prefix", "digest")  # sixteen children at most
        level = below.groupBy(F.substring("prefix", 1, depth - 1).alias("prefix")).agg(
            F.transform(F.sort_array(F.collect_list(part)), lambda c: F.concat_ws(":", c["prefix"], c["digest"])).alias("parts"), F.sum("n").alias("n")) if depth else below
    spark.createDataFrame([(json.dumps({"digits": digits}),)], "value string").coalesce(1).write.text(f"{path}/about")
    return tree


def load(spark: SparkSession, path: str) -> IdTree:
    return IdTree(path, json.loads(spark.read.text(f"{path}/about", wholetext=True).first()["value"])["digits"])


def differing(spark: SparkSession, a: IdTree, b: IdTree) -> DataFrame:
    """(prefix) of the leaves that differ, found level by level: only children of nodes that differ are looked at."""
    if a.digits != b.digits:
        raise ValueError(f"trees of {a.digits} and {b.digits} digits have different ranges")
    open_ = spark.createDataFrame([("",)], "prefix string")
    for depth in range(a.digits + 1):
        sides = []
        for tree, name in ((a, "left"), (b, "right")):
            own = tree.nodes(spark).filter(F.col("level") == depth).withColumn("_above", F.substring("prefix", 1, max(0, depth - 1)))
            sides.append(own.join(open_.withColumnRenamed("prefix", "_above"), "_above", "left_semi").select("prefix", F.col("digest").alias(name)))
        both = sides[0].join(sides[1], "prefix", "full_outer")
        open_ = both.filter(~F.col("left").eqNullSafe(F.col("right"))).select("prefix")
    return open_


def difference(spark: SparkSession, a: IdTree, b: IdTree) -> DataFrame:
    """(id, n_left, n_right) of the ids whose rows differ in number; ids are read from the ranges that differ alone, equal sets read none.

    The ranges that differ go to both sides as a small table of names; folders that none of them lies in are not opened.
    """
    ranges = differing(spark, a, b)
    folders = [r["f"] for r in ranges.select(F.substring("prefix", 1, FOLDER_DIGITS).alias("f")).distinct().collect()]  # 256 at most
    short = [f for f in folders if len(f) < FOLDER_DIGITS]

    def side(tree: IdTree, name: str) -> DataFrame:
        rows = tree.ids(spark)
        near = F.col("folder").isin(folders) if not short else F.substring("folder", 1, len(short[0])).isin(short)
        rows = rows.filter(near if folders else F.lit(False))
        inside = rows.withColumn("prefix", F.substring("h", 1, tree.digits)).join(ranges, "prefix", "left_semi")
        return inside.select("h", F.col("id").alias(f"id_{name}"), F.col("n").alias(f"n_{name}"))

    both = side(a, "left").join(side(b, "right"), "h", "full_outer")
    counted = both.select(F.coalesce("id_left", "id_right").alias("id"), *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in ("left", "right")])
    return counted.filter("n_left <> n_right")
