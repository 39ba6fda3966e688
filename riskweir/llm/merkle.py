"""A manifest of a dataset as a Merkle tree: a subtree per language, one root, and a proof for every document.

A node carries the interval [lo, hi) of leaf ranks that it covers. Levels are stored one by one, each with the intervals and digests of its
runs of children. Proofs come from the top down: a node is contained in exactly one interval of the level above, found in the bucket
of that level (rank divided by its width); its siblings are what the parent's interval holds without the node's own. All steps are joins and
aggregates over (tree, bucket), so no tree, however large, is ever in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from riskweir.llm.common import saved
from riskweir.llm.ranks import with_rank

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that are ranked together, and the largest number of ranges that ids are cut into.
RANGE_ROWS, MOST_RANGES = 10_000, 4096
STEPS = "array<struct<before string, after string>>"
_DIGITS = 16 ** 3


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of UTF-8 text."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a document with that text."""
    return digest(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)))


def tree_of(lang: Column) -> Column:
    """Name of a language's tree; null has one too, and names sort like languages by their bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def _id_buckets(leaves: DataFrame, n: int) -> tuple[list[int], Column]:
    """Edges of ranges of ids, and a number that never falls along (doc_id, leaf), null ids first, and spreads rows evenly also if one id has a third of them."""
    parts = min(MOST_RANGES, n // RANGE_ROWS + 1)
    edges = []
    if parts > 1:
        edges = leaves.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * MOST_RANGES)).first()[0] or []
    edges = sorted({float(x): x for x in reversed(edges)}.values())  # one for each double: the search below compares doubles
    # Twice the number of the range, one less below its first id (doubles are coarser than ids), one more above it.
    cell, single, unnamed = F.lit(1), F.lit(False), F.col("doc_id").isNull()
    if edges:
        place = F.col("__cell").cast("int")
        first = F.get(F.array(*(F.lit(x) for x in edges)), place - 1)
        single = F.coalesce(F.col("doc_id") == first, F.lit(False))
        cell = F.when(place == 0, 1).otherwise(2 * place + (F.col("doc_id") > first).cast("int") - (F.col("doc_id") < first).cast("int"))
    # Rows of a single id, or of none, are cut by the leaf.
    part = F.when(unnamed | single, F.conv(F.substring("leaf", 1, 3), 16, 10).cast("long")).otherwise(0)
    return edges, F.when(unnamed, 0).otherwise(cell).cast("long") * _DIGITS + part


def ranked(leaves: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, other, at): rank of each leaf in its tree by doc_id, null first, then by leaf."""
    edges, bucket = _id_buckets(leaves, leaves.count())
    rows = leaves
    if edges:
        found = Bucketizer(splits=[float("-inf"), *map(float, edges), float("inf")], inputCol="__id", outputCol="__cell")
        rows = found.transform(rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    return with_rank(rows, "tree", bucket, order, "at").select("tree", "doc_id", "leaf", "other", "at")


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Stored levels above (tree, at, h): (tree, n, lo, hi, runs, h), a row per node. ``runs`` has the children (lo, hi, h) in order, ``n`` is the
    number of nodes that the tree has on this level. A tree of one leaf has one node on the first level, the leaf itself."""
    below = leaves.select("tree", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "h")
    out, width = [], 1
    while True:
        width *= fanout
        level = below.groupBy("tree", F.expr(f"lo div {width}").alias("bucket")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi", "h"))).alias("runs"), *([F.max("n").alias("n")] if out else []),
        )
        level = level.withColumns({"lo": F.col("runs")[0]["lo"], "hi": F.element_at("runs", -1)["hi"]})
        if not out:  # the number of leaves of a tree is where its last run ends
            level = saved(level, "merkle-runs")
            level = level.join(level.groupBy("tree").agg(F.max("hi").alias("n")), "tree")
        joined = F.when(F.col("n") == 1, F.col("runs")[0]["h"]).otherwise(digest(F.concat_ws("", F.col("runs.h"))))
        level = level.select("tree", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), "lo", "hi", "runs", joined.alias("h"))
        out.append(saved(level, "merkle-level"))
        if (out[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return out
        below = out[-1].filter("n > 1").select("tree", "lo", "hi", "h", "n")


def tops(stored: list[DataFrame]) -> DataFrame:
    """(tree, top): the last digest of each tree."""
    return reduce(DataFrame.union, [level.filter("n = 1").select("tree", F.col("h").alias("top")) for level in stored])


def _step(runs: str, lo: str) -> Column:
    """Siblings before and after the child that begins at ``lo``: the parent's interval without the child's."""
    def side(pick) -> Column:
        return F.concat_ws("", F.transform(F.filter(F.col(runs), pick), lambda r: r["h"]))

    return F.struct(side(lambda r: r["lo"] < F.col(lo)).alias("before"), side(lambda r: r["lo"] > F.col(lo)).alias("after"))


def paths(stored: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The rows of the first level with ``steps``, the siblings from each node up to the end of ``above``.

    ``above`` has a row (tree, steps, ...) for each tree: what comes after its top. Its other columns go down with the steps.
    """
    known = None
    extra = [c for c in above.columns if c not in ("tree", "steps")]
    for k in range(len(stored), 0, -1):
        here = stored[k - 1].select("tree", "n", "lo", "hi", "runs")
        now = here.filter("n = 1").join(above, "tree").select("tree", "lo", "hi", "runs", "steps", *extra)
        if known is not None:
            width = fanout ** (k + 1)
            up = known.select(F.col("tree").alias("__tree"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("runs").alias("__runs"), F.col("steps").alias("__steps"), *extra)
            inside = (F.col("tree") == F.col("__tree")) & (F.expr(f"lo div {width}") == F.expr(f"__lo div {width}")) & (F.col("lo") >= F.col("__lo")) & (F.col("hi") <= F.col("__hi"))
            lower = here.filter("n > 1").join(up, inside)
            steps = F.concat(F.array(_step("__runs", "lo")), "__steps")
            now = now.union(lower.select("tree", "lo", "hi", "runs", steps.alias("steps"), *extra))
        known = now
    return known


def leaf_paths(leaves: DataFrame, stored: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves (tree, at, ...) with all ``steps`` to the root and the other columns of ``above``."""
    up = paths(stored, above, fanout)
    extra = [c for c in above.columns if c not in ("tree", "steps")]
    up = up.select(F.col("tree").alias("__tree"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("runs").alias("__runs"), F.col("steps").alias("__steps"), *extra)
    inside = (F.col("tree") == F.col("__tree")) & (F.expr(f"at div {fanout}") == F.expr(f"__lo div {fanout}")) & (F.col("at") >= F.col("__lo")) & (F.col("at") < F.col("__hi"))
    lone = (F.col("__lo") == 0) & (F.size("__runs") == 1)  # a tree of one leaf, which is its own top
    steps = F.when(lone, F.col("__steps")).otherwise(F.concat(F.array(_step("__runs", "at")), "__steps"))
    return leaves.join(up, inside).select(*leaves.columns, steps.alias("steps"), *extra)


def siblings(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.concat_ws("", F.transform(steps, lambda s: F.concat(s["before"], s["after"])))


def fold(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def manifest(docs: DataFrame, tampered: Column, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Where ``tampered`` is true, the leaf that the proof is checked with has the A-Z of its text lower-cased. Leaves are ordered by doc_id within
    their language, null ids first, rows of one id by their digest; identical rows have one leaf and take neighbouring places. Null
    fields have a form of their own, so a null text differs from an empty one. An empty table gives no rows; other columns are ignored.
    """
    text = F.col("text")
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf(F.translate(text, UPPER, LOWER)))
    leaves = saved(docs.select(tree_of(F.col("lang")).alias("tree"), "doc_id", leaf(text).alias("leaf"), other.alias("other")), "merkle-leaves")
    placed = saved(ranked(leaves), "merkle-ranks")
    stored = levels(placed.select("tree", "at", F.col("leaf").alias("h")), fanout)
    below = saved(tops(stored), "merkle-subroots")
    start = F.rpad(F.hex(F.substring(F.col("tree").cast("binary"), 1, 2)), 4, "0")
    trees = with_rank(below, None, F.conv(start, 16, 10).cast("long"), [F.col("tree")], "at")
    trees = saved(trees.select(F.lit("all").alias("tree"), "at", F.col("top").alias("h"), F.col("tree").alias("name")), "merkle-trees")
    upper = levels(trees, fanout)
    none = F.array().cast(STEPS)
    last = tops(upper).select("tree", none.alias("steps"), F.col("top").alias("root"))
    above = leaf_paths(trees, upper, last, fanout).select(F.col("name").alias("tree"), "steps", F.col("h").alias("subroot"), "root")
    above = saved(above, "merkle-above")
    found = leaf_paths(placed, stored, above, fanout)
    folded = fold(F.coalesce("other", "leaf"), F.col("steps"))
    found = found.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("steps"))).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
