"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweir.llm.common import saved

#: Fractional units that one reduction step combines.
FAN_IN = 64
#: Source tables up to this number of rows are broadcast; larger ones are joined by a shuffle.
#: Equal rows that one task writes.
TOGETHER = 10_000
MAX_BROADCAST = 100_000

UNIT = "struct<h: bigint, doc_id: bigint, size: bigint, copies: bigint, x: double>"


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.size(words).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in order of code points, null last, take the weights in turn, and share the sum of all sizes by weight. A target stops at
    ``cap`` times its source's size and what it leaves is shared by weight among the others, until none is above: the sources
    with the smallest cap per weight are capped, up to the first at which the rest fits.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size").cast("double"))
    line = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({
        "left": F.sum(F.col("source_size").cast("double")).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(after),
    })
    rows = rows.withColumn("level", F.col("left") / F.col("open"))
    # The level at the first source that is not capped holds for all that follow it.
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    level = F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), "level"))).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    return rows.withColumn("shared", level).select("source", "source_size", F.least("limit", F.coalesce(F.col("shared") * F.col("weight"), F.col("limit"))).alias("target"))


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the seed and the parts."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _pivot(state: Column, unit: Column, seed: int, level: int) -> Column:
    """One pivotal step between the unit that is still open and the next one.

    Mass moves so that the sum of size x copies stays, and each unit's expectation too, until one of both is integral: the first one gains
    until it is 1 or the other 0, or loses until it is 0 or the other 1, with odds that balance both moves.
    """
    a, b = state["open"], unit
    scale = b["size"] / a["size"]
    gain = F.least(1 - a["x"], b["x"] * scale)
    loss = F.least(a["x"], (1 - b["x"]) * scale)
    up = _uniform(seed, a["doc_id"], a["h"], b["doc_id"], b["h"], F.lit(level)) * (gain + loss) < loss
    first_ends = F.when(up, 1 - a["x"] <= b["x"] * scale).otherwise(a["x"] <= (1 - b["x"]) * scale)
    xa = F.when(first_ends, F.when(up, 1.0).otherwise(0.0)).otherwise(F.when(up, a["x"] + gain).otherwise(a["x"] - loss))
    xb = F.when(first_ends, F.when(up, b["x"] - gain / scale).otherwise(b["x"] + loss / scale)).otherwise(F.when(up, 0.0).otherwise(1.0))

    def put(u: Column, x: Column) -> Column:
        return F.struct(u["h"].alias("h"), u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["copies"].alias("copies"), x.alias("x"))

    pivoted = F.when(first_ends, F.struct(put(b, F.least(F.greatest(xb, F.lit(0.0)), F.lit(1.0))).alias("open"), put(a, xa).alias("done")))
    pivoted = pivoted.otherwise(F.struct(put(a, F.least(F.greatest(xa, F.lit(0.0)), F.lit(1.0))).alias("open"), put(b, xb).alias("done")))
    whole = (a["x"] <= 0) | (a["x"] >= 1)
    step = F.when(whole, F.struct(b.alias("open"), put(a, a["x"]).alias("done"))).otherwise(pivoted)
    return F.struct(step["open"].alias("open"), F.concat(state["done"], F.array(step["done"])).alias("done"))


def round_units(units: DataFrame, largest: int, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """(source, h, doc_id, size, copies, x) with x 0 or 1, from units (source, n, h, doc_id, size, copies, x) with x between 0 and 1.

    A tree of pivotal steps: every source's units are dealt to groups of about ``fan_in`` by hash, each group
    keeps one open unit, and the open units go to the next level, until a source has one group; its last open unit
    is drawn. ``n`` is the number of units of the source and ``largest`` its maximum: they fix the groups of all levels
    in advance. No group grows with the data, so a hot source only has more groups.
    """
    done, open_units, level, most = [], units, 0, max(1, largest)
    while True:
        groups = F.ceil(F.col("n") / fan_in)
        dealt = open_units.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "h", "doc_id", "size"), groups))
        entry = F.struct("h", "doc_id", "size", "copies", "x")
        lists = dealt.groupBy("source", "g").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("list"))
        start = F.struct(F.col("list")[0].alias("open"), F.expr(f"cast(array() as array<{UNIT}>)").alias("done"))
        merged = F.aggregate(F.slice("list", 2, F.size("list")), start, lambda s, u: _pivot(s, u, seed, level))
        after = saved(lists.select("source", F.ceil(F.col("n") / fan_in).alias("n"), merged.alias("m")), "mix-level")
        done.append(after.select("source", F.inline("m.done")))
        open_units = after.select("source", "n", "m.open.*")
        level, most = level + 1, -(-most // fan_in)
        if most <= 1:
            break
    last = _uniform(seed, F.col("doc_id"), F.col("h"), F.lit("last")) < F.col("x")
    done.append(open_units.select("source", "h", "doc_id", "size", "copies", F.when(last, 1.0).otherwise(0.0).alias("x")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def draws(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 7) -> DataFrame:
    """(source, doc_id, size, text_hash, rows, source_size, target, copies): one row for all rows of one source, id and text, and how often each is taken.

    The size is the number of words. A document stands for target / source_size copies: the whole part is taken, the rest is rounded by
    :func:`round_units`, which keeps each source's sum of sizes, so that it misses its target by less than its largest unit. Copies never
    exceed ``cap``. Texts that are null or without words have size 0 and no copies. Rows of one source, id and text share one draw, whose unit is
    as large as all of them; rows without an id, or of one id, whose texts differ are drawn apart. Null ids and sources are values like others. Every draw is a hash, so reruns agree.
    Texts are read once and never shuffled; other columns are ignored.
    """
    each = docs.select("source", "doc_id", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = saved(each.groupBy("source", "doc_id", "size", "text_hash").agg(F.count("*").alias("rows")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    goal = saved(targets(sizes, weights, cap).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    count, largest = goal.agg(F.count("*"), F.max("n")).first()
    goal = F.broadcast(goal) if count <= MAX_BROADCAST else goal
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    known = rows.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("ratio", ratio)
    known = known.withColumn("base", F.floor("ratio")).withColumn("x", F.col("ratio") - F.col("base"))
    units = known.filter((F.col("size") > 0) & (F.col("x") > 0)).select(
        "source", "n", F.xxhash64("source", "doc_id", "size", "text_hash").alias("h"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.col("size") * F.col("rows")).alias("size"), F.col("rows").alias("copies"), "x",
    )
    drawn = round_units(units, largest or 1, seed).select(
        F.col("source").alias("s"), F.col("doc_id").alias("d"), F.expr("size div copies").alias("z"), "h", F.col("x").cast("long").alias("more"),
    )
    known = known.withColumn("own", F.xxhash64("source", "doc_id", "size", "text_hash"))
    same = (F.col("own") == F.col("h")) & F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    copies = F.when(F.col("size") > 0, F.col("base") + F.coalesce("more", F.lit(0))).otherwise(0).cast("long")
    return known.join(drawn, same, "left").select("source", "doc_id", "size", "text_hash", "rows", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row, by :func:`draws`; taken = copies x size."""
    drawn = draws(docs, weights, cap, seed)
    # Very many equal rows are one row until here: they come back in parts that different tasks write.
    parts = drawn.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(rows - 1) div {TOGETHER}")))).repartition("doc_id", "text_hash", "part")
    each = parts.withColumn("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(TOGETHER).cast("long"), F.col("rows") - F.col("part") * TOGETHER))))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def taken(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix itself, with the columns of ``docs`` (doc_id, source and text among them), each as often as it is taken."""
    copies = draws(docs, **settings).filter("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("s"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    return rows.join(copies, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
