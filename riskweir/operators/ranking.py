"""Exact ranks, cuts, running totals and quantiles without a single-partition sort.

Three building blocks:

* ``seeded_hash`` orders rows by a hash of their id. Hashes of unique ids are uniform, so hash prefixes
  are balanced buckets.
* ``running_totals`` gives running sums over the distinct values of a histogram. Equal values are merged
  before, and the bucket edges are quantiles of the data, so no bucket can hold more than its share
  however the values cluster.
* ``exact_quantiles`` locates the bucket of a rank first and only orders the rows of that bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweir.functions.coerce import stripped

PREFIX = 4  # hex digits of the hash used as bucket: 65,536 buckets


def seeded_hash(key: Column | str, seed: int | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), stripped(key.cast("string"))), 256)


def prefix_counts(keyed: DataFrame, stratum: str, hashed: str) -> DataFrame:
    """(stratum, prefix, n): at most 65,536 rows per stratum leave the map side."""
    return keyed.groupBy(stratum, F.substring(hashed, 1, PREFIX).alias("prefix")).agg(F.count("*").alias("n"))


def hash_cuts(keyed: DataFrame, counts: DataFrame, stratum: str, hashed: str, ranks: dict[int, list[int]]) -> dict[int, list[str]]:
    """Hash values found at the wanted 1-based ranks of each stratum; a rank of 0 gives the empty string.

    ``counts`` (from :func:`prefix_counts`) tells which prefix holds a rank. Only the rows of those
    prefixes, 1/65,536 of a stratum each, are then ordered. The driver sees one value per cut.
    """
    spark = keyed.sparkSession
    wanted = spark.createDataFrame(
        [(s, pos, rank) for s, some in ranks.items() for pos, rank in enumerate(some) if rank > 0],
        f"{stratum} int, pos int, rank bigint",
    )
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(stratum).orderBy("prefix")))
    # `wanted` holds strata x cuts rows.
    hits = upto.join(F.broadcast(wanted), stratum).filter(
        (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
    ).select(stratum, "prefix", "pos", (F.col("rank") - F.col("upto") + F.col("n")).alias("local")).collect()
    cuts = {s: [""] * len(some) for s, some in ranks.items()}
    if not hits:
        return cuts
    prefix = F.substring(hashed, 1, PREFIX)
    # One look-up per row, so that the pushed-down filter computes the hash once.
    place = F.concat_ws(":", F.col(stratum).cast("string"), prefix)
    rows = keyed.filter(place.isin(sorted({f"{h[stratum]}:{h['prefix']}" for h in hits})))
    order = Window.partitionBy(stratum, prefix).orderBy(hashed)
    ranked = rows.withColumn("local", F.row_number().over(order))
    chosen = reduce(Column.__or__, [
        (F.col(stratum) == h[stratum]) & (prefix == h["prefix"]) & (F.col("local") == h["local"]) for h in hits
    ])
    values = {(r[stratum], r[hashed][:PREFIX], r["local"]): r[hashed] for r in ranked.filter(chosen).collect()}
    for h in hits:
        cuts[h[stratum]][h["pos"]] = values[h[stratum], h["prefix"], h["local"]]
    return cuts


def hash_rank(df: DataFrame, key: str, seed: int | str, strata: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Exact 0-based rank by seeded hash inside each stratum; one balanced shuffle by hash prefix.

    Keys are unique ids, so prefixes are balanced. The offsets table has one row per (stratum, prefix).
    """
    keyed = df.withColumns({"_h": seeded_hash(key, seed)}).withColumn("_p", F.substring("_h", 1, PREFIX))
    by = [*strata, "_p"]
    counts = keyed.groupBy(*by).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(1))
    offsets = counts.withColumn("_off", F.sum("_n").over(order.orderBy("_p")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*by).orderBy("_h", key)) - 1
    return keyed.withColumn("_l", local).join(offsets, by).withColumn(out, F.col("_off") + F.col("_l")).drop("_h", "_p", "_l", "_off")


def bucket_count(df: DataFrame) -> int:
    """Four buckets for each shuffle partition, so a bucket holds a quarter of a partition's rows; 64 at least."""
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_edges(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Quantile edges of a column: one sketch pass, at most ``buckets`` doubles on the driver."""
    buckets = buckets or bucket_count(df)
    cuts = df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 1.0 / (2 * buckets)) if buckets > 1 else []
    return [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]


def with_bucket(df: DataFrame, value: str, edges: list[float], out: str = "_b") -> DataFrame:
    if len(edges) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=edges, inputCol=value, outputCol=out).transform(df)


def running_totals(hist: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], edges: list[float], descending: bool = False) -> DataFrame:
    """Adds ``cum_<s>`` to a histogram with one row per (by, value).

    Buckets keep value order, so a running total is the total of the earlier buckets plus the running
    total inside the own bucket. Both the join and the window use the (by, bucket) partitioning.
    """
    keys = [*by, "_b"]
    cut = with_bucket(hist, value, edges)

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    totals = cut.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(direction("_b"))
    offsets = totals.select(*keys, *[(F.sum(s).over(outer) - F.col(s)).alias(f"_o_{s}") for s in sums])
    inner = Window.partitionBy(*keys).orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_c_{s}": F.sum(s).over(inner) for s in sums})
    joined = local.join(offsets, keys)
    return joined.withColumns({f"cum_{s}": F.col(f"_o_{s}") + F.col(f"_c_{s}") for s in sums}).drop(
        "_b", *[f"_o_{s}" for s in sums], *[f"_c_{s}" for s in sums]
    )


def exact_quantiles(hist: DataFrame, by: str, value: str, weights: dict[str, Sequence[float]], edges: list[float]) -> DataFrame:
    """Linearly interpolated quantiles per group of a weighted histogram (one row per (by, value)).

    ``weights`` maps a count column to the probabilities wanted for it. Result: (by, weight, p, quantile);
    groups whose weight is zero are left out.

    Only buckets that hold a wanted rank are ordered.
    """
    names = list(weights)
    cut = with_bucket(hist, value, edges)
    totals = cut.groupBy(by, "_b").agg(*[F.sum(w).alias(w) for w in names])
    whole = Window.partitionBy(by)
    offsets = totals.select(
        by, "_b",
        *[(F.sum(w).over(whole.orderBy("_b")) - F.col(w)).alias(f"_o_{w}") for w in names],
        *[F.sum(w).over(whole).alias(f"_t_{w}") for w in names],
        *[F.col(w).alias(f"_n_{w}") for w in names],
    )

    def spots(w: str) -> Column:
        at = [F.lit(float(p)) * (F.col(f"_t_{w}") - 1) for p in weights[w]]
        return F.array(*[F.struct(
            F.lit(w).alias("weight"), F.lit(float(p)).alias("p"), (a - F.floor(a)).alias("part"),
            F.floor(a).alias("low"), F.ceil(a).alias("high"),
        ) for p, a in zip(weights[w], at)])

    def inside(start: Column, n: Column) -> Column:
        low, high = F.col("s.low"), F.col("s.high")
        return (n > 0) & ((low.between(start, start + n - 1)) | (high.between(start, start + n - 1)))

    start = F.coalesce(*[F.when(F.col("s.weight") == w, F.col(f"_o_{w}")) for w in names])
    size = F.coalesce(*[F.when(F.col("s.weight") == w, F.col(f"_n_{w}")) for w in names])
    # One row per (group, weight, p) and bucket touched: groups x quantiles x 2 at most.
    wanted = offsets.withColumn("s", F.explode(F.concat(*[spots(w) for w in names]))).filter(inside(start, size)).select(
        by, "_b", "s.*", start.alias("off")
    )
    rows = cut.join(wanted.select(by, "_b").distinct(), [by, "_b"], "left_semi")
    inner = Window.partitionBy(by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ordered = rows.withColumns({f"_c_{w}": F.sum(w).over(inner) for w in names})
    joined = ordered.join(wanted, [by, "_b"])
    upto = F.col("off") + F.coalesce(*[F.when(F.col("weight") == w, F.col(f"_c_{w}")) for w in names])
    own = F.coalesce(*[F.when(F.col("weight") == w, F.col(w)) for w in names])

    def holds(rank: str) -> Column:
        return F.when((own > 0) & (F.col(rank) < upto) & (F.col(rank) >= upto - own), F.col(value))

    return joined.groupBy(by, "weight", "p", "part").agg(
        F.max(holds("low")).alias("_low"), F.max(holds("high")).alias("_high")
    ).select(by, "weight", "p", (F.col("_low") * (1 - F.col("part")) + F.col("_high") * F.col("part")).alias("quantile"))
