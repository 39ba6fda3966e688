"""Drift of features and scores against a baseline period: histograms with frozen bins, population stability and missing rates.

A :class:`Profile` is all that is kept of the baseline: bin edges of each number, the most frequent values of each text, and the baseline's counts. Its
size is features x bins, whatever the data. The comparison is one aggregate of counters per (window, feature), which is the same expression on a table and on a stream.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweir.operators.fill import long_numbers, long_texts
from riskweir.operators.ranking import exact_quantiles, value_edges

#: Occurrences added to every bin, so that an empty one has a logarithm.
PRIOR = 0.5
# The usual reading of the population stability index.
MODERATE, LARGE = 0.1, 0.25


@dataclass(frozen=True)
class Profile:
    """``edges``: upper bounds, inclusive, of all bins of a number but the last; ``values``: texts with a bin of their own, all others
    share the last one; ``counts``: baseline rows in each bin, and of missing cells at the end."""

    edges: dict[str, list[float]]
    values: dict[str, list[str]]
    counts: dict[str, list[int]]

    @property
    def features(self) -> list[str]:
        return [*self.edges, *self.values]

    def bins(self, feature: str) -> int:
        return len(self.edges[feature] if feature in self.edges else self.values[feature]) + 1

    @property
    def width(self) -> int:
        return max(map(self.bins, self.features), default=1)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Profile:
        return Profile(**json.loads(text))

    def bin_of(self, feature: str) -> Column:
        """Bin of a cell; null if it is missing. NaN is missing, too."""
        if feature in self.edges:
            value = F.nanvl(F.col(feature).cast("double"), F.lit(None).cast("double"))
            above = [(value > edge).cast("int") for edge in self.edges[feature]]
            return F.when(value.isNotNull(), sum(above, F.lit(0)))
        value, known = F.col(feature).cast("string"), self.values[feature]
        found = F.array_position(F.array(*map(F.lit, known)), value).cast("int") - 1 if known else F.lit(-1)
        return F.when(value.isNotNull(), F.when(found < 0, len(known)).otherwise(found))


def profile(baseline: DataFrame, numeric: Sequence[str] = (), texts: Sequence[str] = (), bins: int = 10, most: int = 20) -> Profile:
    """Freezes the bins on the rows of the baseline: exact quantiles of every number, the ``most`` frequent values of every text, the smaller on ties.

    All numbers come from one histogram of distinct values, all texts from another; only buckets that hold a wanted rank are ordered.
    A feature that is missing throughout has a single bin.
    """
    if bins < 2 or most < 1:
        raise ValueError("drift needs two bins and one value at least")
    edges: dict[str, list[float]] = {f: [] for f in numeric}
    if numeric:
        cells = long_numbers(baseline, list(numeric)).withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).filter("value is not null")
        counted = cells.groupBy("feature", "value").agg(F.count("*").alias("n"))
        cuts = exact_quantiles(counted, "feature", "value", {"n": [k / bins for k in range(1, bins)]}, value_edges(cells, "value"))
        for r in cuts.collect():  # features x bins rows
            edges[r["feature"]].append(float(f"{r['quantile']:.12g}"))  # interpolation must not fall beside the value it hits
    known: dict[str, list[str]] = {f: [] for f in texts}
    if texts:
        counted = long_texts(baseline, list(texts)).filter("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
        best = [counted.filter(F.col("feature") == f).orderBy(F.col("n").desc(), "value").limit(most).select("feature", "value") for f in texts]
        for part in best:  # at most ``most`` rows each
            for r in part.collect():
                known[r["feature"]].append(r["value"])
    frozen = Profile({f: sorted(set(e)) for f, e in edges.items()}, known, {})
    rows = histograms(baseline, frozen, {}).collect()  # one row per feature
    found = {r["feature"]: [*r["counts"], r["missing"]] for r in rows}
    counts = {f: [*found[f][:frozen.bins(f)], found[f][-1]] if f in found else [0] * (frozen.bins(f) + 1) for f in frozen.features}
    return Profile(frozen.edges, frozen.values, counts)


def histograms(df: DataFrame, frozen: Profile, window: dict[str, Column]) -> DataFrame:
    """(window..., feature, counts array, missing) of every feature in every window, by one aggregate of counters.

    A row leaves each task per window and feature, so a hot window is no large group; on a stream the counters are the state.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), frozen.bin_of(f).alias("bin")) for f in frozen.features])
    long = df.select(*[c.alias(n) for n, c in window.items()], F.explode(cells).alias("c")).select(*window, "c.*")
    width = frozen.width
    counted = long.groupBy(*window, "feature").agg(*[F.count_if(F.col("bin") == k).alias(f"_{k}") for k in range(width)], F.count_if(F.col("bin").isNull()).alias("missing"))
    return counted.select(*window, "feature", F.array(*[f"_{k}" for k in range(width)]).alias("counts"), "missing")


def _lookup(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for feature, value in values.items():
        out = F.when(F.col("feature") == feature, value).otherwise(out)
    return out


def shifts(counted: DataFrame, frozen: Profile) -> DataFrame:
    """Adds n, missing_rate, missing_shift, psi and drift to :func:`histograms`.

    ``psi`` sums (p - q) ln(p / q) over the bins of a feature, p and q being the shares of the window's and the baseline's observed rows with PRIOR
    added to each bin; it is null if either has no observed row. ``missing_shift`` is the missing rate less that of the baseline. ``drift`` is
    ``large`` from LARGE on, ``moderate`` from MODERATE on, else ``none``.
    """
    def shares(feature: str) -> Column:
        own, n = frozen.counts[feature][:-1], frozen.bins(feature)
        return F.array(*[F.lit((c + PRIOR) / (sum(own) + PRIOR * n)) for c in own])

    observed = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    size = _lookup({f: F.lit(frozen.bins(f)) for f in frozen.features}).cast("int")
    base = _lookup({f: shares(f) for f in frozen.features})
    share = F.transform(F.slice("counts", 1, F.col("_bins")), lambda c: (c + PRIOR) / (F.col("_observed") + PRIOR * F.col("_bins")))
    terms = F.zip_with(share, "_base", lambda p, q: (p - q) * F.log(p / q))
    psi = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    whole = {f: sum(frozen.counts[f]) for f in frozen.features}
    missing = _lookup({f: F.lit(frozen.counts[f][-1] / whole[f] if whole[f] else None).cast("double") for f in frozen.features}).cast("double")
    seen = _lookup({f: F.lit(whole[f] > frozen.counts[f][-1]) for f in frozen.features}).cast("boolean")
    out = counted.withColumns({"_observed": observed, "_bins": size, "_base": base})
    out = out.withColumns({"n": F.col("_observed") + F.col("missing"), "psi": F.when(seen & (F.col("_observed") > 0), psi)})
    out = out.withColumn("missing_rate", F.col("missing").cast("double") / F.col("n"))
    level = F.when(F.col("psi") >= LARGE, "large").when(F.col("psi") >= MODERATE, "moderate").otherwise("none")
    return out.withColumns({"missing_shift": F.col("missing_rate") - missing, "drift": level}).drop("_observed", "_bins", "_base", "counts", "missing")


def drift(df: DataFrame, frozen: Profile, window: dict[str, Column]) -> DataFrame:
    """(window..., feature, n, psi, missing_rate, missing_shift, drift) of every feature in every window."""
    return shifts(histograms(df, frozen, window), frozen)


def save_profile(spark: SparkSession, frozen: Profile, path: str) -> None:
    spark.createDataFrame([(frozen.to_json(),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def load_profile(spark: SparkSession, path: str) -> Profile:
    return Profile.from_json(spark.read.text(path, wholetext=True).first()["value"])
