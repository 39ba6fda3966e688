"""Row-order-invariant stratified splits and folds with exact class quotas.

A row's part depends on its label and on the seeded hash of its id only. Fitting a split finds the hash
values at the quota ranks (two narrow passes over id and label). Applying it is a projection against
those few values: the wide table is never shuffled, and the same rule can be stored and applied again.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskweir.operators.ranking import hash_cuts, prefix_counts, seeded_hash
from riskweir.operators.violations import check_ids
from riskweir.schema import ID, LABEL, SPLITS
from riskweir.session import scratch

SEED = 42
PROTOCOL = "hash-ranked-stratified-70-15-15-v1"

Totals = dict[int, int]
Ranks = dict[int, list[int]]


def seats(total: int, sizes: Totals) -> Totals:
    """``total`` seats in proportion to ``sizes``; spare seats go to the largest remainders, class 0 first on a tie."""
    whole = sum(sizes.values())
    exact = {c: total * n / whole for c, n in sizes.items()}
    given = {c: math.floor(e) for c, e in exact.items()}
    order = sorted(sizes, key=lambda c: (given[c] - exact[c], c))
    for c in order[: total - sum(given.values())]:
        given[c] += 1
    return given


def part_ranks(sizes: Totals, holdout: float = 0.30, second: float = 0.50) -> Ranks:
    """Last ranks of train and validation per class; holdout and test sizes are rounded up."""
    n = sum(sizes.values())
    held = math.ceil(holdout * n)
    train = seats(n - held, sizes)
    left = {c: sizes[c] - train[c] for c in sizes}
    validation = seats(held - math.ceil(second * held), left) if held else dict.fromkeys(sizes, 0)
    return {c: [train[c], train[c] + validation[c]] for c in sizes}


def holdout_ranks(sizes: Totals, holdout: float = 0.20) -> Ranks:
    n = sum(sizes.values())
    train = seats(n - math.ceil(holdout * n), sizes)
    return {c: [train[c]] for c in sizes}


def fold_ranks(sizes: Totals, folds: int) -> Ranks:
    """The sorted labels are dealt out round robin, so fold sizes differ by at most one row."""
    ranks, start = {}, 0
    for c in sorted(sizes):
        stop = start + sizes[c]
        upto, total = [], 0
        for fold in range(folds - 1):
            total += (stop - 1 - fold) // folds - (start - 1 - fold) // folds
            upto.append(total)
        ranks[c], start = upto, stop
    return ranks


@dataclass(frozen=True)
class SplitRule:
    """Hash cuts per class: part i of a class holds the hashes up to cut i, the last part the rest."""

    names: tuple
    cuts: dict[int, list[str]]
    seed: int | str = SEED
    label: str = LABEL
    key: str = ID

    def column_of(self, label: Column, key: Column) -> Column:
        """The part decided by a label and an id; NULL without a label.

        The hash is bound to a lambda variable: it is computed once per row, also where a filter on the
        part is pushed below other projections.
        """

        return F.get(F.transform(F.array(seeded_hash(key, self.seed)), lambda hashed: self.chosen(label, hashed)), 0)

    def chosen(self, label: Column, hashed: Column) -> Column:
        """The part decided by a label and the seeded hash of an id."""
        whole = F.lit(None)
        for c, cuts in self.cuts.items():
            part = F.lit(self.names[-1])
            for i in reversed(range(len(cuts))):
                part = F.when(hashed <= cuts[i], F.lit(self.names[i])).otherwise(part)
            whole = F.when(label == c, part).otherwise(whole)
        return whole

    def apply(self, df: DataFrame, out: str = "split", hashed: str | None = None) -> DataFrame:
        """``hashed`` is a column of the seeded hash of the id, if the rows have one."""
        label = F.col(self.label)
        return df.withColumn(out, self.chosen(label, F.col(hashed)) if hashed else self.column_of(label, F.col(self.key)))


def with_hash(df: DataFrame, out: str, key: str = ID, seed: int | str = SEED) -> DataFrame:
    """Adds the seeded hash of the id. A table that is stored with it is split, and read by split any number of times, without a hash made again.

    The hash is made in a lambda: its code, put beside that of the rows, would be more than the JVM compiles.
    """
    return df.withColumn(out, F.get(F.transform(F.array(key), lambda k: seeded_hash(k, seed)), 0))


def stored_keys(df: DataFrame, label: str, key: str, seed: int | str) -> DataFrame:
    """(label, key, h) of every row as a table: the wide input, often a join, is read once for all passes of a fit."""
    path = scratch(df.sparkSession, "split-keys")
    keys = df.select(F.col(label).cast("int").alias(label), F.col(key), seeded_hash(key, seed).alias("h"))
    keys.write.parquet(path)
    return df.sparkSession.read.schema(keys.schema).parquet(path)


def fit_rule(
    df: DataFrame, names: tuple, ranks: Callable[[Totals], Ranks], label: str = LABEL, key: str = ID, seed: int | str = SEED,
    check: Callable[[Totals], None] | None = None, strict: bool = True, hashed: str | None = None,
) -> SplitRule:
    """``hashed`` names the column that :func:`with_hash` gave to the stored rows, with the same key and seed; without it the keys are stored with their hash."""
    if hashed:
        keys = df.select(F.col(label).cast("int").alias(label), F.col(key), F.col(hashed).alias("h"))
    else:
        keys = stored_keys(df, label, key, seed)
    if strict:
        check_ids(keys, key)
    keyed = keys.filter(F.col(label).isNotNull())
    counts = prefix_counts(keyed, label, "h").persist()
    try:
        sizes = {r[label]: r["n"] for r in counts.groupBy(label).agg(F.sum("n").alias("n")).collect()}
        if check:
            check(sizes)
        return SplitRule(names, hash_cuts(keyed, counts, label, "h", ranks(sizes)) if sizes else {}, seed, label, key)
    finally:
        counts.unpersist()


def check_split_size(sizes: Totals) -> None:
    if sum(sizes.values()) < 7 or len(sizes) < 2 or min(sizes.values()) < 4:
        raise ValueError(f"Too few rows for three parts with both classes: {sizes}")


def fit_split(df: DataFrame, label: str = LABEL, key: str = ID, seed: int = SEED, strict: bool = True, hashed: str | None = None) -> SplitRule:
    if key not in df.columns:
        raise ValueError(f"Splits follow ids; column {key!r} is absent.")
    return fit_rule(df, SPLITS, part_ranks, label, key, seed, check_split_size if strict else None, strict, hashed)


def stratified_split(
    df: DataFrame, label: str = LABEL, key: str = ID, seed: int = SEED, strict: bool = True, hashed: str | None = None,
) -> DataFrame:
    """Adds ``split``: train 70 %, validation 15 %, test 15 % of each class. ``hashed`` is a column of :func:`with_hash` in a stored table."""
    return fit_split(df, label, key, seed, strict, hashed).apply(df, hashed=hashed)


def holdout_split(df: DataFrame, label: str = LABEL, key: str = ID, seed: int = SEED, holdout: float = 0.20, strict: bool = True) -> DataFrame:
    """Adds ``split``: train or test. Ids must name rows, as for every split here."""
    return fit_rule(df, ("train", "test"), lambda sizes: holdout_ranks(sizes, holdout), label, key, seed, strict=strict).apply(df)


def kfold(df: DataFrame, folds: int = 5, label: str = LABEL, key: str = ID, seed: int = SEED, strict: bool = True) -> DataFrame:
    """Adds ``fold`` 0 .. folds-1, stratified by label."""
    rule = fit_rule(df, tuple(range(folds)), lambda sizes: fold_ranks(sizes, folds), label, key, f"fold{seed}", strict=strict)
    return rule.apply(df, "fold")


def split_audit(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("n"), F.sum(label).cast("bigint").alias("fraud"),
        F.sum(1 - F.col(label)).cast("bigint").alias("non_fraud"),
        (F.sum(label).cast("double") / F.count("*")).alias("fraud_rate"),
    )


def split_overlap(parts: DataFrame, key: str = ID) -> DataFrame:
    """One row: ids found in more than one part, per pair, and ids without a part."""
    flags = parts.groupBy(key).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    return flags.agg(
        F.count("*").alias("n_ids"),
        *[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_and_{b}") for a, b in pairs],
        F.count_if(F.coalesce(F.col("train") + F.col("validation") + F.col("test"), F.lit(0)) == 0).alias("n_unassigned"),
    )


def development_rows(df: DataFrame) -> DataFrame:
    """Train and validation rows, for the final refit."""
    return df.filter(F.col("split").isin("train", "validation"))


def members_of(df: DataFrame, membership: DataFrame, names: tuple[str, ...], key: str = ID) -> DataFrame:
    """Rows whose id belongs to the named parts of a saved membership table (id, split)."""
    return df.join(membership.filter(F.col("split").isin(*names)).select(key), key, "left_semi")


def quarantine_test(raw: DataFrame, label: str = LABEL, key: str = ID, seed: int = SEED, strict: bool = True) -> DataFrame:
    """Rows of train and validation only.

    The split is fitted on label and id alone, and the filter needs nothing else, so no test feature is
    cleaned or returned.
    """
    rule = fit_split(raw, label, key, seed, strict)
    return rule.apply(raw).filter(F.col("split") != "test")
