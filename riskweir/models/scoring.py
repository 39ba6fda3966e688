"""Helpers around scored rows and concurrent fits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweir.operators.ranking import seeded_hash
from riskweir.schema import ID, LABEL


def positive(column: str = "probability") -> Column:
    """Probability of class 1 from an MLlib probability vector."""
    return vector_to_array(column)[1]


def scored(fitted: Transformer, df: DataFrame, keep: Sequence[str] = (LABEL,), **constants) -> DataFrame:
    """(keep..., constants..., score): narrow scored rows."""
    return fitted.transform(df).select(*keep, *[F.lit(v).alias(k) for k, v in constants.items()], positive().alias("score"))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def concurrently(spark: SparkSession, tasks: Sequence[Callable], parallelism: int = 4) -> list:
    """Run independent fits from a few driver threads, so that their Spark jobs overlap."""
    if not tasks:
        return []
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda run: run(), [inheritable_thread_target(spark)(t) for t in tasks])


def hash_sample(df: DataFrame, size: int, key: str = ID, seed: int = 42) -> DataFrame:
    """Exactly ``min(size, rows)`` rows, the same for any partitioning: the first ones by seeded hash."""
    return df.withColumn("_h", seeded_hash(key, f"sample{seed}")).orderBy("_h", key).limit(size).drop("_h")
