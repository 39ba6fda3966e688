"""Exact ranks over any number of rows without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_rank(rows: DataFrame, group: str | None, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the zero-based rank of each row within its group, or over all rows.

    ``bucket`` is a whole number that never falls along ``order`` and spreads the rows of each group evenly, so that a group of any
    size is ranked bucket by bucket: rows before the bucket come from one small table of counts. Null groups are a group.
    """
    keys = ["__group", "__bucket"]
    rows = rows.withColumns({"__group": F.col(group) if group else F.lit("all"), "__bucket": bucket})
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__group").alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    joined = rows.join(offsets, F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return joined.withColumn(name, F.col("__before") + place - 1).drop(*keys, "__g", "__b", "__before")
