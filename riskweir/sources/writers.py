"""Writers for result tables and scored rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T


def rounded(df: DataFrame, digits: int) -> DataFrame:
    real = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, digits) for c in real}) if real else df


def write_table(df: DataFrame, path: str, kind: str = "parquet", digits: int | None = None, overwrite: bool = False) -> None:
    """A result table; an existing one is only replaced when asked to."""
    out = df if digits is None else rounded(df, digits)
    writer = out.write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "csv":
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(kind).save(path)


def exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def write_final(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet", allow_overwrite: bool = False) -> None:
    """Final evaluation tables: all targets are checked before the first one is written."""
    first = next(iter(tables.values()))
    present = [name for name in tables if exists(first.sparkSession, f"{folder}/{name}")]
    if present and not allow_overwrite:
        raise FileExistsError(f"Final evaluation tables already exist, refusing to overwrite: {present}")
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}", kind, overwrite=allow_overwrite)


def write_records(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Scored rows as JSON records, one per line and one file per task."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)
