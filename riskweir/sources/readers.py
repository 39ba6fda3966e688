"""Readers: landing files are read with an explicit schema, types come from the cleaning step."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskweir.schema import FEATURES, FeatureGroups, text_schema


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, dates: Sequence[str] = (), multi_line: bool = False,
) -> DataFrame:
    """CSV with a header and doubled quotes. Cells stay text (digit-only codes and blanks keep their form), except ``dates``.

    ``multi_line`` allows line breaks inside quoted cells; a file is then read by one task. Without ``columns`` the header line gives the names: a
    one-line read, no pass over the data.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if columns is None:
        columns = spark.read.options(**options, inferSchema=False).csv(path).columns
    fields = [T.StructField(f.name, T.DateType() if f.name in dates else T.StringType()) for f in text_schema(columns)]
    return spark.read.schema(T.StructType(fields)).options(**options, enforceSchema=False).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """JSON records: an array or one object per file, or one record per line (the form that splits over tasks)."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_json_text(spark: SparkSession, path: str, groups: FeatureGroups = FEATURES, lines: bool = False) -> DataFrame:
    """JSON records under the names and with the cells they have, as text, to be judged by ``scoring_frame``.

    A pass over the file finds the names, so that absent and additional ones are seen. ``true`` and ``false`` of numeric features count as 1 and 0.
    """
    found = spark.read.option("primitivesAsString", True).json(path, multiLine=not lines)
    flags = {c: F.when(F.col(c).isin("true", "false"), (F.col(c) == "true").cast("int").cast("string")).otherwise(F.col(c)) for c in groups.continuous if c in found.columns}
    return found.withColumns(flags) if flags else found


def read_records(spark: SparkSession, path: str, groups: FeatureGroups = FEATURES) -> DataFrame:
    """Scoring input by file extension. Cells of text formats come as text and are typed by ``scoring_frame``."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".json":
        return read_json_text(spark, path, groups)
    if suffix == ".jsonl":
        return read_json_text(spark, path, groups, lines=True)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError("Input must be a .csv, .json, .jsonl or .parquet file.")


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """A saved daily table from CSV: the day is a date, the other columns are numbers."""
    raw = read_csv(spark, path, dates=("app_day",))
    return raw.withColumns({c: F.col(c).try_cast("double") for c in raw.columns if c not in ("app_day", "product")})
