"""Typed coercion as plain column expressions (no Python in the data path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Accepted texts for true and false.
TRUE_TEXT = ("1", "true", "t", "yes", "y")
FALSE_TEXT = ("0", "false", "f", "no", "n")
# Cells that mean missing in merchant files.
NULL_TOKENS = ("NULL", "null", "")

# The written forms of a binary number; other spellings of 0 and 1 are errors.
ONE, ZERO = "1.0", "0.0"

_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
_ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?$"
#: All white space of Unicode; Spark's plain trim knows the space character alone.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def stripped(column: Column) -> Column:
    """Text without white space of any kind at its ends. Cells that begin and end with printed ASCII have none, which is cheaper to see than to strip."""
    ends = (F.ascii(column), F.ascii(F.substring(column, -1, 1)))
    return F.when(ends[0].between(33, 126) & ends[1].between(33, 126), column).otherwise(F.btrim(column, F.lit(WHITE_SPACE)))


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_real(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL is the only missing value: turn NaN in floating columns into NULL."""
    real = [c for c in (columns or df.columns) if is_real(dtype(df, c))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(dtype(df, c))) for c in real}) if real else df


def null_tokens(df: DataFrame) -> DataFrame:
    """Exact text cells that stand for missing become NULL; other cells stay as they are."""
    texts = [c for c in df.columns if isinstance(dtype(df, c), T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)) for c in texts}) if texts else df


def number_of(text: Column) -> Column:
    """Double of a stripped text, or NULL if it is not a plain decimal number."""
    # The pattern keeps out suffixes such as "4d" that a bare cast would accept.
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def binary_of(text: Column) -> Column:
    """1.0 / 0.0 of a stripped lower-case text, NULL for anything else."""
    return F.when(text.isin(*TRUE_TEXT, ONE), F.lit(1.0)).when(text.isin(*FALSE_TEXT, ZERO), F.lit(0.0))


def as_number(df: DataFrame, name: str) -> Column:
    """Double, or NULL for text that is not a plain decimal number."""
    col, kind = F.col(name), dtype(df, name)
    if isinstance(kind, T.StringType):
        return number_of(stripped(col))
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
    return F.lit(None).cast("double")


def as_binary(df: DataFrame, name: str) -> Column:
    """1.0 / 0.0 for the accepted values, NULL for missing and for anything else."""
    if isinstance(dtype(df, name), T.StringType):
        return binary_of(F.lower(stripped(F.col(name))))
    number = as_number(df, name)
    return F.when(number.isin(0.0, 1.0), number)


def binary_is_bad(df: DataFrame, name: str, binary: Column | None = None) -> Column:
    """True where a value is present but is not an accepted binary value. ``binary`` is a column of :func:`as_binary`, if there is one."""
    col = F.col(name)
    present = col.isNotNull()
    if is_real(dtype(df, name)):
        present = present & ~F.isnan(col)
    return present & (as_binary(df, name) if binary is None else binary).isNull()


def typed_once(df: DataFrame, numbers: Sequence[str], binaries: Sequence[str]) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """``df`` with a column of its own for every number and binary cell, and those columns by name.

    Rules and results that name these columns have no copy of the expressions, whose code, repeated for each of them, is more than the JVM compiles. Texts go
    through one lambda each for numbers and binary cells, so the code doesn't grow with the number of columns.
    """
    kinds = {c: isinstance(dtype(df, c), T.StringType) for c in (*numbers, *binaries)}
    ways = {"__numbers": ([c for c in numbers if kinds[c]], number_of), "__binaries": ([c for c in binaries if kinds[c]], lambda t: binary_of(F.lower(t)))}
    arrays = {name: F.transform(F.transform(F.array(*map(F.col, texts)), stripped), of) for name, (texts, of) in ways.items() if texts}
    made = {f"__number_{c}": as_number(df, c) for c in numbers if not kinds[c]} | {f"__binary_{c}": as_binary(df, c) for c in binaries if not kinds[c]}
    for name, prefix in (("__numbers", "__number_"), ("__binaries", "__binary_")):
        made |= {f"{prefix}{c}": F.get(F.col(name), F.lit(i)) for i, c in enumerate(ways[name][0])}
    out = df.withColumns(arrays).withColumns(made).drop(*arrays)
    return out, {c: F.col(f"__number_{c}") for c in numbers}, {c: F.col(f"__binary_{c}") for c in binaries}


def as_time(df: DataFrame, name: str, formats: tuple[str, ...] = ()) -> Column:
    """Timestamp without zone; text that fits neither ISO nor ``formats`` becomes NULL."""
    col, kind = F.col(name), dtype(df, name)
    if not isinstance(kind, T.StringType):
        return col.cast("timestamp_ntz")
    # A bare cast would read "T10" as today at ten, so the shape is checked first.
    text = stripped(col)
    tries = [F.when(text.rlike(_ISO_TIME), text.try_cast("timestamp_ntz"))]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def whole_days(earlier: Column, later: Column) -> Column:
    """Floor of the elapsed time in days (not the calendar difference)."""
    gap = later - earlier
    days = F.extract(F.lit("DAY"), gap)
    return (days - (gap < F.make_dt_interval(days)).cast("int")).cast("bigint")


def trimmed_id(column: Column) -> Column:
    return stripped(column.cast("string"))
