"""Cleaning of the application and merchant tables, as lazy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweir.functions.coerce import as_binary, as_number, as_time, nan_to_null, null_tokens, stripped, typed_once, whole_days
from riskweir.operators import violations as v
from riskweir.operators.names import apply_aliases, exact_columns, normalize_names, require
from riskweir.schema import (
    APPLICATION_COLUMNS, BOOLEAN, CATEGORICAL, FEATURES, ID, LABEL, NUMERIC, FeatureGroups,
)


def application_rules(df: DataFrame) -> list[v.Rule]:
    """Rules over every input row, before any row is dropped."""
    return [*v.binary_rules(df, [LABEL]), v.decision_rule()]


def check_applications(df: DataFrame) -> None:
    v.raise_if(
        df, application_rules(df),
        lambda row: v.binary_message(row) if row["rule"] == LABEL else v.decision_message(row),
    )


def land_applications(raw: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Normalised names and only the columns the pipeline needs."""
    named = normalize_names(raw)
    return nan_to_null(require(named, (*APPLICATION_COLUMNS, *tie_break)).select(*APPLICATION_COLUMNS, *tie_break))


def type_applications(df: DataFrame, formats: tuple[str, ...] = ()) -> DataFrame:
    """Row-local typing of what decides whether a row stays; works on a stream too."""
    decision = F.upper(stripped(F.col("final_decision")))
    return df.withColumns({
        "application_date": as_time(df, "application_date", formats),
        "first_transaction_date": as_time(df, "first_transaction_date", formats),
        LABEL: as_binary(df, LABEL),
        "final_decision": decision,
    })


def latest_record(df: DataFrame, key: str, order: str, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key; equal times are decided by ``tie_break``, then by the whole row.

    ``max_by`` keeps one row per key and task before the shuffle, so a key holding a third of
    the rows does not reach one task as rows.
    """
    rest = [c for c in df.columns if c not in (key, order, *tie_break)]
    rank = F.struct(order, *tie_break, *rest)
    newest = df.groupBy(key).agg(F.max(rank).alias("row"))
    return newest.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in df.columns])


def plausible(df: DataFrame) -> Column:
    """No first transaction, or one that is not before the application."""
    first = F.col("first_transaction_date")
    return first.isNull() | (first >= F.col("application_date"))


def derive_applications(df: DataFrame) -> DataFrame:
    """Numbers, flags and dates of the rows that stay."""
    approved = F.col("final_decision") == "APPROVED"
    return df.withColumns({
        "credit_score": as_number(df, "credit_score"),
        "fraud_score": as_number(df, "fraud_score"),
        "is_approved": approved.cast("int"),
        "approved_fraud": (approved & (F.col(LABEL) == 1.0)).cast("int"),
        "date_gap_days": whole_days(F.col("application_date"), F.col("first_transaction_date")),
        "app_day": F.to_date("application_date"),
    })


def clean_applications(
    raw: DataFrame, tie_break: tuple[str, ...] = (), formats: tuple[str, ...] = (), strict: bool = True,
) -> DataFrame:
    """Typed applications, newest record per id, implausible transactions removed.

    With ``strict`` the pass that reads the rows fails at a bad label or decision, also on a row that is dropped as incomplete.
    Without it the caller has routed bad rows away (see :func:`split_applications`).
    The plausibility filter follows the choice of the newest record on purpose: an id whose newest
    record is implausible disappears.
    """
    landed = land_applications(raw, tie_break)
    typed = type_applications(complete_applications(landed, formats, strict), formats)
    newest = latest_record(typed, "application_id", "application_date", tie_break)
    kept = derive_applications(newest.filter(plausible(newest)))
    return kept.drop(*[c for c in tie_break if c not in APPLICATION_COLUMNS])


def complete_applications(landed: DataFrame, formats: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Landed rows that have id, date and label."""
    known = (
        F.col("application_id").isNotNull() & as_time(landed, "application_date", formats).isNotNull() & as_binary(landed, LABEL).isNotNull()
    )
    return v.guarded(landed, application_rules(landed), known) if strict else landed.filter(known)


def write_applications(raw: DataFrame, path: str, tie_break: tuple[str, ...] = (), formats: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned applications as a table, in one pass over ``raw``. Bad labels or decisions, also of rows that are dropped as incomplete, leave no table: the
    error has the number of bad cells of every rule and some of them."""
    landed = land_applications(raw, tie_break)
    known = (
        F.col("application_id").isNotNull() & as_time(landed, "application_date", formats).isNotNull() & as_binary(landed, LABEL).isNotNull()
    )
    sound, check = v.observed(landed, application_rules(landed), known)
    newest = latest_record(type_applications(sound, formats), "application_id", "application_date", tie_break)
    kept = derive_applications(newest.filter(plausible(newest)))
    return v.written(kept.drop(*[c for c in tie_break if c not in APPLICATION_COLUMNS]), check, path)


def write_merchants(raw: DataFrame, path: str) -> DataFrame:
    """Cleaned merchants as a table, in one pass; bad binary cells leave none, as with :func:`write_applications`."""
    landed = land_merchants(raw)
    sound, check = v.observed(landed, merchant_rules(landed))
    return v.written(type_merchants(sound), check, path)


def write_scoring_frame(df: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Typed scoring features as a table, in one pass; cells that a feature doesn't allow leave none, as with :func:`write_applications`."""
    expected = exact_columns(df.drop(*carry), FEATURES.all).columns
    picked = df.select(*carry, *expected)
    sound, check = v.observed(picked, v.scoring_rules(picked.select(*expected)))
    return v.written(scoring_frame(sound, carry=carry, strict=False), check, path)


def split_applications(raw: DataFrame, tie_break: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) by the strict rules, without raising."""
    landed = land_applications(raw, tie_break)
    bad = v.any_bad(application_rules(landed))
    return landed.filter(~bad), landed.filter(bad)


def binary_columns(df: DataFrame) -> list[str]:
    return [LABEL, *[c for c in BOOLEAN if c in df.columns]]


def merchant_rules(df: DataFrame, binaries: dict[str, Column] | None = None) -> list[v.Rule]:
    return v.binary_rules(df, binary_columns(df), binaries)


def land_merchants(raw: DataFrame) -> DataFrame:
    named = apply_aliases(normalize_names(raw))
    return require(nan_to_null(null_tokens(named)), [LABEL])


def merchant_types(df: DataFrame, formats: tuple[str, ...] = (), made: dict[str, Column] | None = None) -> dict[str, Column]:
    """Row-local typing; missing feature values are kept. ``made`` are columns of the typed numbers and binary cells, if they were made before."""
    typed = made or {c: as_binary(df, c) for c in binary_columns(df)} | {c: as_number(df, c) for c in NUMERIC if c in df.columns}
    typed |= {c: F.col(c).cast("string") for c in CATEGORICAL if c in df.columns}
    if "open_date" in df.columns:
        opened = as_time(df, "open_date", formats)
        typed |= {
            "open_date": opened, "open_year": F.year(opened),
            "open_month": F.month(opened), "open_day_of_week": F.weekday(opened),
        }
    return typed


def type_merchants(df: DataFrame, formats: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns(merchant_types(df, formats))


def clean_merchants(raw: DataFrame, formats: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Typed merchants with missing values preserved; fills are learned later, on training rows only."""
    landed = land_merchants(raw)
    if not strict:
        return type_merchants(landed, formats)
    made, numbers, binaries = typed_once(landed, [c for c in NUMERIC if c in landed.columns], binary_columns(landed))
    sound = v.guarded(made, merchant_rules(landed, binaries), typed=merchant_types(landed, formats, binaries | numbers))
    return sound.drop(*(c for c in made.columns if c not in landed.columns))


def model_frame(
    clean: DataFrame, groups: FeatureGroups = FEATURES, allow_partial: bool = False,
    identity: str | None = ID, check_classes: bool = True,
) -> tuple[DataFrame, FeatureGroups]:
    """Labelled rows with exactly the requested features in group order, and those groups."""
    if allow_partial:
        groups = groups.subset(clean.columns)
    else:
        require(clean, groups.all)
    if identity is not None:
        require(clean, [identity])
    keys = [identity] if identity else []
    frame = clean.filter(F.col(LABEL).isNotNull()).select(*keys, F.col(LABEL).cast("int").alias(LABEL), *groups.all)
    if check_classes:
        require_classes(frame)
    return frame, groups


def require_classes(frame: DataFrame) -> None:
    low, high = frame.agg(F.min(LABEL), F.max(LABEL)).first()
    if low is None or low == high:
        raise ValueError("The label has one class only; a model needs both.")


def scoring_frame(df: DataFrame, groups: FeatureGroups = FEATURES, carry: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Exact feature schema, typed; ``carry`` columns travel along untouched."""
    ordered = exact_columns(df.drop(*carry), groups.all)
    full = df.select(*carry, *ordered.columns)
    texts = {c: F.col(c).cast("string") for c in groups.categorical}
    if not strict:
        return full.withColumns({c: as_number(full, c) for c in groups.continuous} | texts)
    made, numbers, _ = typed_once(full, groups.continuous, [])
    return v.guarded(made, v.scoring_rules(full, groups, numbers), typed=numbers | texts).select(*full.columns)
