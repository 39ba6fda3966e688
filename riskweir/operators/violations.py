"""Validation as one aggregate: rules name bad cells, a small table reports counts and examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from riskweir.functions.coerce import as_number, binary_is_bad, dtype, is_real, stripped, trimmed_id
from riskweir.schema import DECISIONS, FEATURES, ID, FeatureGroups

EXAMPLES = 5
#: Rules whose code is compiled with that of the row.
FEW_RULES = 8


@dataclass(frozen=True)
class Rule:
    """``bad`` marks the rows breaking the rule, ``shown`` is the text kept as an example."""

    name: str
    bad: Column
    shown: Column


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per broken rule: ``rule``, ``n_bad`` and the smallest distinct ``examples`` as a JSON array.

    Bad cells are counted by (rule, text) before the shuffle, so one text filling a third of the
    table costs one row per task; the examples come from a limited rank, never from a full set.
    Totals and examples both keep the counts, so that their shuffles are the same one and ``df`` is read once.
    """
    cells = F.array(*[
        F.when(r.bad, F.struct(F.lit(r.name).alias("rule"), F.coalesce(r.shown.cast("string"), F.lit("<MISSING>")).alias("value")))
        for r in rules
    ])
    # A filter after the explode, as array_compact() has no compiled code and takes that of all rules with it.
    found = df.select(F.explode(cells).alias("cell")).filter(F.col("cell").isNotNull()).select("cell.*")
    counted = found.groupBy("rule", "value").agg(F.count("*").alias("n"))
    first = (
        counted.withColumn("at", F.row_number().over(Window.partitionBy("rule").orderBy("value", "n")))
        .filter(F.col("at") <= EXAMPLES)
        .groupBy("rule")
        .agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"])).alias("examples"))
    )
    totals = counted.groupBy("rule").agg(F.sum("n").alias("n_bad"))
    return totals.join(first, "rule").select("rule", "n_bad", "examples")


def any_bad(rules: list[Rule]) -> Column:
    """Row-level flag, used to route rows to a quarantine."""
    flag = F.lit(False)
    for rule in rules:
        flag = flag | F.coalesce(rule.bad, F.lit(False))
    return flag


def _aside(column: Column) -> Column:
    """The column as the body of a lambda: however many rules it has, it adds a call to the code of a row and not its own code, which may be more than the JVM compiles."""
    return F.get(F.transform(F.array(F.lit(0)), lambda _: column), F.lit(0))


def guarded(df: DataFrame, rules: list[Rule], keep: Column | None = None, typed: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``df`` (where ``keep`` holds), with an error at the first row that breaks a rule.

    Check and selection are made in the scan's own pass, so a row that is not kept is checked as well and nothing is
    read twice. The error names rule and value; :func:`violations` counts all of them.

    Every row is marked with the partition that it is checked in, and an optimizer doesn't move a filter past such a mark: the cells stay columns that are made once a row. A
    check that is pushed below them has a copy of each cell wherever it names one, which is more code than is compiled. ``typed`` are columns to be
    made of the rows that passed; what they share with the rules should be columns of ``df`` (:func:`coerce.typed_once`). The text of a bad cell is made for a bad row alone.
    """
    if not rules:
        return df.withColumns(typed or {}) if keep is None else df.filter(keep).withColumns(typed or {})
    broken = F.coalesce(*[F.when(F.coalesce(r.bad, F.lit(False)), F.lit(i)) for i, r in enumerate(rules)])
    checked = df.withColumns({"__broken": broken if len(rules) <= FEW_RULES else _aside(broken), "__kept": F.lit(True) if keep is None else keep, "__place": F.spark_partition_id()})
    at = F.col("__broken")
    shown = F.coalesce(*[F.when(at == i, r.shown.cast("string")) for i, r in enumerate(rules)], F.lit("<MISSING>"))
    name = F.get(F.array(*[F.lit(f"{r.name}: ") for r in rules]), at)
    sound = F.when(at.isNotNull(), F.raise_error(F.concat(F.lit("Rejected value in "), _aside(F.concat(name, shown))))).otherwise(F.col("__kept"))
    passed = checked.filter((F.col("__place") >= 0) & sound).drop("__broken", "__kept", "__place")
    return passed.withColumns(typed) if typed else passed


@dataclass(frozen=True)
class Check:
    """What a pass over the rows found: known once the frame that :func:`observed` gave has been read to its end, as by a write."""

    rules: list[Rule]
    observation: Observation

    def found(self) -> list[tuple[str, int, list[str]]]:
        """(rule, bad cells, up to EXAMPLES distinct examples) of the broken rules, in the order of the rules."""
        if not self.rules:
            return []
        got = self.observation.get
        return [(r.name, got[f"n{i}"], sorted({got[f"e{i}_{k}"] for k in range(EXAMPLES)} - {None})) for i, r in enumerate(self.rules) if got[f"n{i}"]]

    def raise_if_bad(self) -> None:
        faults = self.found()
        if faults:
            raise ValueError("Rejected values: " + "; ".join(f"{rule}: {n} cells, such as {', '.join(map(repr, shown))}" for rule, n, shown in faults))


def observed(df: DataFrame, rules: list[Rule], keep: Column | None = None) -> tuple[DataFrame, Check]:
    """The sound rows of ``df`` (where ``keep`` holds), and the counts and examples of all bad cells, taken in the same pass.

    Nothing is raised while rows are read; whoever reads them to the end asks the check. A metric per rule and slot is all that is held, however
    many cells are bad: a value's slot is drawn from its digest, and each slot keeps its smallest value.
    """
    check = Check(rules, Observation())
    if not rules:
        return (df if keep is None else df.filter(keep)), check
    flags = {f"_bad{i}": F.coalesce(r.bad, F.lit(False)) for i, r in enumerate(rules)}
    shown = {f"_shown{i}": F.when(F.col(f"_bad{i}"), F.coalesce(r.shown.cast("string"), F.lit("<MISSING>"))) for i, r in enumerate(rules)}
    marked = df.withColumns(flags).withColumns(shown)
    metrics = []
    for i in range(len(rules)):
        slot = F.conv(F.substring(F.md5(F.col(f"_shown{i}").cast("binary")), 1, 1), 16, 10).cast("int") % EXAMPLES
        metrics += [F.count_if(F.col(f"_bad{i}")).alias(f"n{i}"), *[F.min(F.when(slot == k, F.col(f"_shown{i}"))).alias(f"e{i}_{k}") for k in range(EXAMPLES)]]
    bad = F.lit(False)
    for name in flags:
        bad = bad | F.col(name)
    sound = marked.observe(check.observation, *metrics).filter(~bad & (F.lit(True) if keep is None else keep))
    return sound.drop(*flags, *shown), check


def written(df: DataFrame, check: Check, path: str) -> DataFrame:
    """Writes ``df`` to a new ``path`` and reads it back. If its pass found bad cells, nothing stays there and the error counts and shows them."""
    spark = df.sparkSession
    df.write.parquet(path)
    try:
        check.raise_if_bad()
    except ValueError:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        raise
    return spark.read.schema(df.schema).parquet(path)


def raise_if(df: DataFrame, rules: list[Rule], message) -> None:
    """Run the check and raise ``ValueError``; at most one row per rule reaches the driver.

    The plain count runs first, so a clean table costs one narrow aggregate and no examples.
    """
    if not rules:
        return
    counts = df.agg(*[F.count_if(r.bad).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    if any(counts):
        broken = [r for i, r in enumerate(rules) if counts[i]]
        rows = {r["rule"]: r for r in violations(df, broken).collect()}
        raise ValueError("; ".join(message(rows[r.name]) for r in broken))


def binary_rules(df: DataFrame, columns: list[str], binaries: dict[str, Column] | None = None) -> list[Rule]:
    """``binaries`` are columns of the typed cells, if they were made before (:func:`coerce.typed_once`)."""
    return [Rule(c, binary_is_bad(df, c, (binaries or {}).get(c)), F.col(c)) for c in columns]


def binary_message(row) -> str:
    return f"{row['rule']}: {row['n_bad']} cells are no binary value, such as {row['examples']}"


def check_binary(df: DataFrame, columns: list[str]) -> None:
    raise_if(df, binary_rules(df, columns), binary_message)


def decision_rule(column: str = "final_decision") -> Rule:
    text = F.upper(stripped(F.col(column)))
    return Rule(column, text.isNull() | ~text.isin(*DECISIONS), text)


def decision_message(row) -> str:
    return f"{row['rule']}: {row['n_bad']} cells are no known decision, such as {row['examples']}"


def scoring_rules(df: DataFrame, groups: FeatureGroups = FEATURES, numbers: dict[str, Column] | None = None) -> list[Rule]:
    """Numbers must parse and be finite; boolean features hold 0, 1 or nothing. ``numbers`` are columns of the typed cells, if they were made before."""
    rules = []
    for name in groups.continuous:
        number = numbers[name] if numbers else as_number(df, name)
        present = F.col(name).isNotNull()
        if is_real(dtype(df, name)):
            present = present & ~F.isnan(name)
        rules.append(Rule(f"{name}:not_numeric", present & number.isNull(), F.col(name)))
        infinite = F.abs(number) == float("inf")
        rules.append(Rule(f"{name}:not_finite", infinite, F.col(name)))
        if name in groups.boolean:
            rules.append(Rule(f"{name}:not_binary", ~infinite & ~number.isin(0.0, 1.0), F.col(name)))
    return rules


def check_scoring(df: DataFrame, groups: FeatureGroups = FEATURES) -> None:
    raise_if(
        df, scoring_rules(df, groups),
        lambda row: f"{row['rule']}: {row['n_bad']} rejected cells, such as {row['examples']}",
    )


def id_violations(df: DataFrame, column: str = ID) -> DataFrame:
    """One row: missing, blank / 'null' and duplicated ids (all rows of a duplicated id count).

    Blank ids are left out of the duplicate count. Ids are counted map-side first, so a hot id is cheap.
    """
    name = trimmed_id(F.col(column))
    per_id = df.select(name.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    blank = (F.col("key") == "") | (F.lower("key") == "null")
    return per_id.agg(
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("n_blank"),
        F.coalesce(F.sum(F.when(~blank & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("n_duplicate"),
    )


def check_ids(df: DataFrame, column: str = ID) -> None:
    row = id_violations(df, column).first()
    faults = {"without an id": row["n_missing"], "with a blank id": row["n_blank"], "sharing an id": row["n_duplicate"]}
    if any(faults.values()):
        raise ValueError(f"Column {column!r} must name every row once; rows " + ", ".join(f"{what}: {n}" for what, n in faults.items() if n))


def score_rule(column: str) -> Rule:
    score = F.col(column).cast("double")
    bad = score.isNull() | F.isnan(score) | (score < 0.0) | (score > 1.0)
    return Rule(f"{column}:probability", bad, F.col(column))


def label_rule(column: str) -> Rule:
    label = F.col(column)
    return Rule(f"{column}:label", label.isNull() | ~label.isin(0, 1), label)


def choice_rule(column: str, allowed: tuple[str, ...]) -> Rule:
    return Rule(f"{column}:choice", F.col(column).isNull() | ~F.col(column).isin(*allowed), F.col(column))


def check_domains(df: DataFrame, rules: list[Rule]) -> None:
    raise_if(df, rules, lambda row: f"{row['rule']}: {row['n_bad']} rows outside the domain")
