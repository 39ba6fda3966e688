"""Dictionaries of categories of any size: ordinals and smoothed target rates in a table that is joined to the rows.

Neither the driver nor a task ever holds the values of a feature. Values are counted by (feature, value, fold); their ordinals come from a
range-partitioned sort: a value's place in its partition, added to the sizes of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskweir.operators.fill import long_texts
from riskweir.schema import LABEL
from riskweir.session import scratch

SMOOTHING = 1.0


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, features: Sequence[str], label: str = LABEL, fold: str | None = None) -> DataFrame:
    """(feature, value, fold, n, positives) of all cells, null values among them; stored. The fold is -1 without a fold column."""
    folds = df.withColumn("_fold", F.col(fold).cast("int") if fold else F.lit(-1))
    cells = long_texts(folds, list(features), [label, "_fold"])
    table = cells.groupBy("feature", "value", F.col("_fold").alias("fold")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    return _stored(table, "category-counts")


def ordinals(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """(feature, value, ordinal) of distinct (feature, value) rows: places from 0 in the order of the values by their bytes, within each feature.

    The sorted rows are stored with their partition and place in it; the sizes of the parts of each feature are a table of features x partitions rows.
    """
    rows = values.repartitionByRange(partitions, "feature", "value") if partitions else values.repartitionByRange("feature", "value")
    rows = rows.sortWithinPartitions("feature", "value").select("feature", "value", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    rows = _stored(rows, "category-order")
    parts = rows.groupBy("feature", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("_start", before - F.col("_first")).select("feature", "_part", "_start")
    return rows.join(F.broadcast(starts), ["feature", "_part"]).select("feature", "value", (F.col("_at") + F.col("_start")).cast("int").alias("ordinal"))


class _TableParams(Params):
    features = Param(Params._dummy(), "features", "categorical features", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "number of values of each feature", TypeConverters.identity)
    overall = Param(Params._dummy(), "overall", "rate of values that were never seen", TypeConverters.toFloat)
    slot = Param(Params._dummy(), "slot", "which of the rates", TypeConverters.toInt)


class CategoryTable(Estimator, _TableParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns ordinals and rates of categories from filled rows."""

    @keyword_only
    def __init__(self, features=None):
        super().__init__()
        self._setDefault(features=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> CategoryTableModel:
        features = self.getOrDefault("features")
        return category_models(counted(dataset, features), features, [None], [{}])[0]


class CategoryTableModel(Model, _TableParams, MLReadable, MLWritable):
    """Adds ``<f>__index`` and ``<f>__rate`` to every categorical feature f. Values that were never seen have the index after the last, and the overall rate."""

    @keyword_only
    def __init__(self, features=None, sizes=None, overall=0.0, slot=0):
        super().__init__()
        self._setDefault(features=[], sizes={}, overall=0.0, slot=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.table: DataFrame | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for f in self.getOrDefault("features"):
            own = self.table.filter(F.col("feature") == f).select(
                F.col("value").alias(f"{f}__value"), F.col("ordinal").alias(f"{f}__index"), F.get("rates", F.lit(self.getOrDefault("slot"))).alias(f"{f}__rate"))
            out = out.join(own, F.col(f).cast("string") == F.col(f"{f}__value"), "left").drop(f"{f}__value").withColumns({
                f"{f}__index": F.coalesce(f"{f}__index", F.lit(int(self.getOrDefault("sizes")[f]))),
                f"{f}__rate": F.coalesce(f"{f}__rate", F.lit(float(self.getOrDefault("overall")))),
            })
        return out

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _TableWriter(MLWriter):
    def __init__(self, instance: CategoryTableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CategoryTableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.table = self.sparkSession.read.parquet(f"{path}/table")
        return model


def category_models(counts: DataFrame, features: Sequence[str], without: Sequence[int | None], fills: Sequence[dict[str, str]]) -> list[CategoryTableModel]:
    """One model for each set of rows: all (None) or those outside a fold. ``counts`` is from :func:`counted`; ``fills`` stands for null values, per set.

    Ordinals are those of all values, and the models share one stored table with a rate for each set: n / (n + 1) times the share of positives
    plus 1 / (n + 1) times that of all rows of the set; values that the set doesn't have get the share of all.
    """
    spark = counts.sparkSession
    overall = []
    for fold in without:
        one = counts.filter(F.col("feature") == features[0]) if features else counts
        total = (one if fold is None else one.filter(F.col("fold") != fold)).agg(F.sum("positives").cast("double") / F.sum("n")).first()[0]
        overall.append(total or 0.0)
    sets = []
    for k, (fold, fill) in enumerate(zip(without, fills)):
        rows = counts if fold is None else counts.filter(F.col("fold") != fold)
        value = F.col("value")
        for f, text in fill.items():
            value = F.when(F.col("value").isNull() & (F.col("feature") == f), F.lit(str(text))).otherwise(value)
        sets.append(rows.select("feature", value.alias("value"), F.lit(k).alias("k"), "n", "positives"))
    every = reduce(DataFrame.union, sets).filter("value is not null").groupBy("feature", "value").agg(
        *[F.sum(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(len(without)) for c in ("n", "positives")])
    rates = []
    for k, mean in enumerate(overall):
        n = F.col(f"n{k}").cast("double")
        own = n / (n + SMOOTHING) * (F.col(f"positives{k}") / n) + (1 - n / (n + SMOOTHING)) * mean
        rates.append(F.coalesce(own, F.lit(mean)))
    table = _stored(every.select("feature", "value", F.array(*rates).alias("rates")), "category-rates")
    table = _stored(table.join(ordinals(table.select("feature", "value")), ["feature", "value"]), "category-table")
    found = {r["feature"]: r["n"] for r in table.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    sizes = {f: int(found.get(f, 0)) for f in features}
    out = []
    for k, mean in enumerate(overall):
        model = CategoryTableModel(features=list(features), sizes=sizes, overall=float(mean), slot=k)
        model.table = table
        out.append(model)
    return out


def empty_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "feature string, value string, rates array<double>, ordinal int")
