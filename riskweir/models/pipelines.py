"""Pipelines: training-only fills, dictionaries of categories, boosted trees and a plain tree.

Preparing a feature does not depend on the other features, so the preparation is fitted once per
training frame and every feature configuration only picks its own columns.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import partial

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from riskweir.models import boosting as bt
from riskweir.models.categories import CategoryTable, CategoryTableModel, category_models, counted
from riskweir.models.scoring import concurrently
from riskweir.operators.fill import Fills, fill_dict, impute
from riskweir.schema import FEATURES, ID, LABEL, FeatureGroups

SEED = 42
MODELS = ("gbt_onehot", "gbt_encoded")
ROUNDS = 300
#: Rows of a partition that the plain tree is fitted on: it holds a number for every row and part of a vector.
TREE_ROWS = 1 << 17

# Default settings of the two boosted candidates.
DEFAULTS = {
    "gbt_onehot": {"rate": 0.05, "depth": 4, "least_weight": 2.0, "row_share": 0.8, "column_share": 0.8, "l2": 1.0},
    "gbt_encoded": {"rate": 0.05, "depth": 6, "l2": 3.0},
}


class _FillParams(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric features", TypeConverters.toListString)
    boolean = Param(Params._dummy(), "boolean", "boolean features", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical features", TypeConverters.toListString)

    def groups(self) -> FeatureGroups:
        return FeatureGroups(*(tuple(self.getOrDefault(p)) for p in ("numeric", "boolean", "categorical")))


class TrainFill(Estimator, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns one fill value per feature from the rows it is fitted on."""

    booleanFill = Param(Params._dummy(), "booleanFill", "median or mode", TypeConverters.toString)

    @keyword_only
    def __init__(self, numeric=None, boolean=None, categorical=None, booleanFill="median"):
        super().__init__()
        self._setDefault(numeric=[], boolean=[], categorical=[], booleanFill="median")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TrainFillModel:
        groups = self.groups()
        return fill_model(groups, fill_dict(dataset, groups, self.getOrDefault("booleanFill")))


class TrainFillModel(Model, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces missing values by the learned fills."""

    fills = Param(Params._dummy(), "fills", "fill value per feature", TypeConverters.identity)

    @keyword_only
    def __init__(self, numeric=None, boolean=None, categorical=None, fills=None):
        super().__init__()
        self._setDefault(numeric=[], boolean=[], categorical=[], fills={})
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        groups, fills = self.groups(), self.getOrDefault("fills")
        absent = sorted(set(groups.all).difference(fills))
        if absent:
            raise ValueError(f"Fill state is incomplete: {absent}")
        return impute(dataset, groups, fills)


def fill_model(groups: FeatureGroups, fills: Fills) -> TrainFillModel:
    return TrainFillModel(
        numeric=list(groups.numeric), boolean=list(groups.boolean), categorical=list(groups.categorical),
        fills={f: fills[f] for f in groups.all},
    )


def fill_rule(name: str) -> str:
    """How boolean features are filled in a path."""
    return "mode" if name != "gbt_encoded" else "median"


def encoders(name: str, groups: FeatureGroups) -> list:
    """Stages after the fill that turn categories into vector parts. Unseen ones become all zeros (one-hot) or the overall rate (encoded)."""
    texts = list(groups.categorical)
    if not texts:
        return []
    table = CategoryTable(features=texts)
    if name != "gbt_encoded":
        # Values that were never seen have an index beyond those that the encoder knows, and get no place.
        return [table, OneHotEncoder(inputCols=[f"{f}__index" for f in texts], outputCols=[f"{f}__onehot" for f in texts], dropLast=True, handleInvalid="keep")]
    return [table, SQLTransformer(statement="SELECT *, " + ", ".join(f"{f}__rate AS {f}__mean" for f in texts) + " FROM __THIS__")]


def assembler(name: str, groups: FeatureGroups) -> VectorAssembler:
    suffix = "__mean" if name == "gbt_encoded" else "__onehot"
    return VectorAssembler(inputCols=[*groups.continuous, *[f + suffix for f in groups.categorical]], outputCol="features")


def settings(name: str, params: dict | None = None, rounds: int = ROUNDS) -> bt.Settings:
    """Settings of a boosted model: its defaults, or what ``params`` says, which may have its own number of rounds."""
    if name not in MODELS:
        raise ValueError(f"There is no boosted model {name!r}; there are {', '.join(MODELS)}.")
    return bt.Settings(**({"rounds": rounds} | (DEFAULTS[name] if params is None else params)))


def tree_inputs(name: str, groups: FeatureGroups) -> dict[str, str | None]:
    """Columns that the trees of a family read: numbers, and for each category its rate or its index."""
    suffix = "__rate" if name == "gbt_encoded" else "__index"
    return {f: None for f in groups.continuous} | {f + suffix: f for f in groups.categorical}


def row_key(df: DataFrame) -> Column:
    """Tells rows apart in draws: the id, or all columns where there is none."""
    return F.xxhash64(F.col(ID).cast("string")) if ID in df.columns else F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))


class BoostedTrees(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees over filled rows with their category columns; settings are those of :class:`boosting.Settings`, one param each."""

    family = Param(Params._dummy(), "family", "gbt_onehot or gbt_encoded", TypeConverters.toString)
    numeric = Param(Params._dummy(), "numeric", "numeric and boolean features", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical features", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    others = Param(Params._dummy(), "others", "the other settings", TypeConverters.identity)

    @keyword_only
    def __init__(self, family="gbt_encoded", numeric=None, categorical=None, labelCol=LABEL, seed=SEED, rounds=ROUNDS, depth=6, others=None):
        super().__init__()
        self._setDefault(family="gbt_encoded", numeric=[], categorical=[], labelCol=LABEL, seed=SEED, rounds=ROUNDS, depth=6, others={})
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        get = self.getOrDefault
        chosen = bt.Settings(**get("others"), rounds=get("rounds"), depth=get("depth"))
        groups = FeatureGroups(tuple(get("numeric")), (), tuple(get("categorical")))
        inputs = tree_inputs(get("family"), groups)
        numbers = [c for c in inputs if not c.endswith("__index")]
        sizes = dataset.agg(*[F.max(c).alias(c) for c in inputs if c not in numbers], F.lit(0)).first().asDict()
        blocks = bt.make_blocks(dataset, bt.bin_edges(dataset, numbers), {c: (sizes[c] or 0) + 1 for c in inputs if c not in numbers}, get("labelCol"), row_key(dataset))
        fit = bt.Fit("one", tuple(inputs), {}, chosen, seed=get("seed"))
        return boosted_model(bt.fit_many(blocks, [fit])["one"], blocks.columns, fit)


class BoostedModel(Model, MLReadable, MLWritable):
    """Adds ``probability``, the vector of both classes, computed in Arrow batches from the columns that the trees read."""

    columns = Param(Params._dummy(), "columns", "columns of the trees, as JSON", TypeConverters.toString)
    chosen = Param(Params._dummy(), "chosen", "settings of the trees, as JSON", TypeConverters.toString)
    base = Param(Params._dummy(), "base", "log-odds without any tree", TypeConverters.toFloat)
    numClasses = 2

    @keyword_only
    def __init__(self, columns="[]", chosen="{}", base=0.0):
        super().__init__()
        self._setDefault(columns="[]", chosen="{}", base=0.0)
        self._set(**self._input_kwargs)
        self.trees: bt.Trees | None = None

    def tree_columns(self) -> list[bt.Column]:
        return [bt.Column(c["name"], tuple(c["edges"]), c["size"]) for c in json.loads(self.getOrDefault("columns"))]

    def inputs(self) -> Column:
        return F.array(*[F.col(f"`{c.name}`").cast("double") for c in self.tree_columns()])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # Trees and bins go to the workers once, not with every task.
        shared = dataset.sparkSession.sparkContext.broadcast((self.trees, self.tree_columns()))

        @F.pandas_udf("double")
        def positive(cells: pd.Series) -> pd.Series:
            trees, columns = shared.value
            return pd.Series(1 / (1 + np.exp(-bt.margins(trees, codes_of(cells, columns), np.array([c.size > 0 for c in columns])))))

        p = F.col("_p")
        return dataset.withColumn("_p", positive(self.inputs())).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_p")

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader(cls)


def codes_of(cells: pd.Series, columns: Sequence[bt.Column]) -> np.ndarray:
    """[column, row] codes of rows given as arrays of cells."""
    table = np.stack(cells.to_numpy()).astype(float).T if len(cells) else np.empty((len(columns), 0))
    out = np.empty(table.shape, np.int64)
    for i, c in enumerate(columns):
        none = np.isnan(table[i])
        own = np.where(none, 0, table[i]) if c.size else np.searchsorted(c.edges, table[i], "left")
        out[i] = np.where(none, c.width - 1, own)
    return out


class _TreesWriter(MLWriter):
    def __init__(self, instance: BoostedModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        _, *arrays = self.instance.trees
        rows = [(k, *(a[k].tolist() for a in arrays)) for k in range(len(arrays[0]))]
        schema = "tree int, column array<int>, cut array<int>, value array<double>, cover array<bigint>"
        self.sparkSession.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/trees")


class _TreesReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()  # a row per tree
        types = {"column": np.int32, "cut": np.int32, "value": float, "cover": np.int64}
        model.trees = bt.Trees(model.getOrDefault("base"), *(np.array([r[c] for r in rows], t).reshape(len(rows), -1) for c, t in types.items()))
        return model


def boosted_model(trees: bt.Trees, columns: Sequence[bt.Column], fit: bt.Fit) -> BoostedModel:
    """The model of a fit, with the columns that its trees use alone."""
    place = {c.name: i for i, c in enumerate(columns)}
    own = [place[c] for c in fit.columns]
    renumbered = np.full(len(columns) + 1, -1, np.int32)
    renumbered[own] = np.arange(len(own))
    document = [{"name": columns[i].name, "edges": columns[i].edges, "size": columns[i].size} for i in own]
    shown = {f.name: getattr(fit.settings, f.name) for f in fields(fit.settings)} | {"seed": fit.seed}
    model = BoostedModel(columns=json.dumps(document), chosen=json.dumps(shown, sort_keys=True), base=float(trees.base))
    model.trees = trees._replace(column=renumbered[trees.column])
    return model


def build_model(
    name: str, groups: FeatureGroups = FEATURES, configuration: str = "default", params: dict | None = None,
    rounds: int = ROUNDS, seed: int = SEED,
) -> Pipeline:
    """A whole pipeline by name. ``configuration`` says whose settings it has: ``default`` means the library's, ``tuned`` those in ``params``."""
    given = {"default": not params, "tuned": bool(params)}
    if not given.get(configuration, False):
        raise ValueError(f"A pipeline is either default, without settings, or tuned, with some; asked for {configuration!r} with {params or 'none'}.")
    chosen = settings(name, params or None, rounds)
    fill = TrainFill(
        numeric=list(groups.numeric), boolean=list(groups.boolean), categorical=list(groups.categorical), booleanFill=fill_rule(name))
    others = {f.name: getattr(chosen, f.name) for f in fields(chosen) if f.name not in ("rounds", "depth")}
    trees = BoostedTrees(
        family=name, numeric=list(groups.continuous), categorical=list(groups.categorical), seed=seed, rounds=chosen.rounds, depth=chosen.depth, others=others)
    return Pipeline(stages=[fill, *([CategoryTable(features=list(groups.categorical))] if groups.categorical else []), trees])


def candidate_models(groups: FeatureGroups = FEATURES, rounds: int = ROUNDS, seed: int = SEED) -> dict[str, Pipeline]:
    return {name: build_model(name, groups, rounds=rounds, seed=seed) for name in MODELS}


@dataclass(frozen=True)
class Case:
    """One fit of a preparation: the features it uses (None: all) and its settings (None: the defaults with ``rounds``)."""

    features: FeatureGroups | None = None
    params: dict | None = None
    rounds: int = ROUNDS
    seed: int = SEED


@dataclass(frozen=True)
class Prepared:
    """A fitted preparation of one path over a frame whose blocks it may share with others; ``without`` is the fold that its rows leave out."""

    name: str
    groups: FeatureGroups
    stages: list[Transformer]
    blocks: bt.Blocks
    without: int | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel(self.stages).transform(df)

    def columns(self, groups: FeatureGroups) -> dict[str, str]:
        """Columns of the blocks by the names that rows have them under; rates of a fold have names of their own there."""
        suffix = "" if self.without is None else f"__{self.without}"
        return {c: c + suffix if c.endswith("__rate") else c for c in tree_inputs(self.name, groups)}

    def spec(self, name: str, case: Case) -> bt.Fit:
        chosen = case.features or self.groups
        held, fills = {c.name: c for c in self.blocks.columns}, self.stages[0].getOrDefault("fills")
        codes = {f: held[f].code(float(fills[f])) for f in chosen.continuous}
        codes |= {f"{f}__index": int(fills[f"{f}__index"]) for f in chosen.categorical if f"{f}__index" in fills}
        columns = tuple(self.columns(chosen).values())
        return bt.Fit(name, columns, {c: k for c, k in codes.items() if c in columns}, settings(self.name, case.params, case.rounds), self.without, case.seed)

    def model(self, trees: bt.Trees, fit: bt.Fit) -> PipelineModel:
        """A model whose stages start at raw features."""
        fitted = boosted_model(trees, self.blocks.columns, fit)
        suffix = "" if self.without is None else f"__{self.without}"
        if suffix:
            fitted._set(columns=json.dumps([c | {"name": c["name"].removesuffix(suffix)} for c in json.loads(fitted.getOrDefault("columns"))]))
        return PipelineModel([*self.stages, fitted])

    def fit(self, features: FeatureGroups | None = None, params: dict | None = None, rounds: int = ROUNDS, seed: int = SEED) -> PipelineModel:
        return fit_cases([(self, Case(features, params, rounds, seed))])[0]

    def release(self) -> None:
        """Blocks are tables in the shared folder; there is nothing to let go of."""


def fit_cases(cases: Sequence[tuple[Prepared, Case]]) -> list[PipelineModel]:
    """All fits, those over the same blocks at once, and those over other blocks beside them."""
    out: list[PipelineModel | None] = [None] * len(cases)
    frames = {id(p.blocks): p.blocks for p, _ in cases}

    def run(key: int) -> None:
        mine = {str(i): (p, p.spec(str(i), case)) for i, (p, case) in enumerate(cases) if id(p.blocks) == key}
        found = bt.fit_many(frames[key], [fit for _, fit in mine.values()])
        for i, (p, fit) in mine.items():
            out[int(i)] = p.model(found[i], fit)

    if frames:
        concurrently(next(iter(frames.values())).spark, [partial(run, key) for key in frames])
    return out


def prepare(name: str, train: DataFrame, groups: FeatureGroups = FEATURES, fills: Fills | None = None) -> Prepared:
    """Fit fill and dictionary on ``train``, and bin its rows once for all fits that follow."""
    return prepare_sets(name, train, groups, [None], [fills or fill_dict(train, groups, fill_rule(name))])[0]


def prepare_sets(name: str, train: DataFrame, groups: FeatureGroups, without: Sequence[int | None], fills: Sequence[Fills], fold: str | None = None) -> list[Prepared]:
    """Preparations over the rows outside each fold (None: all rows), with fills learned on them. They share one dictionary and one binned frame:
    a missing cell has a code of its own there, for which each fit has its fill, and a category a rate for each fold."""
    texts = list(groups.categorical)
    numbers = list(groups.continuous)
    tables: list[CategoryTableModel | None] = [None] * len(without)
    wide = train.select(*(c for c in train.columns if c in {ID, LABEL, fold, *groups.all}))
    rates: list[str] = []
    key = row_key(wide)
    wide = wide.withColumn("__key", key)
    if texts:
        tables = category_models(counted(train, texts, LABEL, fold), texts, without, [{f: fill[f] for f in texts} for fill in fills])
        if name == "gbt_encoded":
            for k, table, fill in zip(without, tables, fills):
                suffix = "" if k is None else f"__{k}"
                raw = [F.col(f).alias(f"{f}__raw") for f in texts]
                filled = wide.select("*", *raw).withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit(str(fill[f]))) for f in texts})
                coded = table.transform(filled).withColumns({f: F.col(f"{f}__raw") for f in texts})
                names = {f"{f}__rate{suffix}": F.col(f"{f}__rate") for f in texts}
                wide = coded.select(*wide.columns, *(c.alias(n) for n, c in names.items()))
                rates += names
        else:
            coded = tables[0].transform(wide)
            wide = coded.select(*wide.columns, *(F.when(F.col(f).isNotNull(), F.col(f"{f}__index")).alias(f"{f}__index") for f in texts))
    numbers += rates
    sizes = {f"{f}__index": tables[0].getOrDefault("sizes")[f] for f in texts} if texts and name != "gbt_encoded" else {}
    blocks = bt.make_blocks(wide, bt.bin_edges(wide, numbers), sizes, LABEL, F.col("__key"), fold)
    out = []
    for k, table, fill in zip(without, tables, fills):
        codes = {}
        if sizes:  # the index that stands for a missing category
            named = table.table.filter(F.concat_ws("=", "feature", "value").isin([f"{f}={fill[f]}" for f in texts])).select("feature", "ordinal").collect()
            codes = {f"{r['feature']}__index": r["ordinal"] for r in named}
        filled = fill_model(groups, fill)
        filled._set(fills=filled.getOrDefault("fills") | codes)
        out.append(Prepared(name, groups, [filled, *([table] if table else [])], blocks, k))
    return out


@dataclass(frozen=True)
class PreparedTree:
    """The preparation of the plain tree: MLlib's classifier over vectors."""

    groups: FeatureGroups
    stages: list[Transformer]
    train: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel(self.stages).transform(df)

    def fit(self, features: FeatureGroups | None = None, seed: int = SEED) -> PipelineModel:
        """A tree of six levels with at least twenty rows a leaf."""
        columns = assembler("tree", features or self.groups)
        tree = DecisionTreeClassifier(labelCol=LABEL, maxDepth=6, minInstancesPerNode=20, impurity="gini", seed=seed)
        return PipelineModel([*self.stages, columns, tree.fit(columns.transform(self.train).select(LABEL, "features"))])

    def release(self) -> None:
        self.train.unpersist()


def prepare_vectors(name: str, train: DataFrame, groups: FeatureGroups = FEATURES) -> PreparedTree:
    """Fill and encoders fitted on ``train``; the prepared rows stay cached for the fits that follow."""
    filled = fill_model(groups, fill_dict(train, groups, fill_rule(name)))
    encoded = Pipeline(stages=encoders(name, groups)).fit(filled.transform(train))
    stages = [filled, *encoded.stages]
    columns = assembler(name, groups).getInputCols()
    return PreparedTree(groups, stages, _bounded(PipelineModel(stages).transform(train).select(LABEL, *columns), train.count()).persist())


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Partitions of TREE_ROWS rows where the cores would have more each, so that what a task reads doesn't grow with the table."""
    return df.repartition(-(-rows // TREE_ROWS)) if rows > TREE_ROWS * df.sparkSession.sparkContext.defaultParallelism else df
