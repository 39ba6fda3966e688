"""Registered queries around fitted models; they have no SQL counterpart.

They run with the library's defaults, the published numbers: 300 boosting rounds, 200 to 1000 searched, 40 trials. README has measured times.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweir.models import ablation as ab, artifact, search as tune
from riskweir.models.importance import permutation_importance, shapley_importance
from riskweir.models.pipelines import MODELS, ROUNDS, assembler, prepare_vectors
from riskweir.operators import compare, identity, split
from riskweir.plans import investigation as inv, modeling
from riskweir.plans.modeling import part
from riskweir.schema import FEATURES, ID, LABEL
from riskweir.session import scratch
from riskweir.sources import testbed as tb

TRIALS = 40
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _vectors(spark, sf, name):
    parts = tb.split_merchants(spark, sf)
    prepared = prepare_vectors(name, part(parts, "train"))
    try:
        wide = assembler(name, FEATURES).transform(PipelineModel(prepared.stages).transform(parts))
    finally:
        prepared.release()
    vector = vector_to_array("features")
    return wide.select(ID, "split", F.size(vector).alias("width"), F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query
def onehot_features(spark, sf):
    return _vectors(spark, sf, "gbt_onehot")


@query
def encoded_features(spark, sf):
    return _vectors(spark, sf, "gbt_encoded")


@query
def model_comparison(spark, sf):
    return modeling.compare_models(tb.merchants_raw(spark, sf), ROUNDS).table


@query
def cv_average_precision(spark, sf):
    train = part(tb.split_merchants(spark, sf), "train")
    rows = []
    for name in MODELS:
        folds = tune.make_folds(name, train)
        try:
            found = tune.cross_validate(folds, [None], ROUNDS)[0]
        finally:
            tune.release(folds)
        rows += [(name, i, score) for i, score in enumerate(found.fold_scores)]
    return compare.fold_summary(spark.createDataFrame(rows, "model string, fold int, pr_auc double"), ["model"])


@query
def param_search(spark, sf):
    train = part(tb.split_merchants(spark, sf), "train")
    found = []
    for name in MODELS:
        folds = tune.make_folds(name, train)
        try:
            found.append(tune.search(name, folds, TRIALS))
        finally:
            tune.release(folds)
    return compare.running_best(tune.trials_table(spark, found))


def _tuning(spark, sf):
    return modeling.run_tuning(tb.split_merchants(spark, sf), trials=dict.fromkeys(MODELS, TRIALS))


@query
def tuned_vs_default(spark, sf):
    return _tuning(spark, sf).validation


@query
def final_evaluation(spark, sf):
    return _tuning(spark, sf).final


def _ablation(spark, sf, configurations):
    parts = tb.split_merchants(spark, sf)
    return inv.table(spark, inv.on_split(parts, FEATURES, configurations, "validation", ROUNDS))


@query
def group_ablation(spark, sf):
    return _ablation(spark, sf, ab.group_configurations(FEATURES))


@query
def leave_one_out_ablation(spark, sf):
    return compare.with_delta(_ablation(spark, sf, ab.leave_one_out(FEATURES)), "none_removed")


@query
def missingness_ablation(spark, sf):
    return inv.table(spark, inv.missingness_ablation(tb.split_merchants(spark, sf), rounds=ROUNDS))


def _models(spark, sf):
    parts = tb.split_merchants(spark, sf)
    prepared = ab.prepare_all(part(parts, "train"), FEATURES)
    try:
        return parts, ab.fit_models(prepared, ROUNDS)
    finally:
        ab.release_all(prepared)


@query
def permutation_importances(spark, sf):
    parts, models = _models(spark, sf)
    return permutation_importance(models, part(parts, "validation"), FEATURES)


@query
def shapley_importances(spark, sf):
    parts, models = _models(spark, sf)
    return shapley_importance(models, part(parts, "validation"))


@query
def reduced_features(spark, sf):
    parts, models = _models(spark, sf)
    ranking = compare.mean_importance(permutation_importance(models, part(parts, "validation"), FEATURES), "mean_importance")
    order = [r["feature"] for r in ranking.orderBy(F.col("mean_importance").desc(), "feature").collect()]
    return inv.table(spark, inv.on_split(parts, FEATURES, ab.reduced_configurations(order, FEATURES), "validation", ROUNDS))


@query
def test_confirmation(spark, sf):
    parts = tb.split_merchants(spark, sf)
    candidates = [ab.Configuration("original_baseline", tuple(FEATURES.all)), *ab.group_configurations(FEATURES)]
    shown = inv.on_split(parts, FEATURES, candidates, "validation", ROUNDS)
    best = compare.choose_configuration(inv.table(spark, shown)).first()["feature_configuration"]
    chosen = [c for c in candidates if c.name in ("original_baseline", best)]
    return inv.confirmation_table(spark, inv.confirmation(parts, FEATURES, chosen, shown, ROUNDS))


@query
def vendor_scenarios(spark, sf):
    return modeling.vendor_scenarios(tb.merchants_raw(spark, sf))[0]


@query
def vendor_scored_holdout(spark, sf):
    return modeling.vendor_scenarios(tb.merchants_raw(spark, sf))[1]


# An example of a stored choice for the artifact queries.
CONFIG = {
    "configuration": "tuned", "seed": 42,
    "parameters": {"rounds": ROUNDS, "rate": 0.1, "depth": 4, "row_share": 0.9, "l2": 3.0},
}


def _artifact(spark, sf):
    """Approval is recorded from the stored membership; the rows to fit on are then read from the merchants by that membership."""
    parts = tb.split_merchants(spark, sf)
    membership = tb.stored(parts.select(ID, LABEL, "split"), "membership")
    approved = split.development_rows(membership)
    record = identity.manifest(approved, reference="development")
    rows = split.members_of(tb.merchants(spark, sf), membership, ("train", "validation")).select(ID, *FEATURES.all)
    folder = scratch(spark, "artifact")
    artifact.build_artifact(rows, approved.select(ID, LABEL), CONFIG, record, folder)
    return parts, artifact.load_artifact(spark, folder, CONFIG)


@query
def build_and_score(spark, sf):
    parts, scorer = _artifact(spark, sf)
    rows = part(parts, "test").select(ID, *FEATURES.all)
    return scorer.decide(rows, (ID,), review_threshold=0.3, decline_threshold=0.6)


@query
def artifact_check(spark, sf):
    _, scorer = _artifact(spark, sf)
    m = scorer.manifest
    row = (m["model"], m["approved"]["rows"], m["approved"]["members"], len(m["features"]))
    return spark.createDataFrame([row], "model_identifier string, verified_row_count bigint, verified_membership string, n_features int")


@query
def staged_development(spark, sf):
    """Development rows of the staged evaluation, found from label and id alone."""
    raw = tb.stored(tb.merchants_raw(spark, sf), "raw")
    rows, _ = modeling.development_stage(raw)
    return rows


@query
def staged_test(spark, sf):
    """All rows, released only after the frozen membership was found unchanged."""
    raw = tb.stored(tb.merchants_raw(spark, sf), "raw")
    _, membership = modeling.development_stage(raw)
    return modeling.test_stage(raw, membership)

