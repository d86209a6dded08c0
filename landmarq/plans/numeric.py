"""Registered queries over vectors: kernels, selectors, search, representations, fitted models. ``kernel_sql`` has SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import total
from ..operators import embedding, evolution, geometry, groups, kernels, metrics, models, objectives, panel, prepare, quotas, selectors
from . import kernel_sql
from . import units as tables
from .experiment import Settings, championship_of, run_experiment
from .queries import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

K, FEATURES = 40, 128
#: Units whose pairs give a bandwidth, here and in the SQL.
SAMPLE = 500


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _bandwidth(rows: DataFrame) -> float:
    return geometry.median_squared_distance(rows, SAMPLE) / 2


def _candidates(rows: DataFrame, count: int = 12) -> DataFrame:
    return quotas.random_candidates(rows, count, K, seed=1)


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = prepare.stratified_split(rows, 0.2, seed=11)
    return marked.where(~F.col("is_test")), marked.where("is_test")


def _target(rows: DataFrame) -> DataFrame:
    """A target that depends on the vector, and classes of it."""
    flat = rows.withColumn("y", F.round(total(F.slice("vec", 1, 8)) + 0.5 * F.element_at("vec", 9) * F.element_at("vec", 10), 9))
    return flat.withColumn("y_class", (F.col("y") > 0).cast("int"))


def _figures(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "metric string, value double")


@query
def random_feature_mmd(spark, d):
    rows = tables.vectors(spark, d)
    return kernels.mmd2(rows, _candidates(rows), kernels.RandomFeatures.build(64, FEATURES, _bandwidth(rows)))


@query
def sinkhorn_divergence(spark, d):
    rows = tables.vectors(spark, d)
    return kernels.sinkhorn(rows, _candidates(rows), kernels.Anchors.build(rows, 32))


@query
def log_determinant(spark, d):
    rows = tables.vectors(spark, d)
    return kernels.log_determinants(rows, _candidates(rows), _bandwidth(rows))


@query
def candidate_symmetric_kl(spark, d):
    rows = tables.vectors(spark, d)
    return geometry.subset_symmetric_kl(rows, _candidates(rows))


@query
def leverage_scores(spark, d):
    rows = tables.vectors(spark, d)
    return kernels.leverage_scores(rows, kernels.RandomFeatures.build(64, FEATURES, _bandwidth(rows))).select("unit_id", "leverage")


@query
def leverage_selection(spark, d):
    rows = tables.vectors(spark, d)
    return selectors.leverage_select(rows, K, _bandwidth(rows), FEATURES)


@query
def kernel_evaluation(spark, d):
    """Kernel error, principal-component distortion and ridge error of a selection, on all other units."""
    rows = _target(tables.vectors(spark, d))
    chosen = selectors.select(rows, "farthest", K, seed=3)
    rest = rows.join(chosen.select("unit_id"), "unit_id", "left_anti")
    train, test = _split(rest)
    _, points = kernels.matrix(geometry.chosen_vectors(rows, chosen))
    model = kernels.Nystrom.fit(points, _bandwidth(rows))
    scored = kernels.kernel_ridge(train, test, model, "y").withColumn("y_true", F.col("y"))
    from ..operators.metrics import regression_metrics

    error = regression_metrics(scored).first()
    return _figures(spark, nystrom_error=kernels.nystrom_error(rest, model), kpca_distortion=kernels.kernel_pca_distortion(rest, model), krr_rmse=error["rmse"], krr_m_r2=error["r2"])


def _selector(method: str) -> None:
    def exact(spark, d):
        rows = tables.vectors(spark, d)
        return selectors.select(rows, method, K, seed=3, sigma_sq=_bandwidth(rows))

    def by_quota(spark, d):
        rows = tables.vectors(spark, d)
        wanted = quotas.quota_counts(groups.group_shares(rows, weight=None), K)
        return selectors.select(rows, method, quotas=wanted, seed=3, sigma_sq=_bandwidth(rows))

    QUERIES[f"select_{method}"], QUERIES[f"select_{method}_quota"] = exact, by_quota


for _method in selectors.METHODS:
    _selector(_method)


@query
def select_kmeans_distributed(spark, d):
    return selectors.kmeans_select(tables.vectors(spark, d), K, seed=3)


@query
def select_global_then_quota(spark, d):
    rows = tables.vectors(spark, d)
    return selectors.global_then_quota(rows, "herding", quotas.quota_counts(groups.group_shares(rows, weight=None), K), K, seed=3, sigma_sq=_bandwidth(rows))


def _objectives(rows: DataFrame):
    features = kernels.RandomFeatures.build(64, FEATURES, _bandwidth(rows))
    whole = features.mean(rows)
    anchors = kernels.Anchors.build(rows, 24)
    score = lambda x: {"mmd2": float(((features(x).mean(axis=0) - whole) ** 2).sum()), "sinkhorn": anchors.divergence(x)}
    return lambda candidates: kernels.per_candidate(rows, candidates, score, ["mmd2", "sinkhorn"])


@query
def search_front(spark, d):
    rows = tables.vectors(spark, d).withColumn("weight", F.lit(1.0))
    found = evolution.search(rows, 24, _objectives(rows), ["mmd2", "sinkhorn"], {"count": 0.05}, population=12, generations=3, seed=5)
    return found.frame(spark)


@query
def search_front_quota(spark, d):
    rows = tables.vectors(spark, d)
    wanted = quotas.quota_counts(groups.group_shares(rows, weight=None), 24)
    found = evolution.search(rows, 24, _objectives(rows), ["mmd2", "sinkhorn"], quotas=wanted, population=12, generations=3, seed=5)
    return found.frame(spark)


@query
def principal_components(spark, d):
    return embedding.fit_components(tables.vectors(spark, d), 8).embed(tables.vectors(spark, d)).select("unit_id", F.posexplode("pca").alias("component", "value"))


@query
def explained_variance(spark, d):
    model = embedding.fit_components(tables.vectors(spark, d), 16)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(model.explained, embedding.explained_variance(model)))]
    return spark.createDataFrame(rows, "component int, share double, running double")


@query
def incremental_components(spark, d):
    rows = tables.vectors(spark, d)
    model = embedding.IncrementalComponents(4).add(rows.where("unit_id % 2 = 0")).add(rows.where("unit_id % 2 = 1")).fit()
    return model.embed(rows).select("unit_id", F.posexplode("pca").alias("component", "value"))


@query
def autoencoder_embedding(spark, d):
    rows = tables.vectors(spark, d)
    model = embedding.Autoencoder(embedding.MixedColumns(tuple(range(64))), 6, 32).fit(rows, epochs=10)
    return model.embed(rows).select("unit_id", "latent", "latent_var")


@query
def downstream_models(spark, d):
    train, test = _split(_target(tables.vectors(spark, d)))
    return models.evaluate_all(train, test, ["y"], ["y_class"])


@query
def panel_models(spark, d):
    rows = panel.lagged(tables.panel(spark, d), ["value"], 3, tie="event_id")
    cut = rows.agg(F.percentile(F.col("time").cast("timestamp").cast("double"), 0.8).alias("q")).first()["q"]
    late = F.col("time").cast("timestamp").cast("double") > F.lit(cut)
    return panel.evaluate_panel(rows.where(~late), rows.where(late), ["value_lag1", "value_lag2", "value_lag3"], "value", group="grp")


@query
def panel_fixed_effects(spark, d):
    rows = panel.lagged(tables.panel(spark, d), ["value"], 2, tie="event_id")
    cut = rows.agg(F.percentile(F.col("time").cast("timestamp").cast("double"), 0.8).alias("q")).first()["q"]
    late = F.col("time").cast("timestamp").cast("double") > F.lit(cut)
    return panel.evaluate_panel(rows.where(~late), rows.where(late), ["value_lag1", "value_lag2"], "value", ["ols", "ridge"], entity="entity")


@query
def experiment(spark, d):
    return run_experiment(_target(tables.vectors(spark, d)), Settings(k=24, methods=("uniform", "farthest", "herding"), replicates=2), "y")


@query
def experiment_championship(spark, d):
    return championship_of(run_experiment(_target(tables.vectors(spark, d)), Settings(k=24, methods=("uniform", "farthest", "leverage"), replicates=2), "y"))


@query
def bootstrap_targets(spark, d):
    from .experiment import bootstrap_evaluation

    rows = _target(tables.vectors(spark, d))
    chosen = {m: selectors.select(rows, m, 24, seed=2) for m in ("uniform", "farthest")}
    values = np.arange(64)
    wide = rows.select("unit_id", "grp", "vec", *(F.element_at("vec", int(i) + 1).alias(f"t{i}") for i in values))
    return bootstrap_evaluation(wide, chosen, [f"t{i}" for i in values], draws=3, size=2)


@query
def objective_table(spark, d):
    rows = tables.vectors(spark, d)
    return objectives.Objectives.build(rows, FEATURES, 32, sample=SAMPLE).table(_candidates(rows))


@query
def objectives_with_shares(spark, d):
    rows = tables.vectors(spark, d)
    return objectives.Objectives.build(rows, FEATURES, 32, sample=SAMPLE).with_shares(rows, _candidates(rows), groups.group_shares(rows, weight=None))


@query
def mmd_between_selections(spark, d):
    rows = tables.vectors(spark, d)
    one, two = quotas.uniform_sample(rows, K, seed=1), quotas.uniform_sample(rows, K, seed=2)
    return _figures(spark, mmd2=objectives.mmd2_between(rows, one, two, kernels.RandomFeatures.build(64, FEATURES, _bandwidth(rows))))


@query
def determinantal_sample(spark, d):
    rows = tables.vectors(spark, d)
    if rows.count() > kernels.EIGEN_ROWS:
        return selectors.draw_determinantal(rows, 20, _bandwidth(rows)).select("unit_id")
    ids, x = kernels.matrix(rows)
    chosen = selectors.sample_determinantal(kernels.gaussian(x, x, _bandwidth(rows)), 20, np.random.default_rng(0))
    return spark.createDataFrame([(int(ids[i]),) for i in chosen], "unit_id long")


@query
def cross_space_alignment(spark, d):
    rows = tables.vectors(spark, d)
    spaces = {"raw": rows, "pca": embedding.embed_space(rows, "pca", 8)}
    both = objectives.cross_space(spaces, _candidates(rows))
    out = None
    for name in ("mmd2", "sinkhorn"):
        one = metrics.spearman(both, f"{name}_raw", f"{name}_pca").withColumn("objective", F.lit(name))
        out = one if out is None else out.union(one)
    return out


@query
def proxy_stability(spark, d):
    from .experiment import proxy_stability as stability

    rows = tables.vectors(spark, d)
    return stability(rows, _candidates(rows), (32, 256))


@query
def search_growing_limits(spark, d):
    rows = tables.vectors(spark, d).withColumn("weight", F.lit(1.0))
    found, limits = evolution.search_with_growing_limits(rows, 24, _objectives(rows), ["mmd2", "sinkhorn"], population=10, generations=2, rounds=2)
    return found.frame(spark).withColumn("limit", F.lit(limits["count"]))


@query
def selection_scores(spark, d):
    from .reports import score_selections

    rows = _target(tables.vectors(spark, d))
    stored = None
    for method in ("uniform", "farthest"):
        one = selectors.select(rows, method, 24, seed=2).withColumn("method", F.lit(method))
        stored = one if stored is None else stored.union(one)
    return score_selections(rows, stored, "y")


@query
def selection_times(spark, d):
    from .reports import time_methods

    rows = tables.vectors(spark, d)
    return time_methods(rows, ("uniform", "farthest"), (10, 40)).select("method", "k", "repeat", (F.col("seconds") > 0).alias("timed"))


#: Digits that another engine's sums agree on, where fewer than six.
DIGITS = {"objective_table": 4, "objectives_with_shares": 4, "sinkhorn_divergence": 4, "principal_components": 5, "incremental_components": 5, "candidate_symmetric_kl": 4, "log_determinant": 4, "leverage_scores": 5, "leverage_selection": 5}


def _rounded(function: Callable[[SparkSession, str], DataFrame], digits: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rounded(function(spark, d), digits)


for _name in kernel_sql.ORACLE_SQL:
    QUERIES[_name] = _rounded(QUERIES[_name], DIGITS.get(_name, 6))
