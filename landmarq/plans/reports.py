"""Report tables over long results, and jobs that put several operators together."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite
from ..operators import comparison, evolution, geometry, metrics, prepare, quotas
from ..operators.groups import group_shares
from ..sources.sinks import build_once, save_splits
from .experiment import Settings, evaluate_selection, run_experiment, select_by

# Bounds that a metric of this name can't leave.
BOUNDS = (("kl", 0.0, None), ("rmse", 0.0, None), ("nystrom", 0.0, 1.5), ("kpca", 0.0, None), ("tau", -1.0, 1.0), ("kendall", -1.0, 1.0), ("accuracy", 0.0, 1.0), ("coverage", 0.0, None), ("distance", 0.0, None))


def table_summary(rows: DataFrame) -> DataFrame:
    """``column, n, missing, mean, std, least, most`` of the numeric columns; one scan."""
    columns = prepare.numeric_columns(rows)
    long = rows.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), finite(F.col(c)))))).alias("column", "value"))
    v = F.col("value")
    return long.groupBy("column").agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))


def chained_units(main: DataFrame, others: Sequence[DataFrame], key: str, group: str) -> DataFrame:
    """``main`` left-joined to each of ``others``; medians fill missing numbers, rows without a group go."""
    from ..operators.groups import coalesced_left_join

    out = main
    for other in others:
        out = coalesced_left_join(out, other, key)
    out = out.where(F.col(group).isNotNull())
    numbers = prepare.numeric_columns(out, [key])
    return prepare.impute_all(out, numbers) if numbers else out


def summary_by(results: DataFrame, keys: Sequence[str], how: str = "mean", digits: int = 4) -> DataFrame:
    """``mean`` or ``min`` of each metric by ``keys``."""
    value = finite(F.col("value"))
    return results.groupBy(*keys, "metric").agg(F.bround(F.avg(value) if how == "mean" else F.min(value), digits).alias("value"))


def metric_table(results: DataFrame, names: Sequence[str], rows: str = "method") -> DataFrame:
    """Methods by metrics, means in the cells."""
    return results.where(F.col("metric").isin(list(names))).groupBy(rows).pivot("metric", list(names)).agg(F.avg(finite(F.col("value"))))


def mark_best(results: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Adds ``best``: whether the value is its metric's optimum."""
    signed = F.when(comparison.higher_is_better(F.col("metric")), -F.col("value")).otherwise(F.col("value"))
    return results.withColumn("best", signed == F.min(signed).over(Window.partitionBy(*by)))


def out_of_bounds(results: DataFrame, bounds: Sequence[tuple[str, float | None, float | None]] = BOUNDS) -> DataFrame:
    """``metric, n, least, most`` of the metrics with values that can't be."""
    name, value = F.lower("metric"), finite(F.col("value"))
    wrong = F.lit(False)
    for word, low, high in bounds:
        own = name.contains(word)
        wrong = wrong | (own & F.coalesce((value < low) if low is not None else F.lit(False), F.lit(False))) | (own & F.coalesce((value > high) if high is not None else F.lit(False), F.lit(False)))
    return results.where(wrong).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def comparison_report(results: DataFrame, path: str, pairs: Mapping[str, str] | None = None, effect: tuple[str, str, str] | None = None) -> None:
    """Writes means, ranks, dominance and (where asked for) pairs and effects as Parquet under ``path``."""
    means = comparison.method_means(results).cache()
    frames = {"means": means, "ranks": comparison.rank_table(means), "dominance": comparison.dominance(means)}
    if pairs:
        frames["pairs"] = comparison.paired_comparison(means, pairs)
    if effect:
        frames["effects"] = comparison.effect_isolation(means, *effect)
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    means.unpersist()


def evaluate_auto(rows: DataFrame, targets: Sequence[str], most_classes: int = 20) -> DataFrame:
    """``target, metric, value``: regression or classification figures by what each target holds (``target, y_true, y_pred``)."""
    out = None
    for t in targets:
        own = rows.where(F.col("target") == t)
        kind = prepare.target_kind(own, "y_true", most_classes)
        found = metrics.classification_metrics(own) if kind == "classification" else metrics.regression_metrics(own)
        names = [c for c in found.columns if c != "n"]
        long = found.select(F.lit(t).alias("target"), *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["target"], names, "metric", "value")
        out = long if out is None else out.union(long)
    return out


def build_replicate(units: DataFrame, roles: Mapping[str, str], path: str, rep: int, evaluation_rows: int = 2000, validation: float = 0.1, seed: int = 0, rebuild: bool = False) -> DataFrame:
    """The prepared table of one replicate: splits first, then indicators, imputation, transforms and scaling fitted on training rows.

    Built once; a complete table at ``path`` is read back. Splits are stored beside it.
    """

    def build() -> DataFrame:
        marked = prepare.stratified_split(units, validation, f"{seed}|{rep}|validation", flag="is_validation").withColumn("is_train", ~F.col("is_validation"))
        shares = group_shares(marked, weight=None)
        total = shares.agg(F.sum("n").alias("n")).first()["n"]
        counts = quotas.proportional_counts(shares, min(evaluation_rows, total))
        marked = prepare.sample_by_group(marked, counts, f"{seed}|{rep}|evaluation")
        marked = prepare.split_within_groups(marked, 0.8, f"{seed}|{rep}|split", flag="is_eval_train").withColumn("is_eval_test", F.col("is_eval") & ~F.col("is_eval_train"))
        return prepare.prepare_features(marked, roles)

    stored = build_once(units.sparkSession, f"{path}/rep={rep}", build, ["is_train", "is_eval_test"], rebuild)
    save_splits(stored, f"{path}_splits/rep={rep}")
    return stored


def score_selections(units: DataFrame, selections: DataFrame, target: str | None, keys: Sequence[str] = ("method",), seed: int = 0) -> DataFrame:
    """``keys, metric, value`` of stored selections (``keys, unit_id``)."""
    sigma_sq = geometry.median_squared_distance(units, 500, seed=seed) / 2
    rows = []
    for row in selections.select(*keys).distinct().orderBy(*keys).collect():  # a row for each selection
        own = selections
        for k in keys:
            own = own.where(F.col(k).eqNullSafe(F.lit(row[k])))
        rows += [(*(str(row[k]) for k in keys), m, v) for m, v in sorted(evaluate_selection(units, own.select("unit_id"), target, sigma_sq, seed=seed).items())]
    return units.sparkSession.createDataFrame(rows, ", ".join([*(f"{k} string" for k in keys), "metric string", "value double"]))


def effort_sweep(units: DataFrame, settings: Settings, efforts: Sequence[tuple[int, int]], target: str | None = None) -> DataFrame:
    """``run_experiment`` of the search at each (population, generations), with both beside."""
    out = None
    for population, generations in efforts:
        one = run_experiment(units, replace(settings, search=True, methods=(), population=population, generations=generations, name=f"{settings.name}_{population}x{generations}"), target)
        one = one.withColumns({"population": F.lit(population), "generations": F.lit(generations)})
        out = one if out is None else out.unionByName(one)
    return out


def time_methods(units: DataFrame, methods: Sequence[str], grid: Sequence[int], regime: str = "exact", repeats: int = 1, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """``method, k, repeat, seconds`` of selecting; ``comparison.power_law`` fits its growth."""
    sigma_sq = geometry.median_squared_distance(units, 500) / 2
    rows = []
    for method in methods:
        for k in grid:
            for i in range(repeats):
                start = clock()
                select_by(units, method, regime, k, i, sigma_sq).count()
                rows.append((method, int(k), i, float(clock() - start)))
    return units.sparkSession.createDataFrame(rows, "method string, k int, repeat int, seconds double")


def repair_baseline(units: DataFrame, selection: DataFrame, k: int, limits: Mapping[str, float], seed: int = 0, keep_counts: bool = False) -> list:
    """Ids of a selection brought to ``k`` units and towards its limits, group counts as they are with ``keep_counts``; over ``evolution.MOST_UNITS`` units raise."""
    import numpy as np

    table = units.select("unit_id", F.coalesce(F.col("grp").cast("string"), F.lit("null")).alias("grp"), (F.greatest(F.coalesce(finite(F.col("weight")), F.lit(0.0)), F.lit(0.0)) if "weight" in units.columns else F.lit(1.0)).alias("w")).orderBy("unit_id").limit(evolution.MOST_UNITS + 1).toPandas()
    if len(table) > evolution.MOST_UNITS:
        raise ValueError(f"over {evolution.MOST_UNITS} units; repair among a sample of them")
    ids = table["unit_id"].to_numpy()
    _, groups = np.unique(table["grp"].to_numpy(), return_inverse=True)
    members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
    w = table["w"].to_numpy()
    bounds = [evolution.Proportionality(np.bincount(groups, w) / w.sum() if kind == "weight" else np.bincount(groups) / len(groups), w if kind == "weight" else None, 1.0, limit) for kind, limit in sorted(limits.items())]
    random = np.random.default_rng(seed)
    chosen = np.flatnonzero(np.isin(ids, [r["unit_id"] for r in selection.select("unit_id").distinct().collect()]))
    fixed = evolution.repair_constraints(evolution.repair_size(random, chosen, len(ids), k), groups, members, bounds, random, keep_counts)
    return ids[fixed].tolist()
