"""Panels: lagged features, fixed effects, and linear models of one period on those before."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linear import LinearModel, constrained_least_squares, elastic_net, expanding_folds, gram, least_squares, partial_least_squares, predict, ridge_by_folds
from .metrics import group_summary, regression_metrics


def lagged(rows: DataFrame, columns: Sequence[str], lags: int, entity: str = "entity", time: str = "time", tie: str | None = None) -> DataFrame:
    """Adds ``<column>_lag1`` to ``_lag<n>`` within each entity; rows without a full history go."""
    order = Window.partitionBy(entity).orderBy(time, *([tie] if tie else []))
    ahead = rows.withColumns({f"{c}_lag{n}": F.lag(c, n).over(order) for c in columns for n in range(1, lags + 1)}).withColumn("_place", F.row_number().over(order))
    return ahead.where(F.col("_place") > lags).drop("_place")


def entity_means(rows: DataFrame, columns: Sequence[str], entity: str = "entity") -> DataFrame:
    """``entity`` and a mean for each column, with one more row (null entity) of overall means; missing values are skipped."""
    own = rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(*(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in columns))
    whole = rows.agg(*(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in columns))
    return own.unionByName(whole.withColumn(entity, F.lit(None).cast(rows.schema[entity].dataType)))


def _shifted(rows: DataFrame, means: DataFrame, columns: Sequence[str], entity: str, sign: int) -> DataFrame:
    overall = means.where(F.col(entity).isNull()).select(*(F.col(c).alias(f"_all_{c}") for c in columns))
    own = means.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), *(F.col(c).alias(f"_own_{c}") for c in columns))
    joined = rows.join(own, F.col(entity) == F.col("_e"), "left").crossJoin(F.broadcast(overall))  # one row
    moved = {c: F.col(c) + sign * F.coalesce(f"_own_{c}", f"_all_{c}") for c in columns}
    return joined.withColumns(moved).select(*rows.columns)


def demean(rows: DataFrame, means: DataFrame, columns: Sequence[str], entity: str = "entity") -> DataFrame:
    """``columns`` less their entity's mean; less the overall mean for entities that ``means`` doesn't know."""
    return _shifted(rows, means, columns, entity, -1)


def reinflate(rows: DataFrame, means: DataFrame, columns: Sequence[str], entity: str = "entity") -> DataFrame:
    """The reverse of ``demean``."""
    return _shifted(rows, means, columns, entity, 1)


MODELS = ("ols", "ridge", "elastic_net", "pls", "constrained")


def fit_panel_model(name: str, train: DataFrame, features: Sequence[str], target: str, time: str = "time") -> LinearModel:
    """A linear model from sums over ``train``; ridge and PLS choose by expanding windows of time."""
    if name == "ols":
        return least_squares(gram(train, features, target))
    if name == "ridge":
        return ridge_by_folds(expanding_folds(train, features, target, time))
    if name == "elastic_net":
        return elastic_net(gram(train, features, target))
    if name == "pls":
        return partial_least_squares(expanding_folds(train, features, target, time))
    if name == "constrained":
        return constrained_least_squares(gram(train, features, target))
    raise ValueError(f"no model {name}")


def evaluate_panel(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, models: Sequence[str] = MODELS, entity: str | None = None, time: str = "time", group: str | None = None) -> DataFrame:
    """``model, n, rmse, mae, r2`` (and group figures) on ``test`` of models fitted on ``train``.

    With ``entity`` the models see values less their entity's mean, and predictions get it back.
    """
    columns = [*features, target]
    if entity:
        means = entity_means(train, columns, entity)
        fit_on, seen = demean(train, means, columns, entity), demean(test, means, list(features), entity)
    else:
        fit_on, seen = train, test
    out = None
    for name in models:
        model = fit_panel_model(name, fit_on, features, target, time)
        scored = predict(seen, model, features).withColumn("model", F.lit(name))
        if entity:
            scored = reinflate(scored.withColumn("_y", F.col(target)).withColumn(target, F.col("y_pred")), means.select(entity, target), [target], entity).withColumn("y_pred", F.col(target)).withColumn(target, F.col("_y")).drop("_y")
        scored = scored.withColumn("y_true", F.col(target).cast("double"))
        own = regression_metrics(scored, ["model"])
        if group:
            own = own.join(group_summary(scored, ["model"], group), "model")
        out = own if out is None else out.unionByName(own)
    return out


def evaluate_weights(test: DataFrame, weights: dict[str, float], target: str) -> DataFrame:
    """``n, rmse, mae, r2`` of a fixed weighted sum of columns."""
    fixed = LinearModel(np.array(list(weights.values())), 0.0)
    return regression_metrics(predict(test, fixed, list(weights)).withColumn("y_true", F.col(target).cast("double")))
