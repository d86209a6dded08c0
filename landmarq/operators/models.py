"""Further models on feature vectors, by the engine's machine-learning library and by nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import knn_predict, nearest_neighbours
from .metrics import classification_metrics, regression_metrics

REGRESSION, CLASSIFICATION = ("knn", "forest", "boosting", "ridge"), ("knn", "forest", "logistic", "boosting")


def _regressor(name: str, seed: int):
    common = {"featuresCol": "_f", "labelCol": "_y", "predictionCol": "_p"}
    return {
        "forest": lambda: RandomForestRegressor(numTrees=100, maxDepth=10, seed=seed, **common), "boosting": lambda: GBTRegressor(maxIter=50, maxDepth=5, seed=seed, **common),
        "ridge": lambda: LinearRegression(regParam=1e-3, elasticNetParam=0.0, **common),
    }[name]()


def _classifier(name: str, seed: int, classes: int):
    common = {"featuresCol": "_f", "labelCol": "_y", "predictionCol": "_p"}
    if name == "boosting":
        boosted = GBTClassifier(maxIter=50, maxDepth=5, seed=seed, **common)
        return boosted if classes <= 2 else OneVsRest(classifier=boosted, featuresCol="_f", labelCol="_y", predictionCol="_p")
    return {"forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **common), "logistic": lambda: LogisticRegression(maxIter=100, **common)}[name]()


def _vectors(rows: DataFrame, target: str) -> DataFrame:
    return rows.withColumns({"_f": array_to_vector(F.col("vec").cast("array<double>")), "_y": F.col(target).cast("double")})


def evaluate_regression(train: DataFrame, test: DataFrame, target: str, models: Sequence[str] = REGRESSION, seed: int = 0) -> DataFrame:
    """``target, model, n, rmse, mae, r2`` of models fitted on ``train`` (``unit_id, vec`` and the target)."""
    out = None
    for name in models:
        if name == "knn":
            scored = test.join(knn_predict(test, train, 5, target), "unit_id").withColumn("y_true", F.col(target).cast("double"))
        else:
            scored = _regressor(name, seed).fit(_vectors(train, target)).transform(_vectors(test, target)).select(F.col("_y").alias("y_true"), F.col("_p").alias("y_pred"))
        row = regression_metrics(scored).select(F.lit(target).alias("target"), F.lit(name).alias("model"), "n", "rmse", "mae", "r2")
        out = row if out is None else out.union(row)
    return out


def evaluate_classification(train: DataFrame, test: DataFrame, target: str, models: Sequence[str] = CLASSIFICATION, seed: int = 0) -> DataFrame | None:
    """``target, model, n, accuracy, balanced_accuracy, macro_f1``; None if training rows have a single class. Labels are whole numbers from 0."""
    classes = train.agg(F.count_distinct(target).alias("d"), F.max(target).alias("m")).first()
    if classes["d"] < 2:
        return None
    out = None
    for name in models:
        if name == "knn":
            near = nearest_neighbours(test, train, 5).join(train.select(F.col("unit_id").alias("neighbour"), F.col(target).alias("_y")), "neighbour")
            votes = near.groupBy("unit_id", "_y").agg(F.sum(1 / F.greatest(F.col("distance"), F.lit(1e-12))).alias("_w"))
            won = votes.groupBy("unit_id").agg(F.min_by("_y", F.struct(-F.col("_w"), "_y")).alias("y_pred"))
            scored = test.join(won, "unit_id").select(F.col(target).cast("double").alias("y_true"), F.col("y_pred").cast("double").alias("y_pred"))
        else:
            scored = _classifier(name, seed, int(classes["m"]) + 1).fit(_vectors(train, target)).transform(_vectors(test, target)).select(F.col("_y").alias("y_true"), F.col("_p").alias("y_pred"))
        row = classification_metrics(scored).select(F.lit(target).alias("target"), F.lit(name).alias("model"), "n", "accuracy", "balanced_accuracy", "macro_f1")
        out = row if out is None else out.union(row)
    return out


def evaluate_all(train: DataFrame, test: DataFrame, regression: Sequence[str] = (), classification: Sequence[str] = (), seed: int = 0) -> DataFrame | None:
    """``target, model, metric, value`` of every target and model."""
    out = None
    for kind, targets in (("r", regression), ("c", classification)):
        for target in targets:
            found = evaluate_regression(train, test, target, seed=seed) if kind == "r" else evaluate_classification(train, test, target, seed=seed)
            if found is not None:
                values = [c for c in found.columns if c not in ("target", "model", "n")]
                long = found.unpivot(["target", "model"], values, "metric", "value")
                out = long if out is None else out.union(long)
    return out
