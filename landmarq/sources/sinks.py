"""Sinks and stored artifacts: splits, selections, fronts, long results, prepared replicates, manifests, resumable runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, exists


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], required: Sequence[str] = (), rebuild: bool = False) -> DataFrame:
    """The table at ``path``, built and written if it isn't there whole or lacks a required column."""
    if not rebuild and is_complete(spark, path):
        stored = spark.read.parquet(path)
        if set(required) <= set(stored.columns):
            return stored
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


SPLIT_FLAGS = ("is_train", "is_validation", "is_eval", "is_eval_train", "is_eval_test")


def save_splits(units: DataFrame, path: str) -> None:
    units.select("unit_id", *(c for c in SPLIT_FLAGS if c in units.columns)).write.mode("overwrite").parquet(path)


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_selection(selection: DataFrame, path: str, **tags: object) -> None:
    """Appends chosen ids with columns for ``tags`` (method, run, replicate)."""
    selection.select("unit_id", *(F.lit(v).alias(k) for k, v in tags.items())).write.mode("append").parquet(path)


def load_selections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def save_front(front: DataFrame, path: str) -> None:
    front.write.mode("overwrite").parquet(path)


def save_metrics(metrics: DataFrame, path: str, keys: Sequence[str], **tags: object) -> None:
    """Appends a wide row of figures as long rows ``keys, tags, metric, value``."""
    values = [c for c, t in metrics.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    casted = metrics.select(*keys, *(F.col(c).cast("double").alias(c) for c in values))
    casted.unpivot(list(keys) or [], values, "metric", "value").select(*keys, *(F.lit(v).alias(k) for k, v in tags.items()), "metric", "value").write.mode("append").parquet(path)


def save_rows(frames: Sequence[DataFrame], path: str) -> None:
    """One CSV table of frames with different columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def save_quota_path(path_rows: DataFrame, path: str) -> None:
    """A quota path as JSON and as CSV."""
    path_rows.write.mode("overwrite").json(f"{path}/json")
    path_rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def save_manifest(spark: SparkSession, path: str, settings: Mapping[str, object]) -> None:
    known = {"spark": spark.version, "timezone": spark.conf.get("spark.sql.session.timeZone"), **settings}
    spark.createDataFrame([(json.dumps(known, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def next_replicate(spark: SparkSession, folder: str) -> int:
    """The least number from 0 whose replicate under ``folder`` isn't complete."""
    n = 0
    while is_complete(spark, f"{folder}/rep={n}"):
        n += 1
    return n


def unfinished(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The items of ``work`` that ``done`` doesn't have yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def run_resumable(spark: SparkSession, items: Sequence[object], step: Callable[[object], DataFrame], path: str) -> DataFrame:
    """Appends ``step(item)`` for each item whose rows under ``path`` aren't complete yet: a rerun goes on where the last one ended."""
    for item in items:
        target = f"{path}/item={item}"
        if not is_complete(spark, target):
            step(item).write.mode("overwrite").parquet(target)
    return spark.read.option("mergeSchema", True).parquet(path)


def publish(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """One row for each key, written over what is at ``path``; the checks that hold are returned as ``rows, keys, missing``."""
    unique = rows.dropDuplicates(list(keys))
    unique.write.mode("overwrite").parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    missing = F.count_if(F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0)
    return stored.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*keys)).alias("keys"), missing.alias("missing"))


def remove(spark: SparkSession, path: str) -> None:
    delete(spark, path)
