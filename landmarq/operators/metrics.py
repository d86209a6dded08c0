"""Regression and classification metrics, overall and by group, on long tables of predictions.

``rows`` has ``y_true, y_pred`` and any keys to report by (``target``, ``method``, ``grp``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TAILS = (0.90, 0.95, 0.99)


def _residual() -> Column:
    return F.col("y_true").cast("double") - F.col("y_pred").cast("double")


def _r2() -> Column:
    """1 - SSres / SStot; 0 where the truth doesn't vary."""
    y = F.col("y_true").cast("double")
    rest = F.sum(_residual() * _residual())
    spread = F.var_pop(y) * F.count(y)
    return F.when(spread < 1e-30, 0.0).otherwise(1 - rest / spread)


def regression_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n, rmse, mae, r2`` for each ``by``."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(_residual() * _residual())).alias("rmse"), F.avg(F.abs(_residual())).alias("mae"), _r2().alias("r2"))


def tail_errors(rows: DataFrame, by: Sequence[str] = (), points: Sequence[float] = TAILS) -> DataFrame:
    """Quantiles (``p90`` and so on) and ``max`` of absolute errors."""
    error = F.abs(_residual())
    return rows.groupBy(*by).agg(*(F.percentile(error, p).alias(f"p{round(100 * p)}") for p in points), F.max(error).alias("max"))


def group_metrics(rows: DataFrame, by: Sequence[str] = ("grp",)) -> DataFrame:
    """``regression_metrics`` of the groups with at least two rows."""
    return regression_metrics(rows, by).where("n >= 2")


def group_summary(rows: DataFrame, by: Sequence[str] = (), group: str = "grp") -> DataFrame:
    """Over groups: mean, worst, best, population deviation and interquartile range of their RMSE, and the means of MAE and R²."""
    each = group_metrics(rows, [*by, group])
    quartiles = F.percentile("rmse", [0.25, 0.75])
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.avg("rmse").alias("macro_rmse"), F.max("rmse").alias("worst_rmse"), F.min("rmse").alias("best_rmse"), F.stddev_pop("rmse").alias("dispersion"),
        (quartiles[1] - quartiles[0]).alias("iqr"), F.avg("mae").alias("macro_mae"), F.avg("r2").alias("macro_r2"),
    )


def downstream_report(rows: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Overall metrics, tails and group summary side by side, for each ``by``."""
    keys = list(by)
    join = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.crossJoin(b))
    return join(join(regression_metrics(rows, keys), tail_errors(rows, keys)), group_summary(rows, keys))


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``y_true, y_pred, n`` with a row for every pair of labels that occur, empty cells too."""
    keys = list(by)
    counts = rows.groupBy(*keys, F.col("y_true").alias("t"), F.col("y_pred").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(*keys, F.col("t").alias("l")).union(counts.select(*keys, F.col("p").alias("l"))).distinct()
    left, right = labels.withColumnRenamed("l", "y_true"), labels.withColumnRenamed("l", "y_pred")
    cells = left.join(right, keys) if keys else left.crossJoin(right)  # labels by labels
    named = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("t"), F.col("p"), "n")
    same = F.col("y_true").eqNullSafe(F.col("t")) & F.col("y_pred").eqNullSafe(F.col("p"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cells.join(named, same, "left").select(*keys, "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``label, support, predicted, hits, precision, recall, f1`` over the labels of truth and prediction; 0 for a zero denominator."""
    keys = list(by)
    counts = rows.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    long = counts.select(*keys, F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hits")).union(
        counts.select(*keys, F.col("y_pred"), F.lit(0).cast("long"), "n", F.lit(0).cast("long"))
    )
    sums = long.groupBy(*keys, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    sums = sums.withColumns({"precision": precision, "recall": recall})
    return sums.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def classification_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n, accuracy, kappa, macro_precision, macro_recall, macro_f1, weighted_f1, balanced_accuracy`` for each ``by``."""
    keys = list(by)
    each = class_metrics(rows, keys)
    n = F.sum("support")
    chance = F.sum(F.col("support") * F.col("predicted")) / (n * n)
    accuracy = F.sum("hits") / n
    return each.groupBy(*keys).agg(
        n.alias("n"), accuracy.alias("accuracy"), F.when(F.abs(1 - chance) < 1e-12, 0.0).otherwise((accuracy - chance) / (1 - chance)).alias("kappa"), F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


# -- ranks and correlations -----------------------------------------------


def average_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False, out: str = "rank") -> DataFrame:
    """Adds ranks from 1 in which ties share the mean of their places."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return rows.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / 2)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where either doesn't vary."""
    base = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(base > 0, F.covar_pop(x, y) / base)


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """``n, rho`` for each ``by``; null with fewer than ``least`` rows or without variation."""
    ranked = average_ranks(average_ranks(rows, x, by, out="_rx"), y, by, out="_ry")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, correlation("_rx", "_ry")).alias("rho"))


def kendall(rows: DataFrame, x: str, y: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``tau`` (tau-b) for each ``by``; 0 where either is constant.

    No pair of rows is made where values repeat: rows with the same ``x`` and ``y`` count together, so
    what is paired is one row for each distinct pair of values of a group. It is meant for group means and ranks, whose distinct
    pairs are few; rows with a null or NaN on either side are left out. ``key`` is of no account beyond its being there.
    """
    keys = list(by)
    given = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(key).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    held = given.where(~F.isnan("_x") & ~F.isnan("_y")).groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    other = held.select(*keys, F.col("_x").alias("_u"), F.col("_y").alias("_v"), F.col("_n").alias("_m"))
    pairs = (held.join(other, keys) if keys else held.crossJoin(other)).where((F.col("_x") < F.col("_u")) | ((F.col("_x") == F.col("_u")) & (F.col("_y") < F.col("_v"))))
    sx, sy, weight = F.signum(F.col("_u") - F.col("_x")), F.signum(F.col("_v") - F.col("_y")), F.col("_n") * F.col("_m")
    base = F.sqrt(F.sum(F.abs(sx) * weight)) * F.sqrt(F.sum(F.abs(sy) * weight))
    found = pairs.groupBy(*keys).agg(F.when(base > 0, F.sum(sx * sy * weight) / base).otherwise(0.0).alias("tau"))
    if not keys:
        return found
    several = held.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    return several.join(found, keys, "left").withColumn("tau", F.coalesce("tau", F.lit(0.0)))


# -- stability of group figures -------------------------------------------


def group_drift(units: DataFrame, selection: DataFrame, value: str, group: str = "grp") -> DataFrame:
    """``grp, full, subset, drift``: each group's mean over all units and over chosen ones; groups without chosen units are left out."""
    marked = units.join(selection.select("unit_id").distinct().withColumn("_in", F.lit(True)), "unit_id", "left")
    means = marked.groupBy(F.col(group).alias("grp")).agg(F.avg(value).alias("full"), F.avg(F.when(F.col("_in"), F.col(value))).alias("subset"))
    return means.where("subset is not null").withColumn("drift", F.abs(F.col("subset") - F.col("full")))


def drift_summary(units: DataFrame, selection: DataFrame, value: str, group: str = "grp") -> DataFrame:
    """One row: ``max_drift, mean_drift, tau`` (agreement of the groups' order)."""
    drift = group_drift(units, selection, value, group)
    return drift.agg(F.max("drift").alias("max_drift"), F.avg("drift").alias("mean_drift")).crossJoin(kendall(drift, "full", "subset", "grp"))


def drift_matrix(units: DataFrame, selection: DataFrame, values: Sequence[str], group: str = "grp") -> DataFrame:
    """``grp`` and a drift column for each of ``values``."""
    marked = units.join(selection.select("unit_id").distinct().withColumn("_in", F.lit(True)), "unit_id", "left")
    return marked.groupBy(F.col(group).alias("grp")).agg(*(F.abs(F.avg(F.when(F.col("_in"), F.col(v))) - F.avg(v)).alias(v) for v in values))


def group_error_stability(rows: DataFrame, by: Sequence[str] = (), group: str = "grp") -> DataFrame:
    """``worst, spread, mean`` of the groups' RMSE."""
    return group_metrics(rows, [*by, group]).groupBy(*by).agg(F.max("rmse").alias("worst"), F.stddev_pop("rmse").alias("spread"), F.avg("rmse").alias("mean"))
