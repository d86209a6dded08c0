"""Comparing methods: means, ranks, dominance, effects, championship statistics, fronts and power laws.

``results`` is long: ``method, metric, value`` with keys such as ``rep`` or ``run``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite
from .metrics import average_ranks, correlation

# Words in a metric's name that tell its family, and those that tell that more is better.
FAMILIES = (
    ("classification", ("accuracy", "_f1_", "macro_f1", "precision", "recall", "bal_accuracy", "auc")),
    ("fidelity", ("nystrom", "kpca")),
    ("regression", ("rmse", "mae", "_r2_", "_r2 ", "drift")),
)
HIGHER_IS_BETTER = ("accuracy", "_r2", "f1", "auc", "precision", "recall", "bal_accuracy")


def metric_family(name: Column) -> Column:
    text = F.lower(name)
    out = F.lit(None).cast("string")
    for family, words in reversed(FAMILIES):
        out = F.when(text.rlike("|".join(words)), family).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def higher_is_better(name: Column) -> Column:
    return F.lower(name).rlike("|".join(HIGHER_IS_BETTER))


def method_means(results: DataFrame, by: Sequence[str] = ("method", "metric")) -> DataFrame:
    """``n, mean, std, cv`` (population deviation) of finite values."""
    value = finite(F.col("value"))
    return results.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn("cv", F.when(F.abs("mean") > 1e-12, F.col("std") / F.abs("mean")))


def method_spread(results: DataFrame, by: Sequence[str] = ("method", "metric")) -> DataFrame:
    """``mean, std`` with the sample deviation."""
    value = finite(F.col("value"))
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def rank_table(means: DataFrame) -> DataFrame:
    """``method, metric, rank, average_rank``: places by ``mean`` (ties by name), better first, and their mean over metrics."""
    signed = F.when(higher_is_better(F.col("metric")), -F.col("mean")).otherwise(F.col("mean"))
    ranked = means.where("mean is not null").withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(signed, "method")))
    return ranked.select("method", "metric", "rank", F.avg("rank").over(Window.partitionBy("method")).alias("average_rank"))


def dominance(means: DataFrame) -> DataFrame:
    """``method, other, dominates``: no worse on every metric both have, better on one. Pairs of methods, not of rows."""
    signed = F.when(higher_is_better(F.col("metric")), -F.col("mean")).otherwise(F.col("mean"))
    a = means.select(F.col("method"), "metric", signed.alias("_a"))
    b = means.select(F.col("method").alias("other"), "metric", signed.alias("_b"))
    return a.join(b, "metric").where("method <> other").groupBy("method", "other").agg((F.bool_and(F.col("_a") <= F.col("_b")) & F.bool_or(F.col("_a") < F.col("_b"))).alias("dominates"))


def effect_isolation(means: DataFrame, searched: str, plain: str, constrained: str) -> DataFrame:
    """``metric, plain, constrained, searched, constraint_effect, objective_effect, total_effect`` and their relative forms."""
    wide = means.groupBy("metric").pivot("method", [plain, constrained, searched]).agg(F.first("mean"))
    p, c, s = (F.col(f"`{m}`") for m in (plain, constrained, searched))
    share = lambda x: F.when(F.abs(p) > 1e-12, 100 * x / F.abs(p))
    return wide.select(
        "metric", p.alias("plain"), c.alias("constrained"), s.alias("searched"), (c - p).alias("constraint_effect"), (s - c).alias("objective_effect"), (s - p).alias("total_effect"),
        share(c - p).alias("constraint_pct"), share(s - c).alias("objective_pct"), share(s - p).alias("total_pct"),
    )


def paired_comparison(means: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """``metric, method, other, value, other_value, delta`` for each named pair of methods."""
    frame = means.sparkSession.createDataFrame(list(pairs.items()), "method string, other string")
    left = means.select("metric", "method", F.col("mean").alias("value"))
    right = means.select("metric", F.col("method").alias("other"), F.col("mean").alias("other_value"))
    return left.join(F.broadcast(frame), "method").join(right, ["metric", "other"]).select("metric", "method", "other", "value", "other_value", (F.col("other_value") - F.col("value")).alias("delta"))


def best_per_metric(results: DataFrame, key: str = "method") -> DataFrame:
    """``metric, best, value``: the row with the best value, ties by key."""
    signed = F.when(higher_is_better(F.col("metric")), -F.col("value")).otherwise(F.col("value"))
    best = results.where(finite(F.col("value")).isNotNull()).groupBy("metric").agg(F.min(F.struct(signed.alias("s"), F.col(key).alias("k"), F.col("value").alias("v"))).alias("b"))
    return best.select("metric", F.col("b.k").alias("best"), F.col("b.v").alias("value"))


# -- championship ---------------------------------------------------------


def championship_ranks(results: DataFrame, block: Sequence[str] = ("metric", "rep")) -> DataFrame:
    """``rank, score, win, podium`` of each method within each block: ties share ranks, scores run from 0 (worst) to 1 (best)."""
    signed = F.when(higher_is_better(F.col("metric")), -finite(F.col("value"))).otherwise(finite(F.col("value")))
    ranked = average_ranks(results.withColumn("_s", signed).where("_s is not null"), "_s", block)
    low, high = F.min("_s").over(Window.partitionBy(*block)), F.max("_s").over(Window.partitionBy(*block))
    score = F.when(high - low < 1e-15, 1.0).otherwise((high - F.col("_s")) / (high - low))
    return ranked.withColumns({"score": score, "win": (F.col("rank") <= 1).cast("int"), "podium": (F.col("rank") <= 3).cast("int")}).drop("_s")


def championship(results: DataFrame, block: Sequence[str] = ("metric", "rep")) -> DataFrame:
    """``method, blocks, mean_rank, mean_score, wins, podiums``."""
    return championship_ranks(results, block).groupBy("method").agg(F.count(F.lit(1)).alias("blocks"), F.avg("rank").alias("mean_rank"), F.avg("score").alias("mean_score"), F.sum("win").alias("wins"), F.sum("podium").alias("podiums"))


def friedman(results: DataFrame, block: Sequence[str] = ("metric", "rep"), q: float = 3.102) -> DataFrame:
    """One row: ``methods, blocks, chi_square`` (corrected for ties) and ``critical_difference`` for the studentised range ``q``."""
    ranked = championship_ranks(results, block)
    sums = ranked.groupBy("method").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("methods"), F.max("n").alias("blocks"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    ties = ranked.groupBy(*block, "rank").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    m, n = F.col("methods"), F.col("blocks")
    plain = 12.0 / (n * m * (m + 1)) * F.col("rr") - 3 * n * (m + 1)
    correction = 1 - F.col("ties") / (n * (m * m * m - m))
    return sums.crossJoin(ties).select("methods", "blocks", F.when(correction > 0, plain / correction).alias("chi_square"), (F.lit(q) * F.sqrt(m * (m + 1) / (6.0 * n))).alias("critical_difference"))


def head_to_head(results: DataFrame, block: Sequence[str] = ("metric", "rep")) -> DataFrame:
    """``method, other, wins, losses, ties, cliffs_delta`` over shared blocks."""
    ranked = championship_ranks(results, block)
    a = ranked.select(*block, "method", F.col("rank").alias("_a"))
    b = ranked.select(*block, F.col("method").alias("other"), F.col("rank").alias("_b"))
    both = a.join(b, list(block)).where("method <> other").groupBy("method", "other")
    sums = both.agg(F.count_if(F.col("_a") < F.col("_b")).alias("wins"), F.count_if(F.col("_a") > F.col("_b")).alias("losses"), F.count_if(F.col("_a") == F.col("_b")).alias("ties"))
    return sums.withColumn("cliffs_delta", (F.col("wins") - F.col("losses")) / (F.col("wins") + F.col("losses") + F.col("ties")))


def best_of_front_mean(results: DataFrame, by: Sequence[str] = ("method", "metric"), rep: str = "rep") -> DataFrame:
    """The best value of each replicate, averaged over replicates: an upper bound, not a choice that could be made."""
    better = higher_is_better(F.col("metric"))
    value = finite(F.col("value"))
    each = results.groupBy(*by, rep).agg(F.max(F.when(better, value)).alias("h"), F.min(F.when(~better, value)).alias("l")).withColumn("best", F.coalesce("h", "l"))
    return each.groupBy(*by).agg(F.avg("best").alias("mean_best"))


# -- fronts ---------------------------------------------------------------


def non_dominated(front: DataFrame, objectives: Sequence[str], key: str = "candidate", by: Sequence[str] = ()) -> DataFrame:
    """The rows that no other row of the same ``by`` dominates (all objectives at most as large, one smaller).

    Populations are small; the join is over candidates, not over units.
    """
    rows = front.alias("p")
    others = front.select(F.col(key).alias("_k"), *(F.col(o).alias(f"_{o}") for o in objectives), *(F.col(b).alias(f"_by_{b}") for b in by))
    worse = F.col("_k") != F.col(key)
    for b in by:
        worse = worse & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    for o in objectives:
        worse = worse & (F.col(f"_{o}") <= F.col(o))
    worse = worse & F.greatest(*((F.col(f"_{o}") < F.col(o)).cast("int") for o in objectives), F.lit(0)).cast("boolean")
    return rows.join(F.broadcast(others), worse, "left_anti")


def _scaled(front: DataFrame, objectives: Sequence[str], by: Sequence[str]) -> DataFrame:
    over = Window.partitionBy(*by)
    out = front
    for o in objectives:
        low, high = F.min(o).over(over), F.max(o).over(over)
        out = out.withColumn(f"_z_{o}", F.when(high - low < 1e-12, 0.0).otherwise((F.col(o) - low) / (high - low)))
    return out


def knee(front: DataFrame, objectives: Sequence[str], key: str = "candidate", by: Sequence[str] = ()) -> DataFrame:
    """The row nearest to the best corner after bringing each objective to [0, 1]; ties by key."""
    scaled = _scaled(front, objectives, by).withColumn("_d", F.sqrt(sum((F.col(f"_z_{o}") * F.col(f"_z_{o}") for o in objectives), F.lit(0.0))))
    return scaled.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_d", key))).where("_rank = 1").drop("_rank", "_d", *(f"_z_{o}" for o in objectives))


def representatives(front: DataFrame, objectives: Sequence[str], key: str = "candidate") -> DataFrame:
    """``role, candidate``: the best by each objective, the knee, the Chebyshev point and the knee of each pair of objectives."""
    named = [front.select(F.lit(f"best_{o}").alias("role"), F.col(key), F.struct(F.col(o), F.col(key)).alias("_o")).groupBy("role").agg(F.min_by(key, "_o").alias(key)) for o in objectives]
    named.append(knee(front, objectives, key).select(F.lit("knee").alias("role"), key))
    scaled = _scaled(front, objectives, ()).withColumn("_d", F.greatest(*(F.col(f"_z_{o}") for o in objectives)) if len(objectives) > 1 else F.col(f"_z_{objectives[0]}"))
    named.append(scaled.select(F.lit("chebyshev").alias("role"), key, F.struct("_d", key).alias("_o")).groupBy("role").agg(F.min_by(key, "_o").alias(key)))
    if len(objectives) > 2:
        named += [knee(front, [a, b], key).select(F.lit(f"knee_{a}_{b}").alias("role"), key) for i, a in enumerate(objectives) for b in objectives[i + 1 :]]
    out = named[0]
    for frame in named[1:]:
        out = out.unionByName(frame)
    return out


def crowding(front: DataFrame, objectives: Sequence[str], key: str = "candidate", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``crowding``: summed gaps between a row's neighbours in each objective; ends are infinite."""
    out = front.withColumn("crowding", F.lit(0.0))
    over = Window.partitionBy(*by)
    for o in objectives:
        order = over.orderBy(o, key)
        span = F.max(o).over(over) - F.min(o).over(over)
        gap = (F.lead(o).over(order) - F.lag(o).over(order)) / F.when(span > 1e-12, span).otherwise(1.0)
        out = out.withColumn("crowding", F.col("crowding") + F.coalesce(gap, F.lit(float("inf"))))
    return out


def hypervolume(front: DataFrame, x: str, y: str, reference: tuple[float, float]) -> DataFrame:
    """One row: the area that a two-objective front dominates, up to ``reference``."""
    rx, ry = reference
    inside = front.where((F.col(x) <= rx) & (F.col(y) <= ry)).select(x, y)
    order = Window.orderBy(x, y)
    lowest = F.min(y).over(order.rowsBetween(Window.unboundedPreceding, -1))
    height = F.greatest(F.coalesce(lowest, F.lit(ry)) - F.col(y), F.lit(0.0))
    return inside.withColumn("_a", (F.lit(rx) - F.col(x)) * height).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("hypervolume"))


def hypervolume_contribution(front: DataFrame, x: str, y: str, reference: tuple[float, float], key: str = "candidate") -> DataFrame:
    """Adds ``contribution``: the area that a row of a two-objective front alone dominates."""
    order = Window.orderBy(x, key)
    right = F.coalesce(F.lead(x).over(order), F.lit(reference[0]))
    above = F.coalesce(F.lag(y).over(order), F.lit(reference[1]))
    return front.withColumn("contribution", F.greatest(right - F.col(x), F.lit(0.0)) * F.greatest(above - F.col(y), F.lit(0.0)))


def front_report(front: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """One row: ``size``, ranges and pairwise correlations of a front's objectives."""
    ranges = [(F.max(o) - F.min(o)).alias(f"range_{o}") for o in objectives]
    pairs = [correlation(a, b).alias(f"corr_{a}_{b}") for i, a in enumerate(objectives) for b in objectives[i + 1 :]]
    return front.agg(F.count(F.lit(1)).alias("size"), *ranges, *pairs)


# -- scaling --------------------------------------------------------------


def power_law(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, coefficient, exponent, r2`` of y = coefficient * x ^ exponent, by least squares of logarithms of positive values."""
    good = rows.where((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.log(x).alias("_x"), F.log(y).alias("_y"))
    return good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.exp(F.regr_intercept("_y", "_x")).alias("coefficient"), F.regr_slope("_y", "_x").alias("exponent"), F.regr_r2("_y", "_x").alias("r2"))
