"""Group quotas: how many of k chosen units each group gets, and projecting selections onto them.

A selection is a table of ``unit_id`` (with ``candidate`` where there are
several). Random choices go by ``shuffle_key``, so they repeat exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite, gumbel, shuffle_key

_TINY = 1e-30


def kl_to_counts(shares: DataFrame, counts: str = "c", pi: str = "pi", alpha: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """``kl``: divergence of shares ``pi`` from the smoothed shares (c + alpha) / (k + alpha G), for each ``by``.

    Groups without share add nothing.
    """
    keys = list(by)
    sums = shares.groupBy(*keys).agg(F.sum(counts).alias("_k"), F.count(F.lit(1)).alias("_groups"))
    joined = shares.join(F.broadcast(sums), keys) if keys else shares.crossJoin(F.broadcast(sums))
    smoothed = (F.col(counts) + alpha) / (F.col("_k") + alpha * F.col("_groups"))
    term = F.when(F.col(pi) > 0, F.col(pi) * F.log(F.col(pi) / (smoothed + _TINY))).otherwise(0.0)
    return joined.groupBy(*keys).agg(F.sum(term).alias("kl"))


def _bounds(shares: DataFrame, k: int, least_one: bool) -> DataFrame:
    groups = shares.agg(F.count(F.lit(1)).alias("_groups"))
    low = F.when((F.lit(k) >= F.col("_groups")) & F.lit(least_one) & (F.col("n") > 0), 1).otherwise(0)
    return shares.crossJoin(F.broadcast(groups)).withColumns({"lb": low.cast("long"), "ub": F.least(F.col("n"), F.lit(k)).cast("long")}).drop("_groups")


def quota_counts(shares: DataFrame, k: int, alpha: float = 1.0, least_one: bool = True, pi: str = "pi") -> DataFrame:
    """``shares`` with ``c``: whole counts that sum to ``k`` and bring the divergence to its least within group sizes.

    Every further unit of a group gains less than the one before, so the best
    counts are the largest gains over all groups and units: a ranking instead of a
    greedy loop. With ``least_one`` every group gets a unit if ``k`` allows.
    A group offers at most ``k`` gains, so the ranking has at most k rows for each
    group, and the top is kept by each task ahead of the merge.
    """
    bounded = _bounds(shares, k, least_one)
    spare = bounded.agg(F.sum("lb").alias("_low"), F.sum("ub").alias("_high")).first()
    low, high = spare["_low"] or 0, spare["_high"] or 0
    if low > k or high < k:
        raise ValueError(f"{k} units do not fit between {low} and {high}")
    steps = bounded.where("ub > lb").withColumn("_t", F.explode(F.sequence(F.col("lb"), F.col("ub") - 1)))
    gain = F.when(F.col(pi) > 0, F.col(pi) * (F.log(F.col("_t") + alpha + 1) - F.log(F.col("_t") + alpha))).otherwise(F.lit(float("-inf")))
    taken = steps.withColumn("_gain", gain).orderBy(F.col("_gain").desc(), "grp", "_t").limit(k - low).groupBy(F.col("grp").alias("_g")).agg(F.count(F.lit(1)).alias("_more"))
    return bounded.join(taken, F.col("grp").eqNullSafe(F.col("_g")), "left").withColumn("c", F.col("lb") + F.coalesce("_more", F.lit(0))).drop("_g", "_more")


def quota_path(shares: DataFrame, grid: Sequence[int], alpha: float = 1.0, least_one: bool = True, pi: str = "pi") -> DataFrame:
    """``k, grp, pi, n, c`` for every k of ``grid`` from one ranking of gains.

    As along a path, lower bounds are those of the smallest k throughout.
    """
    ks = sorted(grid)
    top = ks[-1]
    bounded = _bounds(shares, ks[0], least_one).withColumn("ub", F.least(F.col("n"), F.lit(top)).cast("long"))
    low = bounded.agg(F.sum("lb").alias("low")).first()["low"] or 0
    steps = bounded.where("ub > lb").withColumn("_t", F.explode(F.sequence(F.col("lb"), F.col("ub") - 1)))
    gain = F.when(F.col(pi) > 0, F.col(pi) * (F.log(F.col("_t") + alpha + 1) - F.log(F.col("_t") + alpha))).otherwise(F.lit(float("-inf")))
    best = steps.select("grp", "_t", gain.alias("_gain")).orderBy(F.col("_gain").desc(), "grp", "_t").limit(max(0, top - low))
    # At most k rows are left to rank.
    ranked = best.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_gain").desc(), "grp", "_t")))
    steps_of = shares.sparkSession.createDataFrame([(int(k),) for k in ks], "k long")
    taken = steps_of.join(F.broadcast(ranked), F.col("_rank") <= F.col("k") - low).groupBy("k", F.col("grp").alias("_g")).agg(F.count(F.lit(1)).alias("_more")).withColumnRenamed("k", "_k")
    full = bounded.crossJoin(F.broadcast(steps_of))
    joined = full.join(taken, (F.col("k") == F.col("_k")) & F.col("grp").eqNullSafe(F.col("_g")), "left")
    return joined.select("k", "grp", F.col(pi).alias("pi"), "n", (F.col("lb") + F.coalesce("_more", F.lit(0))).alias("c"))


def path_report(path: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``k, kl_floor, l1, max_deviation, groups_hit`` of a quota path: how near each k can come to the shares."""
    kl = kl_to_counts(path, alpha=alpha, by=["k"])
    gap = F.abs(F.col("c") / F.col("k") - F.col("pi"))
    rest = path.groupBy("k").agg(F.sum(gap).alias("l1"), F.max(gap).alias("max_deviation"), F.count_if(F.col("c") > 0).alias("groups_hit"))
    return kl.join(rest, "k").select("k", F.col("kl").alias("kl_floor"), "l1", "max_deviation", "groups_hit")


def proportional_counts(shares: DataFrame, k: int, pi: str = "pi", reassign: bool = True) -> DataFrame:
    """``shares`` with ``c`` by largest remainders, no group above its size.

    Floors of k·pi come first; the rest goes to the largest remainders (ties by
    group). With ``reassign`` what a full group can't take goes to the groups with
    room left, by remainder, until ``k`` are placed; without, it is dropped.
    """
    exact = F.col(pi) * k
    base = shares.withColumn("_exact", exact).withColumn("c", F.least(F.floor("_exact"), F.col("n")).cast("long")).withColumn("_rest", F.col("_exact") - F.floor("_exact"))
    missing = k - (base.agg(F.sum("c").alias("s")).first()["s"] or 0)
    if missing <= 0:
        return base.drop("_exact", "_rest")
    order = Window.orderBy(F.col("_rest").desc(), "grp")  # one row for each group
    if not reassign:
        given = base.withColumn("_rank", F.row_number().over(order)).withColumn("c", F.col("c") + ((F.col("_rank") <= missing) & (F.col("c") < F.col("n"))).cast("long"))
        return given.drop("_exact", "_rest", "_rank")
    # Round r offers every group with room one unit more, in order of remainders.
    room = base.withColumn("_round", F.explode(F.when(F.col("n") > F.col("c"), F.sequence(F.lit(1), F.least(F.col("n") - F.col("c"), F.lit(missing)))).otherwise(F.array())))
    offers = room.orderBy("_round", F.col("_rest").desc(), "grp").limit(missing).groupBy(F.col("grp").alias("_g")).agg(F.count(F.lit(1)).alias("_more"))
    return base.join(offers, F.col("grp").eqNullSafe(F.col("_g")), "left").withColumn("c", F.col("c") + F.coalesce("_more", F.lit(0))).drop("_exact", "_rest", "_g", "_more")


def rounded_counts(shares: DataFrame, m: int, least_one: bool = True, pi: str = "pi") -> DataFrame:
    """``shares`` with ``c`` summing to ``m`` by largest remainders, each group at least one if ``m`` allows; sizes are no limit."""
    whole = shares.agg(F.count(F.lit(1)).alias("_groups"), F.sum(pi).alias("_total"))
    exact = F.col(pi) / F.col("_total") * m
    base = shares.crossJoin(F.broadcast(whole)).withColumn("_exact", exact).withColumn("_rest", F.col("_exact") - F.floor("_exact"))
    floor = F.floor("_exact").cast("long")
    base = base.withColumn("c", F.when(F.lit(least_one) & (F.lit(m) >= F.col("_groups")) & (floor == 0), 1).otherwise(floor))
    off = m - (base.agg(F.sum("c").alias("s")).first()["s"] or 0)
    if off > 0:
        ranked = base.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_rest").desc(), "grp")))
        base = ranked.withColumn("c", F.col("c") + (F.col("_rank") <= off).cast("long")).drop("_rank")
    elif off < 0:
        able = Window.partitionBy(F.col("c") > 0).orderBy("_rest", "grp")
        ranked = base.withColumn("_rank", F.row_number().over(able))
        base = ranked.withColumn("c", F.col("c") - ((F.col("c") > 0) & (F.col("_rank") <= -off)).cast("long")).drop("_rank")
    return base.drop("_groups", "_total", "_exact", "_rest")


def check_capacity(shares: DataFrame, k: int, least_one: bool = True) -> DataFrame:
    """One row: ``capacity, lower, feasible`` of choosing ``k`` units."""
    bounded = _bounds(shares, k, least_one)
    return bounded.agg(F.sum("n").alias("capacity"), F.sum("lb").alias("lower")).withColumn("feasible", (F.col("capacity") >= k) & (F.col("lower") <= k))


def most_constrained(quotas: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` groups whose quotas take the largest part of them."""
    return quotas.withColumn("tightness", F.col("c") / F.col("n")).orderBy(F.col("tightness").desc(), "grp").limit(top)


# -- samplers and projections ---------------------------------------------


def _log_weight(weight: str | None, seed: int | str, *keys: Column) -> Column:
    if weight is None:
        return shuffle_key(seed, *keys)
    w = F.coalesce(finite(F.col(weight)), F.lit(0.0))
    return -(F.when(w > 0, F.log(w)).otherwise(F.lit(-745.0)) + gumbel(seed, *keys))


def uniform_sample(units: DataFrame, k: int, seed: int | str = 0, weight: str | None = None) -> DataFrame:
    """``k`` units without replacement, by ``weight`` if one is named (units of no weight come last)."""
    return units.withColumn("_order", _log_weight(weight, seed, F.col("unit_id"))).orderBy("_order", "unit_id").limit(k).drop("_order")


def quota_sample(units: DataFrame, quotas: DataFrame, seed: int | str = 0, weight: str | None = None) -> DataFrame:
    """From each group its ``c`` units, at random or by ``weight``."""
    order = Window.partitionBy("grp").orderBy("_order", "unit_id")
    target = quotas.select(F.col("grp").alias("_g"), F.col("c").alias("_c"))
    ranked = units.withColumn("_order", _log_weight(weight, seed, F.col("unit_id"))).withColumn("_rank", F.row_number().over(order))
    return ranked.join(F.broadcast(target), F.col("grp").eqNullSafe(F.col("_g"))).where("_rank <= _c").drop("_order", "_rank", "_g", "_c")


def project_to_quotas(units: DataFrame, selection: DataFrame, quotas: DataFrame, seed: int | str = 0) -> DataFrame:
    """A selection that meets the quotas: chosen units stay as far as their group's quota goes, others fill up at random.

    With a ``candidate`` column in ``selection`` each candidate is projected by itself.
    """
    many = "candidate" in selection.columns
    chosen = selection.select(F.col("unit_id").alias("_u"), *([F.col("candidate").alias("_cand")] if many else [])).distinct()
    pool = units.select("unit_id", "grp")
    if many:
        pool = pool.crossJoin(F.broadcast(selection.select("candidate").distinct()))
    same = (F.col("unit_id") == F.col("_u")) & (F.col("candidate") == F.col("_cand")) if many else F.col("unit_id") == F.col("_u")
    marked = pool.join(chosen, same, "left").withColumn("_in", F.col("_u").isNotNull())
    keys = ["candidate"] if many else []
    order = Window.partitionBy(*keys, "grp").orderBy(F.col("_in").desc(), shuffle_key(seed, *(F.col(c) for c in [*keys, "unit_id"])), "unit_id")
    target = quotas.select(F.col("grp").alias("_g"), F.col("c").alias("_c"))
    ranked = marked.withColumn("_rank", F.row_number().over(order)).join(F.broadcast(target), F.col("grp").eqNullSafe(F.col("_g")))
    return ranked.where("_rank <= _c").select(*keys, "unit_id", "grp")


def project_to_size(units: DataFrame, selection: DataFrame, k: int, seed: int | str = 0) -> DataFrame:
    """A selection of exactly ``k`` units: chosen ones first, then others at random."""
    marked = units.select("unit_id").join(selection.select(F.col("unit_id").alias("_u")).distinct(), F.col("unit_id") == F.col("_u"), "left")
    return marked.orderBy(F.col("_u").isNull(), shuffle_key(seed, F.col("unit_id")), "unit_id").limit(k).select("unit_id")


def quota_gaps(units: DataFrame, selection: DataFrame, quotas: DataFrame) -> DataFrame:
    """``grp, c, chosen, gap`` for each group, groups without quota and without chosen units included."""
    chosen = units.join(selection.select("unit_id").distinct(), "unit_id", "left_semi").groupBy(F.col("grp").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    joined = quotas.select("grp", "c").join(chosen, F.col("grp").eqNullSafe(F.col("_g")), "full")
    return joined.select(F.coalesce("grp", "_g").alias("grp"), F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("_n", F.lit(0)).alias("chosen")).withColumn("gap", F.col("chosen") - F.col("c"))


def quota_satisfaction(units: DataFrame, selection: DataFrame, quotas: DataFrame) -> DataFrame:
    """One row: ``satisfied, deviation`` (sum of absolute gaps) and ``violations`` (groups with a gap)."""
    return quota_gaps(units, selection, quotas).agg(
        F.coalesce(F.bool_and(F.col("gap") == 0), F.lit(True)).alias("satisfied"), F.coalesce(F.sum(F.abs("gap")), F.lit(0)).cast("long").alias("deviation"), F.count_if(F.col("gap") != 0).alias("violations")
    )


# -- diagnostics and constraints ------------------------------------------


def selection_shares(units: DataFrame, selection: DataFrame, shares: DataFrame, weight: str | None = None) -> DataFrame:
    """``[candidate,] grp, pi, c, share`` of a selection, by count or by ``weight``; every group of ``shares`` is there."""
    keys = ["candidate"] if "candidate" in selection.columns else []
    own = F.greatest(F.coalesce(finite(F.col(weight)), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    rows = selection.select(*keys, "unit_id").distinct().join(units, "unit_id").groupBy(*keys, F.col("grp").alias("_g")).agg(F.sum(own).alias("_c"))
    frame = shares.select("grp", F.col("pi_weight" if weight else "pi").alias("pi"))
    if keys:
        frame = selection.select(*keys).distinct().crossJoin(F.broadcast(frame))
        rows = rows.withColumnRenamed("candidate", "_cand")
        joined = frame.join(rows, (F.col("candidate") == F.col("_cand")) & F.col("grp").eqNullSafe(F.col("_g")), "left").drop("_cand")
    else:
        joined = frame.join(rows, F.col("grp").eqNullSafe(F.col("_g")), "left")
    counted = joined.withColumn("c", F.coalesce("_c", F.lit(0.0))).drop("_g", "_c")
    whole = F.sum("c").over(Window.partitionBy(*keys))  # a row for each group
    return counted.withColumn("share", F.when(whole > 0, F.col("c") / whole))


def group_diagnostics(units: DataFrame, selection: DataFrame, shares: DataFrame, alpha: float = 1.0, weight: str | None = None) -> DataFrame:
    """``[candidate,] k, kl, l1, max_deviation, entropy, concentration, groups_hit`` of a selection.

    Counts are smoothed by ``alpha``, weights first brought to shares. An empty selection has infinite ``kl``,
    ``l1`` 2 and deviation 1.
    """
    rows = selection_shares(units, selection, shares, weight)
    keys = ["candidate"] if "candidate" in selection.columns else []
    k = F.sum("c").over(Window.partitionBy(*keys))
    groups = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_k", k).withColumn("_q", (F.col("c") + alpha) / (k + alpha * groups))
    term = F.when(F.col("pi") > 0, F.col("pi") * F.log(F.col("pi") / (F.col("_q") + _TINY))).otherwise(0.0)
    gap = F.abs(F.col("share") - F.col("pi"))
    empty = F.max("_k") <= 0
    return rows.groupBy(*keys).agg(
        F.max("_k").alias("k"), F.when(empty, F.lit(float("inf"))).otherwise(F.sum(term)).alias("kl"), F.when(empty, 2.0).otherwise(F.sum(gap)).alias("l1"), F.when(empty, 1.0).otherwise(F.max(gap)).alias("max_deviation"),
        F.when(empty, 0.0).otherwise(-F.sum(F.when(F.col("share") > 0, F.col("share") * F.log("share")).otherwise(0.0))).alias("entropy"), F.coalesce(F.sum(F.col("share") * F.col("share")), F.lit(0.0)).alias("concentration"),
        F.count_if(F.col("c") > 0).alias("groups_hit"),
    )


def coverage_report(units: DataFrame, selection: DataFrame, shares: DataFrame) -> DataFrame:
    """``grp, n, chosen, pi, share, ratio`` for each group."""
    rows = selection_shares(units, selection, shares)
    sizes = shares.select(F.col("grp").alias("_g"), "n")
    return rows.join(F.broadcast(sizes), F.col("grp").eqNullSafe(F.col("_g"))).select(
        "grp", "n", F.col("c").cast("long").alias("chosen"), "pi", F.coalesce("share", F.lit(0.0)).alias("share"), F.when(F.col("pi") > 0, F.coalesce("share", F.lit(0.0)) / F.col("pi")).alias("ratio")
    )


def total_violation(units: DataFrame, selection: DataFrame, shares: DataFrame, limits: dict[str, float], weight: str = "weight", alpha: float = 1.0) -> DataFrame:
    """``[candidate,] violation, feasible``: how far divergences exceed their limits, summed.

    ``limits`` has a limit for ``count`` shares, ``weight`` shares or both;
    both together ask for both at once.
    """
    keys = ["candidate"] if "candidate" in selection.columns else []
    out = None
    for kind, limit in sorted(limits.items()):
        one = group_diagnostics(units, selection, shares, alpha, weight if kind == "weight" else None).select(*keys, F.greatest(F.col("kl") - limit, F.lit(0.0)).alias(f"_{kind}"))
        out = one if out is None else (out.join(one, keys) if keys else out.crossJoin(one))
    violation = sum((F.col(f"_{kind}") for kind in sorted(limits)), F.lit(0.0))
    return out.select(*keys, violation.alias("violation"), (violation <= 0).alias("feasible"))


def random_candidates(units: DataFrame, count: int, k: int, seed: int | str = 0) -> DataFrame:
    """``candidate, unit_id``: ``count`` random selections of ``k`` units each.

    Every task keeps the first k of each candidate ahead of the shuffle, so ``count`` * k rows
    leave it at most.
    """
    draws = units.sparkSession.range(count).select(F.col("id").alias("candidate"))
    pool = units.select("unit_id").crossJoin(F.broadcast(draws)).withColumn("_order", shuffle_key(seed, F.col("candidate"), F.col("unit_id")))
    ranked = pool.withColumn("_rank", F.row_number().over(Window.partitionBy("candidate").orderBy("_order", "unit_id")))
    return ranked.where(F.col("_rank") <= k).select("candidate", "unit_id")


def limit_range(units: DataFrame, shares: DataFrame, k: int, draws: int = 200, seed: int | str = 0, alpha: float = 1.0, weight: str | None = None) -> DataFrame:
    """One row of quantiles of the divergence of random selections: what limits are within reach by chance."""
    kl = group_diagnostics(units, random_candidates(units, draws, k, seed), shares, alpha, weight)
    points = {"min": 0.0, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
    return kl.agg(*(F.percentile("kl", p).alias(name) for name, p in points.items()))


def limit_sweep(units: DataFrame, shares: DataFrame, k: int, limits: Sequence[float], draws: int = 200, seed: int | str = 0, alpha: float = 1.0) -> DataFrame:
    """``tau, feasible_share``: the part of random selections within each limit."""
    kl = group_diagnostics(units, random_candidates(units, draws, k, seed), shares, alpha).select("kl")
    grid = units.sparkSession.createDataFrame([(float(t),) for t in limits], "tau double")
    return kl.crossJoin(F.broadcast(grid)).groupBy("tau").agg(F.avg((F.col("kl") <= F.col("tau")).cast("double")).alias("feasible_share"))
