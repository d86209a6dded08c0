"""Group structure: sizes, shares and weights of the groups of a unit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite


def group_shares(units: DataFrame, group: str = "grp", weight: str | None = "weight") -> DataFrame:
    """``grp, n, pi, weight, pi_weight``: counts, count shares, weight sums and weight shares of each group.

    Missing, infinite and negative weights count as 0; weight shares are null
    where no group has weight. One aggregation of the units, and one of its
    result (a row for each group) for the totals.
    """
    own = F.greatest(F.coalesce(finite(F.col(weight)), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    sums = units.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("weight"))
    whole = sums.agg(F.sum("n").alias("_n"), F.sum("weight").alias("_w"))
    return sums.crossJoin(F.broadcast(whole)).select(
        "grp", "n", (F.col("n") / F.col("_n")).alias("pi"), "weight", F.when(F.col("_w") > 0, F.col("weight") / F.col("_w")).alias("pi_weight")
    )


def merge_small_groups(units: DataFrame, least: int, group: str = "grp", name: str = "OTHER") -> DataFrame:
    """``units`` with the groups of fewer than ``least`` rows under one name (group labels become text)."""
    sizes = units.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    joined = units.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(group, F.when(F.col("_n") < least, F.lit(name)).otherwise(F.col(group).cast("string"))).drop("_g", "_n")


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    """``label, n, fraction, percent, imbalance`` (size of the largest class over this one's)."""
    sums = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum("n").alias("_n"), F.max("n").alias("_most"))
    share = F.col("n") / F.col("_n")
    return sums.crossJoin(F.broadcast(whole)).select("label", "n", share.alias("fraction"), (share * 100).alias("percent"), (F.col("_most") / F.col("n")).alias("imbalance"))


def smallest_class_share(rows: DataFrame, label: str) -> DataFrame:
    """One row: the share of the smallest class."""
    return class_distribution(rows, label).agg(F.min("fraction").alias("smallest"))


def coalesced_left_join(left: DataFrame, right: DataFrame, key: str, prefer_left: bool = True) -> DataFrame:
    """``left`` with the columns of ``right`` by ``key``; columns of both are merged, the preferred side first where it isn't null.

    ``right`` may repeat a key: then rows fan out, as a left join has it.
    """
    both = [c for c in right.columns if c in left.columns and c != key]
    renamed = right.select(F.col(key), *(F.col(c).alias(f"_right_{c}" if c in both else c) for c in right.columns if c != key))
    joined = left.join(renamed, key, "left")
    merged: dict[str, Column] = {c: F.coalesce(*((F.col(c), F.col(f"_right_{c}")) if prefer_left else (F.col(f"_right_{c}"), F.col(c)))) for c in both}
    return joined.withColumns(merged).drop(*(f"_right_{c}" for c in both)) if both else joined


def first_row_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``; ``min_by`` combines ahead of the shuffle."""
    everything = F.struct(*rows.columns)
    least = F.min_by(everything, F.struct(*order)) if order else F.min(everything)
    return rows.groupBy(F.col(key).alias("_k")).agg(least.alias("_row")).select("_row.*")
