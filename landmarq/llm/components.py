"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Gives ``node, component`` for every node of ``edges`` (``u, v``), the component named by its smallest node.

    Each round takes the least neighbour by a grouped minimum (which combines
    ahead of the shuffle, so a node with very many links costs no single task)
    and a join back; the number of rounds grows with the logarithm of the
    longest path. Each round is written to the shared folder, so a lost
    executor costs at most one round. Loops and null ends are ignored; an empty
    table gives an empty table.
    """
    start = edges.where("u is not null and v is not null and u <> v")
    current = materialise(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(current)
    while before[0]:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        following = materialise(small.where("u <> v").distinct(), "edges")
        after = _signature(following)
        discard(current)
        current = following
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
