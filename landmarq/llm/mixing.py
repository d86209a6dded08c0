"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, how many copies of it the mix takes on average. Of
all rates in [0, ``most``] that meet every source's token target the operator
takes those nearest to 1 in relative entropy: rate = min(most, exp(l * size /
scale)), where l is the source's multiplier in the convex dual. Newton steps,
kept inside a bracket, find the multipliers of all sources at once; each step is one
grouped aggregation of a table with a row for each source and size. Copies are
rounded from rates so that every source's words follow its target closely.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ._common import discard, has_unique_ids, materialise, n_words, numbered, shielded, unshielded, with_prefix

#: Parts into which ranks inside a class of equal documents are counted: the first two digits of a hash.
PARTS = 16**2


def source_targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` for each source of rows ``source, size``.

    Sources stand in order of code points, null last, and weigh ``weights`` in
    turn. They share ``share`` times all words by weight; a target stops at
    ``most`` times its source's size, and the excess is shared again by weight
    until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_prefix(sums, [F.col("source").asc_nulls_last()], name="sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_index") % len(weights) + 1).cast("int"))
    table = materialise(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "weights")
    total = float(share) * (table.agg(F.sum("source_size").alias("s")).first()["s"] or 0)
    level, held = 0.0, -1
    while True:  # each round holds at least one more source at its cap
        full = F.col("weight") * level > F.col("cap")
        row = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("cap"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count_if(full).alias("held"),
        ).first()
        if row["held"] == held or not row["weight"]:
            break
        held, level = row["held"], max(0.0, total - row["cap"]) / row["weight"]
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def solve_rates(classes: DataFrame, targets: DataFrame, most: float = 2.0, tolerance: float = 1e-12, steps: int = 200) -> DataFrame:
    """Adds ``rate`` to ``classes`` (``source, size, n``), given ``targets`` (``source, source_size, target``).

    One dual variable for each source; every Newton step of all sources is one
    grouped sum of the gap and its slope. The bracket starts where the source's
    shortest text alone bounds all rates, so it holds the solution whatever the
    sizes. A step that leaves it, and every other step when many were taken, is
    replaced by its middle. Sources with a target at ``most`` times their size
    take every document ``most`` times. A source that misses its target raises.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    scales = classes.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest"))
    # At ``low`` every rate is target / source_size at most, at ``high`` every rate is ``most``.
    reach = F.greatest("scale", F.lit(1.0)) / F.coalesce("shortest", F.lit(1))
    low = F.least(F.lit(0.0), F.log(F.greatest("target", F.lit(1e-7)) / F.greatest("source_size", F.lit(1)))) * reach - 1
    high = F.lit(max(0.0, math.log(most)) if most > 0 else 0.0) * reach + 1
    state = materialise(
        targets.join(scales.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("tilt"), low.alias("low"), high.alias("high"),
            (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"), F.lit(False).alias("done"),
        ),
        "dual",
    )
    rows = classes.withColumnRenamed("source", "_s")

    def rated(state: DataFrame) -> DataFrame:
        pull = F.col("tilt") * F.col("size") / F.col("scale")
        raw = F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(pull, F.lit(max(8.0, most))))))
        return rows.join(state, F.col("_s").eqNullSafe(F.col("source"))).withColumn("rate", raw)

    for step in range(steps):
        open_rows = rated(state.where(~F.col("full") & ~F.col("done")))
        slope = F.when(F.col("rate") < most, F.col("n") * F.col("rate") * F.col("size") * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = open_rows.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n") * F.col("rate") * F.col("size")).alias("taken"), F.sum(slope).alias("slope"))
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (low + high) / 2
        following = F.when((newton > low) & (newton < high) & F.lit(step < 20 or step % 2 == 0), newton).otherwise(middle)
        settled = F.col("done") | F.col("full") | F.coalesce(F.abs(gap) <= F.greatest(F.col("target") * tolerance, F.lit(1e-6)), F.lit(True))
        before, state = state, materialise(
            state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "scale", F.when(settled, F.col("tilt")).otherwise(following).alias("tilt"), F.when(settled, F.col("low")).otherwise(low).alias("low"),
                F.when(settled, F.col("high")).otherwise(high).alias("high"), "full", settled.alias("done"),
            ),
            "dual",
        )
        discard(before)  # the steps leave one table behind, not one each
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        missed = state.where(~F.col("done")).select("source", "target").limit(5).collect()
        raise ValueError(f"after {steps} steps these sources miss their targets: {[(r['source'], r['target']) for r in missed]}")
    return rated(state).select("source", "size", "n", "rate", "source_size", "target")


def _round_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies for each size of one source: largest sizes first, what one size leaves over goes to the next."""
    rows = rows.sort_values("size", ascending=False, ignore_index=True)
    owed, copies = 0.0, np.zeros(len(rows), np.int64)
    most = float(rows["most"].iloc[0])
    for i, (size, n, rate) in enumerate(zip(rows["size"], rows["n"], rows["rate"])):
        if size:
            owed += n * rate * size
            copies[i] = min(int(most * n), max(0, int(np.floor(owed / size + 0.5))))
            owed -= copies[i] * size
        else:
            copies[i] = n
    return rows[["source", "size"]].assign(copies=copies)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, size, source, source_size, target, rate, copies`` for every row of ``docs``.

    ``size`` is the number of words (0 for null), ``copies`` how often the mix
    takes the document: 0 to ``most`` whole times. A source's total comes to
    within half of its smallest document that rounding can still move of its target.
    Documents of one source and size share their copies; which of them take
    one more goes by the MD5 of the id, so reruns agree, on any engine. A source of a hundred
    million documents is one row for each distinct size by then, and ranks
    inside a class of equal size are counted in ``PARTS`` parts, so no class
    meets in one task. Null sources are a source of their own. Rows that tie on
    the id and repeat share a rank order but not a rank. Documents without
    words are taken once. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")), "sized")
    targets = source_targets(sized, weights, share, most)
    classes = materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    rates = materialise(solve_rates(classes, materialise(targets, "targets"), most), "rates")
    # A group is one source's distinct sizes: bounded by the longest text, not by the rows.
    rounded = rates.withColumn("most", F.lit(float(most))).groupBy("source").applyInPandas(_round_source, "source string, size long, copies long")
    plan = rates.join(rounded.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "copies"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", F.floor(F.col("copies") / F.col("n")).alias("base"), (F.col("copies") % F.col("n")).alias("extra")
    )
    plan = materialise(plan, "plan")
    keyed = sized.withColumn("_hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("_part", F.substring("_hash", 1, 2))  # PARTS of them, in the order of the hash
    parts = keyed.groupBy("source", "size", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("_s2"), F.col("size").alias("_z2"), F.col("_part").alias("_p2"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "size", "_part").orderBy("_hash", "id")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("size") == F.col("_z2")) & (F.col("_part") == F.col("_p2")))
    out = ranked.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    more = (F.col("_rank") + F.col("_ahead") < F.col("extra")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "rate", (F.col("base") + more).cast("long").alias("copies"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, under the columns that it had.

    Each row has copies of its own: rows that repeat an id, and rows with a null id, count
    like any others (they are numbered first). An empty table gives an empty one.
    """
    rows, names = shielded(docs)
    key = names[id_col]
    if not has_unique_ids(rows, key):
        rows, key = numbered(rows, key, "_row"), "_row"
    mixed = mix(rows, id_col=key, text_col=names[text_col], source_col=names[source_col], **options)
    counts = materialise(mixed.where("copies > 0").select(F.col(key).alias("_id"), "copies"), "copies")
    # A row for each document: it grows with the table, so it is never broadcast.
    joined = rows.join(counts.withColumnRenamed("copies", "_copies").hint("merge"), F.col(key) == F.col("_id"))
    copied = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return unshielded(copied, names)
