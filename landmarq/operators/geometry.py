"""Distances between units and chosen units, and how well a selection covers and represents the whole.

``units`` has ``unit_id`` and ``vec`` (an array of numbers). A selection is small
beside the units (its size is asked for), so its vectors go to every task, as one
matrix: after a check of their count. Larger sides are dealt into blocks of
vectors, and every batch of units meets one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import shuffle_key
from ..functions.vectors import squared_distance
from ..shipping import ship
from .kernels import against, chunks, column_sums, complete, gaussian, spread, squared_distances, sum_matrix, vectors_of

#: Chosen vectors up to this many are broadcast.
BROADCAST_ROWS = 20_000
#: Distances that are held at a time.
_AT_ONCE = 1 << 21


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def chosen_vectors(units: DataFrame, selection: DataFrame) -> DataFrame:
    return units.join(F.broadcast(selection.select("unit_id").distinct()) if selection.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else selection.select("unit_id").distinct(), "unit_id", "left_semi")


def _nearest(block: list, points: np.ndarray, vectors: np.ndarray, ids: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For rows of ``vectors`` their places, and the places and exact distances of the ``k`` nearest ``points``, nearest first, the smaller id of several.

    ``block`` holds the points' ids, ascending; a point with the row's own id (``ids``) is left out. A product of matrices finds candidates, whose
    distances are then worked out by differences, since the product loses digits.
    """
    place = {b: i for i, b in enumerate(block)}
    scale = float((points**2).sum(axis=1).max(initial=0.0))
    for start in range(0, len(vectors), max(1, _AT_ONCE // max(len(points), 1))):
        part = vectors[start : start + max(1, _AT_ONCE // max(len(points), 1))]
        near = squared_distances(part, points)
        if ids is not None:
            for i, own in enumerate(ids[start : start + len(part)]):
                if own in place:
                    near[i, place[own]] = np.inf
        want = min(k, len(points))
        limit = np.partition(near, want - 1, axis=1)[:, want - 1]
        slack = 1e-9 * (scale + (part**2).sum(axis=1))
        for i in range(len(part)):
            some = np.flatnonzero((near[i] <= limit[i] + slack[i]) & np.isfinite(near[i]))
            exact = np.sqrt(((points[some] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((some, np.round(exact, 12)))[:k]
            yield start + i, some[best], exact[best]


def _neighbours(queries: DataFrame, points: DataFrame, k: int, others: bool) -> DataFrame:
    """``unit_id, neighbour, distance``: the ``k`` nearest points of each query, itself left out with ``others``.

    A batch of queries meets the points as one matrix where they are few. More points are dealt into blocks of ``BROADCAST_ROWS``, each a
    task of its own for every batch that it meets; each pair of batch and block leaves k rows for each query, of which the k nearest stay.
    """
    ship(queries.sparkSession)
    kind, other = dict(queries.dtypes)["unit_id"], dict(points.dtypes)["unit_id"]
    fields = f"unit_id {kind}, neighbour {other}, distance double"

    def found(ids: list, vectors: np.ndarray, block: list, matrix: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        rows, at, far = [], [], []
        for i, places, distances in _nearest(block, matrix, vectors, ids if others else None, k) if block else ():
            rows += [ids[i]] * len(places)
            at += [block[p] for p in places]
            far.append(distances)
        return pa.RecordBatch.from_arrays([pa.array(rows, schema.field(0).type), pa.array(at, schema.field(1).type), pa.array(np.concatenate(far) if far else [], pa.float64())], schema=schema)

    few = points.select("unit_id", F.col("vec").cast("array<double>").alias("vec")).limit(BROADCAST_ROWS + 1).toArrow()
    given = queries.select("unit_id", F.col("vec").cast("array<double>").alias("vec"))
    schema = pa.schema([("unit_id", given.limit(0).toArrow().schema.field(0).type), ("neighbour", few.schema.field(0).type), ("distance", pa.float64())])
    if few.num_rows <= BROADCAST_ROWS:
        few = few.sort_by("unit_id").combine_chunks()
        held = queries.sparkSession.sparkContext.broadcast((few.column(0).to_pylist(), vectors_of(few.column(1).combine_chunks()) if few.num_rows else np.empty((0, 0))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield found(batch.column(0).to_pylist(), vectors_of(batch.column(1)), *held.value, schema)

        return given.mapInArrow(scan, fields)
    return _blockwise(given, points, k, fields, found, schema)


def _blockwise(queries: DataFrame, points: DataFrame, k: int, fields: str, found, schema: pa.Schema) -> DataFrame:
    """Every batch of queries against every block of points, as rows of a table of pairs of block numbers."""
    counts = [max(1, -(-x.count() // BROADCAST_ROWS)) for x in (queries, points)]
    dealt = [x.select("unit_id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("unit_id"), F.lit(n)).alias("block")) for x, n in zip((queries, points), counts)]
    # Each block goes once to each block of the other side: the pairs that an exact answer needs, a task for each.
    left = dealt[0].withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))))
    right = dealt[1].withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.sort_by("point").combine_chunks()
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        batch = found(one.column("query").to_pylist(), vectors_of(one.column("query_vec").combine_chunks()), two.column("point").to_pylist(), vectors_of(two.column("point_vec").combine_chunks()), schema)
        return pa.Table.from_batches([batch])

    # Names of their own, since both sides may come from one table.
    named = [x.select(F.col("unit_id").alias(i), F.col("vec").alias(v), F.col("block").alias("of"), F.col("other").alias("by")) for x, i, v in ((left, "query", "query_vec"), (right, "point", "point_vec"))]
    pairs = named[0].groupBy("of", "by").cogroup(named[1].groupBy("of", "by")).applyInArrow(meet, fields)
    best = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.round("distance", 12), "neighbour"))
    return pairs.withColumn("_place", best).where(F.col("_place") <= k).drop("_place")


def nearest_chosen(units: DataFrame, selection: DataFrame) -> DataFrame:
    """``unit_id, nearest, distance``: each unit's nearest chosen unit (the smaller id of several). Chosen units are their own."""
    return _neighbours(units, chosen_vectors(units, selection), 1, False).withColumnRenamed("neighbour", "nearest")


def coverage(units: DataFrame, selection: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: ``mean_distance, k_center`` (largest) and ``k_median`` (weighted sum; by 1/N without a weight)."""
    near = nearest_chosen(units, selection)
    if weight is None:
        return near.agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("k_center"), F.avg("distance").alias("k_median"))
    joined = near.join(units.select("unit_id", F.col(weight).alias("_w")), "unit_id")
    return joined.agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("k_center"), F.sum(F.col("_w") * F.col("distance")).alias("k_median"))


def pairwise_distances(units: DataFrame, selection: DataFrame) -> DataFrame:
    """``i, j, distance`` for the pairs i < j of chosen units: k(k-1)/2 rows by design, so for small selections."""
    chosen = chosen_vectors(units, selection)
    a = chosen.select(F.col("unit_id").alias("i"), F.col("vec").alias("_a"))
    b = chosen.select(F.col("unit_id").alias("j"), F.col("vec").alias("_b"))
    return a.join(_small(b), F.col("i") < F.col("j")).select("i", "j", F.sqrt(squared_distance(F.col("_a"), F.col("_b"))).alias("distance"))


def diversity(units: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: ``total`` and ``least`` distance of chosen pairs; infinite ``least`` for fewer than two."""
    return pairwise_distances(units, selection).agg(F.coalesce(F.sum("distance"), F.lit(0.0)).alias("total"), F.coalesce(F.min("distance"), F.lit(float("inf"))).alias("least"))


def representation_error(units: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: ``mean_error, covariance_error``: norms of the differences of mean vectors and of covariances.

    Two passes: means of all and of the chosen units, then one matrix of centred cross products from each task for either.
    Without a unit on either side, and for covariances with fewer than two, the value is null.
    """
    marked = units.join(selection.select("unit_id").distinct().withColumn("_in", F.lit(True)), "unit_id", "left").select("vec", F.coalesce("_in", F.lit(False)).alias("_in"))

    def both(batch: pa.RecordBatch) -> np.ndarray:
        v, chosen = vectors_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        return np.array([np.r_[float(len(v)), v.sum(axis=0)], np.r_[float(chosen.sum()), v[chosen].sum(axis=0)]])

    sums = sum_matrix(marked, both)
    out = "mean_error double, covariance_error double"
    if sums is None or not sums[1, 0]:
        return units.sparkSession.createDataFrame([(None, None)], out)
    counts, means = sums[:, 0], sums[:, 1:] / sums[:, :1]

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        v, chosen = vectors_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        every, some = v - means[0], v[chosen] - means[1]
        return np.vstack([every.T @ every, some.T @ some])

    crossed = sum_matrix(marked, spread)
    d = means.shape[1]
    gap = crossed[:d] / (counts[0] - 1) - crossed[d:] / (counts[1] - 1) if counts.min() > 1 else None
    return units.sparkSession.createDataFrame([(float(np.linalg.norm(means[0] - means[1])), None if gap is None else float(np.linalg.norm(gap)))], out)


def mmd_exact(x: DataFrame, y: DataFrame, sigma_sq: float) -> DataFrame:
    """One row: ``mmd2``, the squared mean discrepancy of two sets of vectors under a Gaussian kernel, all pairs included.

    Every pair is looked at, as matrix products of batches and chunks (see ``kernels.against``), so the work grows with the square of the rows;
    ``kernels.RandomFeatures`` serves large tables. Null without a vector on either side.
    """
    x, y = (complete(r).select("unit_id", F.col("vec").cast("array<double>").alias("vec")) for r in (x, y))
    n, m = x.count(), y.count()
    out = "mmd2 double"
    if not n or not m:
        return x.sparkSession.createDataFrame([(None,)], out)
    # Distances don't hang on the origin, but products keep more digits near it.
    total, _ = column_sums(x, "vec")
    centre = total / n
    all_x, all_y = (chunks(r, function=lambda v: v - centre) for r in (x, y))

    def kernel(v: np.ndarray, points: np.ndarray) -> np.ndarray:
        return gaussian(v, points, sigma_sq).sum(axis=1, keepdims=True)

    across, _ = column_sums(spread(x, n * (n + m)), "vec", lambda v: np.hstack([against(v - centre, all_x, kernel), against(v - centre, all_y, kernel)]))
    inside, _ = column_sums(spread(y, m * m), "vec", lambda v: against(v - centre, all_y, kernel))
    return x.sparkSession.createDataFrame([(float(across[0] / n / n + inside[0] / m / m - 2 * across[1] / n / m),)], out)


def median_squared_distance(units: DataFrame, sample: int = 2048, seed: int | str = 0, least: float = 1e-6) -> float:
    """The median squared distance of the pairs of ``sample`` random units: a kernel's bandwidth."""
    picked = units.select("unit_id", "vec").orderBy(shuffle_key(seed, F.col("unit_id")), "unit_id").limit(sample)
    a = picked.select(F.col("unit_id").alias("i"), F.col("vec").alias("_a"))
    b = picked.select(F.col("unit_id").alias("j"), F.col("vec").alias("_b"))
    d = a.join(F.broadcast(b), F.col("i") < F.col("j")).select(squared_distance(F.col("_a"), F.col("_b")).alias("d"))
    found = d.where("d > 0").agg(F.percentile("d", 0.5).alias("m")).first()["m"]
    return max(found or 1.0, least)


def moments(units: DataFrame, by: list[str] | None = None, variance: str | None = None) -> DataFrame:
    """``[by,] i, mean, var`` of each dimension: means, and population variances plus the mean of the rows' own variances if they have any."""
    keys = by or []
    if variance is None:
        return units.select(*keys, F.posexplode("vec").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    zipped = units.select(*keys, F.posexplode(F.arrays_zip(F.col("vec").alias("m"), F.col(variance).alias("v"))).alias("i", "p")).select(*keys, "i", "p.m", "p.v")
    return zipped.groupBy(*keys, "i").agg(F.avg("m").alias("mean"), (F.avg("v") + F.var_pop("m")).alias("var"))


def subset_symmetric_kl(units: DataFrame, selection: DataFrame, least: float = 1e-9) -> DataFrame:
    """``[candidate,] skl``: symmetric divergence of the Gaussians with the moments of the chosen and of all units."""
    keys = ["candidate"] if "candidate" in selection.columns else []
    whole = moments(units).select("i", F.col("mean").alias("_m"), F.greatest("var", F.lit(least)).alias("_v"))
    rows = selection.select(*keys, "unit_id").distinct().join(units.select("unit_id", "vec"), "unit_id")
    part = moments(rows, keys).withColumn("var", F.greatest("var", F.lit(least))).join(F.broadcast(whole), "i")
    d = F.col("mean") - F.col("_m")
    term = F.col("var") / F.col("_v") + F.col("_v") / F.col("var") - 2 + d * d * (1 / F.col("var") + 1 / F.col("_v"))
    return part.groupBy(*keys).agg((F.sum(term) / 2).alias("skl"))


def nearest_neighbours(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """``unit_id, neighbour, distance, place``: the k nearest points of each query, nearest first, itself left out."""
    place = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.round("distance", 12), "neighbour"))
    return _neighbours(queries, points, k, True).withColumn("place", place)


def knn_predict(queries: DataFrame, points: DataFrame, k: int, target: str) -> DataFrame:
    """``unit_id, y_pred``: the mean of the k nearest points' ``target``, weighted by inverse distance; a point at distance 0 decides alone."""
    near = nearest_neighbours(queries, points, k).join(points.select(F.col("unit_id").alias("neighbour"), F.col(target).cast("double").alias("_y")), "neighbour")
    exact = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)) > 0
    same = F.avg(F.when(F.col("distance") == 0, F.col("_y")))
    far = F.sum(F.when(F.col("distance") > 0, F.col("_y") / F.col("distance"))) / F.sum(F.when(F.col("distance") > 0, 1 / F.col("distance")))
    return near.groupBy("unit_id").agg(F.when(exact, same).otherwise(far).alias("y_pred"))
