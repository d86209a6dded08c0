"""Selectors: nine ways of choosing k units, from the whole table or by group quotas.

Up to ``pool`` vectors of a group are chosen from in one task; groups run side by
side. The greedy selectors (farthest-first, determinantal, herding, seeding) and
the leverage draw choose the same units from a table of any size: beyond ``pool``
they go over the table instead and keep only the chosen vectors (see ``_passes``).
Clusterings and thinning have no such form: beyond ``pool`` a group is dealt into
parts of that size, each part proposes units by the same selector, and the
selector chooses among all proposals until they fit (the two-round scheme of
distributed greedy selection). For them ``pool`` is a parameter of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import shuffle_key
from ..shipping import ship
from ..storage import materialise
from .kernels import RandomFeatures, complete, gaussian, hashed_uniform, leverage_scores, squared_distances, sum_matrix, vectors_of
from .quotas import quota_sample, uniform_sample

#: Vectors that one task chooses from.
POOL = 20_000
#: Rows that a pass over the table brings back in all, and for a group.
BACK, BACK_EACH = 20_000, 512
#: Random features behind herding, determinantal and leverage selection.
FEATURES = 256


# -- in memory ------------------------------------------------------------


def _plus_plus(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Indices seeded by squared distance to those before."""
    chosen = [int(random.integers(len(x)))]
    near = squared_distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        total = near.sum()
        weights = near / total if total > 0 else None
        i = int(random.choice(len(x), p=weights)) if total > 0 else int(random.choice(np.setdiff1d(np.arange(len(x)), chosen)))
        chosen.append(i)
        near = np.minimum(near, squared_distances(x, x[i : i + 1])[:, 0])
    return np.array(chosen)


def lloyd(x: np.ndarray, k: int, random: np.random.Generator, steps: int = 50, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of k-means from seeded centres, or from the members ``first``; an empty cluster keeps its centre."""
    centres = x[_plus_plus(x, k, random) if first is None else first].copy()
    labels = np.full(len(x), -1)
    for _ in range(steps):
        after = squared_distances(x, centres).argmin(axis=1)
        if (after == labels).all():
            break
        labels = after
        counts = np.bincount(labels, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, labels, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres, labels


def lloyd_passes(units: DataFrame, centres: np.ndarray, steps: int = 50) -> np.ndarray:
    """``lloyd`` from given centres over a table of any size: a sum for each centre at each step, until the centres rest."""
    k = len(centres)

    def step(now: np.ndarray) -> np.ndarray:
        def sums(batch: pa.RecordBatch) -> np.ndarray:
            x = vectors_of(batch.column(0))
            out = np.zeros((k, x.shape[1] + 1))
            np.add.at(out, squared_distances(x, now).argmin(axis=1), np.column_stack([x, np.ones(len(x))]))
            return out

        total = sum_matrix(units.select("vec"), sums)
        after, some = now.copy(), total[:, -1] > 0
        after[some] = total[some, :-1] / total[some, -1:]
        return after

    for _ in range(steps):
        after = step(centres)
        if np.array_equal(after, centres):
            break
        centres = after
    return centres


def _fill(chosen: list[int], n: int, k: int, random: np.random.Generator, keys: np.ndarray | None = None) -> np.ndarray:
    """Distinct indices, topped up to k at random or by least key."""
    out = list(dict.fromkeys(chosen))[:k]
    if len(out) < k and keys is not None:
        rest = np.setdiff1d(np.arange(n), out)
        out += rest[np.argsort(keys[rest], kind="stable")][: k - len(out)].tolist()
    elif len(out) < k:
        out += random.choice(np.setdiff1d(np.arange(n), out), k - len(out), replace=False).tolist()
    return np.array(out)


def kmeans_members(x: np.ndarray, k: int, random: np.random.Generator, keys: np.ndarray | None = None, **options) -> np.ndarray:
    """The member nearest each centre. With keys the centres start from ``plus_plus``."""
    centres, labels = lloyd(x, k, random, first=None if keys is None else plus_plus(x, k, random, keys=keys, **options))
    distance = squared_distances(x, centres)
    chosen = []
    for c in range(k):
        own = np.flatnonzero(labels == c)
        if len(own):
            chosen.append(int(own[distance[own, c].argmin()]))
    return _fill(chosen, len(x), k, random, keys)


def farthest_first(x: np.ndarray, k: int, random: np.random.Generator, keys: np.ndarray | None = None, **_) -> np.ndarray:
    """Starts with the member whose key is least, then takes the one farthest from all chosen (the first of several)."""
    chosen = [int(random.integers(len(x))) if keys is None else int(np.argmin(keys))]
    near = squared_distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        near[chosen] = -1
        i = int(near.argmax())
        chosen.append(i)
        near = np.minimum(near, squared_distances(x, x[i : i + 1])[:, 0])
    return np.array(chosen)


def _phi(x: np.ndarray, sigma_sq: float, seed: int) -> np.ndarray:
    return RandomFeatures.build(x.shape[1], FEATURES, sigma_sq, seed)(x)


def herding(x: np.ndarray, k: int, random: np.random.Generator, sigma_sq: float = 1.0, seed: int = 0, keys: np.ndarray | None = None, **_) -> np.ndarray:
    """Greedily follows the mean embedding; of a tie (within 1e-10) the member with the least key, else one at random."""
    phi = _phi(x, sigma_sq, seed)
    mean, total = phi.mean(axis=0), np.zeros(phi.shape[1])
    free, chosen = np.ones(len(x), bool), []
    for t in range(k):
        gain = phi @ ((t + 1) * mean - total)
        gain[~free] = -np.inf
        tied = np.flatnonzero(gain >= gain.max() - 1e-10)
        i = int(random.choice(tied)) if keys is None else int(tied[np.argmin(keys[tied])])
        chosen.append(i)
        free[i] = False
        total += phi[i]
    return np.array(chosen)


def _residuals(phi: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Squared lengths of what is left of each row outside the span of ``chosen``, in the order in which they were chosen."""
    rest, basis = (phi**2).sum(axis=1), np.zeros((0, phi.shape[1]))
    for row in chosen:
        direction = row - basis.T @ (basis @ row)
        size = np.linalg.norm(direction)
        if size > 1e-9:
            basis = np.vstack([basis, direction / size])
            rest = np.maximum(rest - (phi @ basis[-1]) ** 2, 0.0)
    return rest


def determinantal(x: np.ndarray, k: int, random: np.random.Generator, sigma_sq: float = 1.0, seed: int = 0, keys: np.ndarray | None = None, **_) -> np.ndarray:
    """Greedy maximum of the determinant of random-feature inner products, by residual norms."""
    phi = _phi(x, sigma_sq, seed)
    rest = (phi**2).sum(axis=1)
    basis = np.zeros((0, phi.shape[1]))
    chosen: list[int] = []
    for _step in range(min(k, phi.shape[1])):
        score = rest.copy()
        score[chosen] = -1
        i = int(score.argmax())
        if score[i] < 1e-12:
            break
        direction = phi[i] - basis.T @ (basis @ phi[i])
        size = np.linalg.norm(direction)
        chosen.append(i)
        if size > 1e-9:
            basis = np.vstack([basis, direction / size])
            rest = np.maximum(rest - (phi @ basis[-1]) ** 2, 0.0)
        else:
            rest[i] = 0.0
    return _fill(chosen, len(x), k, random, keys)


def leverage_sample(x: np.ndarray, k: int, random: np.random.Generator, sigma_sq: float = 1.0, seed: int = 0, penalty: float = 1e-3, keys: np.ndarray | None = None, **_) -> np.ndarray:
    """Weighted draw without replacement by ridge leverage; the noise comes from the keys, if any."""
    phi = _phi(x, sigma_sq, seed)
    half = np.linalg.solve(np.linalg.cholesky(phi.T @ phi + penalty * np.eye(phi.shape[1])), np.eye(phi.shape[1])).T
    score = ((phi @ half) ** 2).sum(axis=1)
    noise = random.gumbel(size=len(x)) if keys is None else -np.log(-np.log((np.array([int(key[:8], 16) for key in keys]) + 0.5) / 2**32))
    return np.argsort(-(np.log(np.maximum(score, 1e-12)) + noise), kind="stable")[:k]


def _halve(order: np.ndarray, x: np.ndarray, sigma_sq: float, random: np.random.Generator, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Splits a sequence into two halves whose kernel sums stay close: pairs are assigned by a self-balancing walk."""
    first, second = [], []
    bound = 0.0
    for a, b in order[: len(order) // 2 * 2].reshape(-1, 2):
        pair = x[[a, b]]
        width = 2 - 2 * float(gaussian(pair[:1], pair[1:], sigma_sq)[0, 0])
        bound_next = max(bound, width)
        level = max(np.sqrt(width) * np.sqrt(2 * bound * np.log(2 / delta)) if bound else 0.0, width)
        bound = bound_next + bound * max(0.0, 1 + (width - 2 * level) * width / max(level, 1e-12) ** 2) if bound else bound_next
        drift = 0.0
        if first:
            drift = float((gaussian(pair, x[first], sigma_sq).sum(axis=1) - gaussian(pair, x[second], sigma_sq).sum(axis=1)) @ [1, -1])
        keep = random.random() < min(1.0, max(0.0, 0.5 * (1 - drift / max(level, 1e-12))))
        first.append(a if keep else b)
        second.append(b if keep else a)
    return np.array(first, int), np.array(second, int)


def thinning(x: np.ndarray, k: int, random: np.random.Generator, sigma_sq: float = 1.0, delta: float = 0.5, **_) -> np.ndarray:
    """Kernel thinning: halvings while more than 2k points are left, the best candidate, then swaps that lower the discrepancy."""
    n = len(x)
    rounds = int(np.floor(np.log2(max(n / k, 1))))
    candidates = [random.permutation(n)]
    for _round in range(rounds):
        candidates = [half for c in candidates for half in _halve(c, x, sigma_sq, random, delta / max(n, 2)) if len(half)]
    mean = np.concatenate([gaussian(x[i : i + 512], x, sigma_sq).mean(axis=1) for i in range(0, n, 512)])
    gap = lambda s: gaussian(x[s], x[s], sigma_sq).mean() - 2 * mean[s].mean()
    best = list(min(candidates, key=gap))
    best = list(_fill([int(i) for i in random.permutation(best)], n, k, random)) if len(best) > k else list(_fill(best, n, k, random))
    total = gaussian(x, x[best], sigma_sq).sum(axis=1)
    for place in range(k):
        i = best[place]
        without = total - gaussian(x, x[i : i + 1], sigma_sq)[:, 0]
        score = (2 * without + 1) / k - 2 * mean
        score[[j for j in best if j != i]] = np.inf
        best[place] = int(score.argmin())
        total = without + gaussian(x, x[best[place] : best[place] + 1], sigma_sq)[:, 0]
    return np.array(best)


def kernel_kmeans(x: np.ndarray, k: int, random: np.random.Generator, sigma_sq: float = 1.0, landmarks: int = 0, rank: int = 64, **_) -> np.ndarray:
    """k-means on Nyström features from k-means++ landmarks; the member nearest each mean."""
    count = min(len(x), landmarks or max(2 * k, 32))
    marks = x[_plus_plus(x, count, random)]
    values, vectors = np.linalg.eigh(gaussian(marks, marks, sigma_sq))
    top = np.argsort(values)[::-1][: min(rank, count)]
    keep = top[values[top] > 1e-10]
    return kmeans_members(gaussian(x, marks, sigma_sq) @ (vectors[:, keep] / np.sqrt(values[keep])), k, random)


def any_units(x: np.ndarray, k: int, random: np.random.Generator, **_) -> np.ndarray:
    return random.choice(len(x), k, replace=False)


METHODS: dict[str, Callable[..., np.ndarray]] = {
    "uniform": any_units, "kmeans": kmeans_members, "herding": herding, "farthest": farthest_first, "leverage": leverage_sample, "determinantal": determinantal, "thinning": thinning, "kernel_kmeans": kernel_kmeans,
}


# -- on tables ------------------------------------------------------------


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.md5("|".join(map(str, parts)).encode()).digest()[:8], "little")


def select(units: DataFrame, method: str, k: int | None = None, quotas: DataFrame | None = None, seed: int = 0, sigma_sq: float = 1.0, pool: int = POOL) -> DataFrame:
    """``unit_id, grp`` of ``k`` units, or of each group's quota ``c``, chosen by ``method`` from ``units`` (``unit_id, grp, vec``).

    All random steps go by ``seed`` and the group, so a rerun gives the same units on any cluster.
    """
    if (k is None) == (quotas is None):
        raise ValueError("either k or quotas")
    if method == "uniform":
        return (uniform_sample(units, k, seed) if quotas is None else quota_sample(units, quotas, seed)).select("unit_id", "grp")
    ship(units.sparkSession)
    chooser = METHODS[method]
    kind = dict(units.dtypes)
    rows = units.select("unit_id", "grp", "vec")
    rows = rows.withColumn("_c", F.lit(k)).withColumn("_key", F.lit("all")) if quotas is None else rows.join(F.broadcast(quotas.select(F.col("grp").alias("_g"), F.col("c").cast("int").alias("_c"))), F.col("grp").eqNullSafe(F.col("_g"))).drop("_g").where("_c > 0").withColumn("_key", F.coalesce(F.col("grp").cast("string"), F.lit("null")))
    rows = rows.select("unit_id", "grp", "vec", F.col("_c").cast("int").alias("c"), "_key")
    schema = f"unit_id {kind['unit_id']}, grp {kind['grp']}, vec array<double>, c int, _key string"
    rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("unit_id", ignore_index=True)
        x, want, name = np.array(frame["vec"].tolist(), float), int(frame["c"].iloc[0]), frame["_key"].iloc[0]
        if want < len(frame):
            keys = np.array([hashlib.md5(f"{seed}|{u}".encode()).hexdigest() for u in frame["unit_id"]])  # as shuffle_key has them
            picked = chooser(x, want, np.random.default_rng(_seed(seed, method, name)), sigma_sq=sigma_sq, seed=seed, keys=keys, ids=frame["unit_id"].to_numpy())
            frame = frame.iloc[np.sort(picked)]
        return frame[["unit_id", "grp", "vec", "c", "_key"]]

    if method in _STEPS or method == "leverage":
        largest = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("n")).first()["n"] or 0
        if largest > pool:
            if method == "leverage" and quotas is None:
                return leverage_select(units, k, sigma_sq, FEATURES, seed=seed).select("unit_id", "grp")
            if method in _STEPS:
                return _passes(rows, method, sigma_sq, seed)
    while True:
        sizes = rows.groupBy(F.col("_key").alias("_k"), F.col("c").alias("_want")).agg(F.count(F.lit(1)).alias("_n"))
        largest = sizes.agg(F.max("_n").alias("n"), F.max("_want").alias("c")).first()
        if not largest["n"] or largest["n"] <= max(pool, 2 * (largest["c"] or 0)):
            break
        dealt = rows.join(F.broadcast(sizes.drop("_want")), F.col("_key") == F.col("_k"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / max(pool, 2 * largest["c"])))
        part = F.pmod(F.conv(F.substring(shuffle_key(f"{seed}|part", F.col("unit_id")), 1, 12), 16, 10).cast("long"), parts)
        rows = dealt.withColumn("_part", part).select("unit_id", "grp", "vec", "c", "_key", "_part").groupBy("_key", "_part").applyInPandas(choose, schema)
        # Each pass is written, so that the next one's counts don't run it again.
        rows = materialise(rows, "proposals")
    return rows.groupBy("_key").applyInPandas(choose, schema).select("unit_id", "grp")


# -- over tables of any size -----------------------------------------------


def _score_farthest(x: np.ndarray, ids: np.ndarray, chosen: np.ndarray, seed: int, **_) -> np.ndarray:
    return squared_distances(x, chosen).min(axis=1)


def _score_determinantal(x: np.ndarray, ids: np.ndarray, chosen: np.ndarray, seed: int, sigma_sq: float, **_) -> np.ndarray:
    return _residuals(_phi(x, sigma_sq, seed), _phi(chosen, sigma_sq, seed)) if len(chosen) else (_phi(x, sigma_sq, seed) ** 2).sum(axis=1)


def _score_herding(x: np.ndarray, ids: np.ndarray, chosen: np.ndarray, seed: int, sigma_sq: float, mean: np.ndarray, **_) -> np.ndarray:
    phi = _phi(x, sigma_sq, seed)
    held = _phi(chosen, sigma_sq, seed).sum(axis=0) if len(chosen) else 0.0
    return phi @ ((len(chosen) + 1) * mean - held)


def _score_plus_plus(x: np.ndarray, ids: np.ndarray, chosen: np.ndarray, seed: int, **_) -> np.ndarray:
    near = squared_distances(x, chosen).min(axis=1)
    noise = -np.log(-np.log(np.array([hashed_uniform(seed, len(chosen), u) for u in ids])))
    return np.where(near > 0, np.log(np.maximum(near, 1e-300)) + noise, -np.inf)


#: Score of a step, whether scores never rise as more are chosen, whether the least key starts, and the least score that counts.
_STEPS = {
    "farthest": (_score_farthest, True, True, -1.0), "determinantal": (_score_determinantal, True, False, 1e-12),
    "herding": (_score_herding, False, False, -np.inf), "plus_plus": (_score_plus_plus, False, True, -1e300),
}


def _passes(rows: DataFrame, method: str, sigma_sq: float, seed: int) -> DataFrame:
    """A greedy selector over groups of any size, with the picks that it makes in memory.

    ``rows``: ``unit_id, grp, vec, c, _key``. A pass scores every unit against its group's chosen vectors and brings back
    each group's best few. Where scores never rise, a unit that stays above the worst of those is the best of all, so one pass
    gives many picks; otherwise one. The driver holds chosen and returned vectors only: ``BACK`` rows beside the selection.
    """
    score, lazy, keyed, least = _STEPS[method]
    spark = rows.sparkSession
    key_of = lambda unit: hashlib.md5(f"{seed}|{unit}".encode()).hexdigest()
    wanted = {r["_key"]: (int(r["c"]), int(r["n"])) for r in rows.groupBy("_key").agg(F.max("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    chosen: dict[str, list[tuple]] = {g: [] for g in wanted}
    means: dict[str, np.ndarray] = {}
    options = {"sigma_sq": sigma_sq}
    if method == "herding":
        names = sorted(wanted)
        place = {g: i for i, g in enumerate(names)}

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(names), FEATURES + 1))
            phi = _phi(vectors_of(batch.column(1)), sigma_sq, seed)
            np.add.at(out, [place[g] for g in batch.column(0).to_pylist()], np.column_stack([phi, np.ones(len(phi))]))
            return out

        total = sum_matrix(rows.select("_key", "vec"), sums)
        means = {g: total[i, :-1] / total[i, -1] for g, i in place.items()}
    if keyed:
        first = rows.groupBy("_key").agg(F.min_by(F.struct("unit_id", "vec"), F.struct(shuffle_key(seed, F.col("unit_id")), "unit_id")).alias("_f"))
        for r in first.collect():
            chosen[r["_key"]].append((r["_f"]["unit_id"], np.array(r["_f"]["vec"], float)))
    each = max(2, min(BACK_EACH if lazy else 8, BACK // max(len(wanted), 1)))
    kind = dict(rows.dtypes)["unit_id"]
    open_groups = {g for g, (c, n) in wanted.items() if len(chosen[g]) < min(c, n)}
    while open_groups:
        held = spark.sparkContext.broadcast({g: ([u for u, _ in chosen[g]], np.array([v for _, v in chosen[g]])) for g in open_groups})

        def scored(batches):
            for batch in batches:
                groups = np.array(batch.column(1).to_pylist(), object)
                x, units = vectors_of(batch.column(2)), batch.column(0).to_pylist()
                for g in set(groups) & set(held.value):
                    at = np.flatnonzero(groups == g)
                    taken, vectors = held.value[g]
                    value = np.asarray(score(x[at], np.array(units, object)[at], vectors, seed, mean=means.get(g), **options), float)
                    free = ~np.isin(np.array(units)[at], taken) & (value > least) if taken else value > least
                    own = np.flatnonzero(free)
                    # Only a batch's own best can be among its group's.
                    own = own[np.lexsort((np.array(units)[at][own], -value[own]))[:each]]
                    best = pa.array(at[own])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(best) for i in range(3)), pa.array(value[own])], names=["unit_id", "_key", "vec", "score"])

        found = rows.select("unit_id", "_key", "vec").mapInArrow(scored, f"unit_id {kind}, _key string, vec array<double>, score double")
        rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.col("score").desc(), "unit_id"))
        back: dict[str, list] = {}
        for r in found.withColumn("_rank", rank).where(F.col("_rank") <= each).collect():
            back.setdefault(r["_key"], []).append((r["score"], r["unit_id"], np.array(r["vec"], float)))
        for g in list(open_groups):
            some = sorted(back.get(g, []), key=lambda r: (-r[0], r[1]))
            goal = min(wanted[g])
            limit = min(goal, FEATURES) if method == "determinantal" else goal
            if not some or len(chosen[g]) >= limit:
                open_groups.discard(g)
                continue
            whole, floor = len(some) < each, some[-1][0]
            ids, x = [r[1] for r in some], np.array([r[2] for r in some])
            value = np.array([r[0] for r in some])
            while len(chosen[g]) < limit:
                top = value.max()
                tied = np.flatnonzero(value >= top - (1e-10 if method == "herding" else 0.0))
                i = int(min(tied, key=lambda j: key_of(ids[j]))) if method == "herding" else int(tied[0])
                if not top > least or not np.isfinite(top):
                    break
                chosen[g].append((ids[i], x[i]))
                value[i] = -np.inf
                if not lazy:
                    break
                left = np.isfinite(value)
                if left.any():
                    value[left] = score(x[left], np.array(ids, object)[left], np.array([v for _, v in chosen[g]]), seed, mean=means.get(g), **options)
                if not whole and not value.max() > floor:
                    break
            if len(chosen[g]) >= limit or (lazy and whole):
                open_groups.discard(g)
    picked = [(g, u) for g, units in chosen.items() for u, _ in units]
    taken = spark.createDataFrame(pd.DataFrame({"_unit": [u for _, u in picked]}), f"_unit {kind}")
    base = rows.select("unit_id", "grp", "_key", "c").join(F.broadcast(taken.withColumn("_in", F.lit(True))), F.col("unit_id") == F.col("_unit"), "left")
    # Groups whose scores ran out are filled up by key, as in memory.
    order = Window.partitionBy("_key").orderBy(F.col("_in").desc_nulls_last(), shuffle_key(seed, F.col("unit_id")), "unit_id")
    return base.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("c")).select("unit_id", "grp")


def leverage_select(units: DataFrame, k: int, sigma_sq: float = 1.0, features: int = FEATURES, penalty: float = 1e-3, seed: int = 0, quotas: DataFrame | None = None) -> DataFrame:
    """Leverage selection with scores over the whole table, however large: one Gram sum, one scoring pass, one draw."""
    dimension = units.select(F.size("vec").alias("d")).limit(1).first()["d"]
    scored = leverage_scores(units, RandomFeatures.build(dimension, features, sigma_sq, seed), penalty)
    return (uniform_sample(scored, k, seed, "leverage") if quotas is None else quota_sample(scored, quotas, seed, "leverage")).select("unit_id", "grp", "leverage")


def global_then_quota(units: DataFrame, method: str, quotas: DataFrame, k: int, oversample: float = 2.0, seed: int = 0, sigma_sq: float = 1.0) -> DataFrame:
    """Chooses ``oversample`` * k units from the whole table, then brings them to the quotas."""
    from .quotas import project_to_quotas

    return project_to_quotas(units, select(units, method, int(np.ceil(oversample * k)), seed=seed, sigma_sq=sigma_sq), quotas, seed)


def kmeans_select(units: DataFrame, k: int, seed: int = 0, steps: int = 20) -> DataFrame:
    """k-means over the whole table by the engine's own distributed clustering; the member nearest each centre, filled up to ``k``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import squared_distance
    from .quotas import project_to_size

    rows = units.withColumn("_f", array_to_vector(F.col("vec").cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=steps, featuresCol="_f", predictionCol="_cluster").fit(rows)
    centres = units.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "_i int, _centre array<double>")
    near = model.transform(rows).join(F.broadcast(centres), F.col("_cluster") == F.col("_i")).select("_cluster", "unit_id", squared_distance(F.col("vec"), F.col("_centre")).alias("_d"))
    chosen = near.groupBy("_cluster").agg(F.min_by("unit_id", F.struct("_d", "unit_id")).alias("unit_id")).select("unit_id")
    return project_to_size(units, chosen, k, seed)


def plus_plus(x: np.ndarray, k: int, random: np.random.Generator, seed: int = 0, keys: np.ndarray | None = None, ids: np.ndarray | None = None, **_) -> np.ndarray:
    """Squared-distance seeding as a selector of its own. With ``keys`` and ``ids`` it starts with the least key, and each draw's noise is a digest of the step and the id."""
    if keys is None or ids is None:
        return _fill(_plus_plus(x, k, random).tolist(), len(x), k, random)
    chosen = [int(np.argmin(keys))]
    near = squared_distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        near[chosen] = 0.0
        if not near.max() > 0:
            break
        noise = -np.log(-np.log(np.array([hashed_uniform(seed, len(chosen), u) for u in ids])))
        chosen.append(int(np.argmax(np.where(near > 0, np.log(np.maximum(near, 1e-300)) + noise, -np.inf))))
        near = np.minimum(near, squared_distances(x, x[chosen[-1:]])[:, 0])
    return _fill(chosen, len(x), k, random)


METHODS["plus_plus"] = plus_plus


def sample_determinantal(kernel: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """An exact draw of ``k`` items with chance in proportion to the determinant of their part of ``kernel``.

    Eigenvectors are drawn by elementary symmetric polynomials, then items one
    by one from their span.
    """
    values, vectors = np.linalg.eigh(kernel)
    values = np.maximum(values, 0.0)
    n = len(values)
    scale = values.max() or 1.0
    lam = values / scale
    e = np.zeros((k + 1, n + 1))
    e[0] = 1.0
    for size in range(1, k + 1):
        for i in range(1, n + 1):
            e[size, i] = e[size, i - 1] + lam[i - 1] * e[size - 1, i - 1]
    if e[k, n] <= 0:
        raise ValueError(f"the kernel's rank is below {k}")
    picked, left = [], k
    for i in range(n, 0, -1):
        if left and random.random() < lam[i - 1] * e[left - 1, i - 1] / e[left, i]:
            picked.append(i - 1)
            left -= 1
    basis, chosen = vectors[:, picked], []
    for _ in range(k):
        weight = np.maximum((basis**2).sum(axis=1), 0.0)
        weight[chosen] = 0.0
        i = int(random.choice(n, p=weight / weight.sum()))
        chosen.append(i)
        j = int(np.abs(basis[i]).argmax())
        basis = basis - np.outer(basis[:, j], basis[i] / basis[i, j])
        basis = np.delete(basis, j, axis=1)
        if basis.shape[1]:
            basis = np.linalg.qr(basis)[0]
    return np.array(chosen)


def draw_determinantal(units: DataFrame, k: int, sigma_sq: float, seed: int = 0, draws: int = 1, least: float = 1e-7) -> DataFrame:
    """``draw, unit_id``: exact draws of ``k`` units with chance in proportion to the determinant of their part of the Gaussian kernel, at any size.

    The kernel's diagonal is 1, so by Hadamard's inequality no determinant exceeds 1: ``k`` units proposed at random and taken with the chance of
    their determinant have that law, and only proposals are looked at. Equal vectors make a determinant 0, so they are one class, proposed with
    the chance of its units, of which one is drawn in the end. How many proposals a draw takes hangs on how near the units lie, not on their
    number. ValueError for fewer than ``k`` different vectors, or where under one proposal in 1 / ``least`` is taken.
    """
    spark = units.sparkSession
    ship(spark)
    kind = dict(units.dtypes)["unit_id"]
    rows = complete(units).select("unit_id", F.col("vec").cast("array<double>").alias("vec"))
    classes = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("w"), F.min("unit_id").alias("unit_id"))
    # A class has a place in its bucket of those of its weight: no window goes over the whole table.
    buckets = max(1, rows.count() // POOL)
    place = F.row_number().over(Window.partitionBy("w", "bucket").orderBy("unit_id")) - 1
    classes = materialise(classes.withColumn("bucket", F.pmod(F.xxhash64("unit_id"), F.lit(buckets)).cast("long")).withColumn("place", place.cast("long")), "classes")
    sizes = classes.groupBy("w", "bucket").count().orderBy("w", "bucket").toPandas()
    if sizes["count"].sum() < k:
        raise ValueError(f"fewer than {k} different vectors")
    weights, starts = np.unique(sizes["w"].to_numpy(), return_index=True)
    ends = [np.cumsum(part) for part in np.split(sizes["count"].to_numpy(), starts[1:])]
    shares = _weight_shares(weights, np.array([e[-1] for e in ends]), k)
    random = np.random.default_rng(seed)
    taken: list[int] = []
    proposed, first = [], 0
    while len(taken) < draws:
        now = min(max(4096, 2 * first), 1 << 17)
        some = []
        for p in range(first, first + now):
            left = k
            for i in range(len(weights) - 1, -1, -1):
                j = int(random.choice(left + 1, p=shares[i][left])) if i else left
                for at in random.choice(int(ends[i][-1]), j, replace=False, shuffle=False) if j else ():
                    bucket = int(np.searchsorted(ends[i], at, side="right"))
                    some.append((p, int(weights[i]), int(sizes["bucket"][starts[i] + bucket]), int(at - (ends[i][bucket - 1] if bucket else 0))))
                left -= j
        wanted = spark.createDataFrame(pd.DataFrame(some, columns=["candidate", "w", "bucket", "place"]))
        found = materialise(classes.join(F.broadcast(wanted), ["w", "bucket", "place"]).select("candidate", "unit_id", "vec", "w"), "proposals")
        scored = found.repartition(16, "candidate").groupBy("candidate").applyInArrow(lambda t: _log_determinant(t, sigma_sq), "candidate long, value double").toPandas().set_index("candidate")["value"]
        luck = np.log(random.random(now))
        hit = [first + i for i in range(now) if luck[i] < scored[first + i]]
        proposed += [found.where(F.col("candidate").isin(hit))]
        taken += hit
        first += now
        if len(taken) < draws and first * least > max(1, len(taken)):
            raise ValueError(f"{len(taken)} of {first} proposals taken")
    order = {p: i for i, p in enumerate(taken[:draws])}
    out = []
    for r in sorted((r for part in proposed for r in part.collect() if r["candidate"] in order), key=lambda r: (r["candidate"], r["unit_id"])):
        unit = r["unit_id"]
        if r["w"] > 1:
            nth = int(random.integers(r["w"]))
            same = rows.join(F.broadcast(spark.createDataFrame([(r["vec"],)], "vec array<double>")), "vec", "left_semi")
            unit = same.select("unit_id").orderBy("unit_id").limit(nth + 1).agg(F.max("unit_id").alias("u")).first()["u"]
        out.append((order[r["candidate"]], unit))
    return spark.createDataFrame(out, f"draw int, unit_id {kind}")


def _log_determinant(rows: pa.Table, sigma_sq: float) -> pa.Table:
    rows = rows.sort_by("unit_id").combine_chunks()
    x = vectors_of(rows.column("vec").chunk(0))
    x = x - x.mean(axis=0)
    sign, value = np.linalg.slogdet(gaussian(x, x, sigma_sq))
    return pa.table({"candidate": rows.column("candidate").slice(0, 1), "value": pa.array([float(value) if sign > 0 else -np.inf])})


def _weight_shares(weights: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each weight the chances of how many of the ``left`` classes still to draw have it, where sets of ``k`` classes are as likely as the product of their weights."""
    from math import lgamma, log

    choose = lambda n, j: lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
    so_far = np.full(k + 1, -np.inf)  # logarithms of the sums over sets of the weights up to here
    so_far[0] = 0.0
    out = []
    for w, n in zip(weights, counts):
        own = np.array([choose(n, j) + j * log(w) if j <= n else -np.inf for j in range(k + 1)])
        shares, after = [], np.full(k + 1, -np.inf)
        for left in range(k + 1):
            terms = own[: left + 1] + so_far[left::-1]
            top = terms.max()
            chances = np.exp(terms - top) if np.isfinite(top) else np.eye(left + 1)[0]
            after[left] = top + log(chances.sum())
            shares.append(chances / chances.sum())
        so_far = after
        out.append(shares)
    return out
