"""Constrained multi-objective search for subsets: non-dominated sorting genetic search over populations of selections.

The population (some hundred selections of k units) lives on the driver as
arrays of unit places; variation and repair are array steps there. Objectives
of a whole generation are one distributed job: ``candidate, unit_id`` rows joined with the
units' vectors. The driver needs each unit's id, group and weight, so the search runs over at most ``MOST_UNITS`` units;
larger tables search among a quota sample of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..storage import delete, exists

MOST_UNITS = 1_000_000
Evaluate = Callable[[list[np.ndarray]], np.ndarray]


# -- sorting and selection of candidates ----------------------------------


def fronts(f: np.ndarray) -> list[np.ndarray]:
    """Rows by front: the first is dominated by none, the next only by those before."""
    less = (f[:, None] <= f[None]).all(2) & (f[:, None] < f[None]).any(2)
    above = less.sum(axis=0)
    out, left = [], np.arange(len(f))
    while len(left):
        free = left[above[left] == 0]
        out.append(free)
        above = above - less[free].sum(axis=0)
        left = np.setdiff1d(left, free)
    return out


def crowding_distance(f: np.ndarray) -> np.ndarray:
    """Summed neighbour gaps of one front; ends, and all of up to two rows, are infinite."""
    if len(f) <= 2:
        return np.full(len(f), np.inf)
    out = np.zeros(len(f))
    for j in range(f.shape[1]):
        order = np.argsort(f[:, j], kind="stable")
        span = f[order[-1], j] - f[order[0], j]
        out[order[[0, -1]]] = np.inf
        if span > 1e-12:
            out[order[1:-1]] += (f[order[2:], j] - f[order[:-2], j]) / span
    return out


def constrained_fronts(f: np.ndarray, violation: np.ndarray) -> list[np.ndarray]:
    """Feasible rows by front, then infeasible ones as one front in order of violation."""
    good, bad = np.flatnonzero(violation <= 0), np.flatnonzero(violation > 0)
    out = [good[part] for part in fronts(f[good])] if len(good) else []
    return [*out, bad[np.argsort(violation[bad], kind="stable")]] if len(bad) else out


def survivors(f: np.ndarray, violation: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``count`` rows to keep with their ranks and crowding: whole fronts, the last one by crowding (infeasible ones by violation)."""
    kept, ranks, crowd = [], [], []
    for r, part in enumerate(constrained_fronts(f, violation)):
        bad = violation[part[0]] > 0
        gaps = -np.arange(len(part), dtype=float) if bad else crowding_distance(f[part])
        take = min(count - len(kept), len(part))
        order = np.argsort(-gaps, kind="stable")[:take]
        kept += part[order].tolist()
        ranks += [r] * take
        crowd += gaps[order].tolist()
        if len(kept) == count:
            break
    return np.array(kept), np.array(ranks), np.array(crowd)


def tournament(random: np.random.Generator, ranks: np.ndarray, crowd: np.ndarray, count: int) -> np.ndarray:
    """Winners of pairs by rank, then crowding, then a coin."""
    a, b = random.integers(len(ranks), size=(2, count))
    first = (ranks[a] < ranks[b]) | (ranks[a] == ranks[b]) & (crowd[a] > crowd[b])
    tied = (ranks[a] == ranks[b]) & (crowd[a] == crowd[b])
    return np.where(first | tied & (random.random(count) < 0.5), a, b)


# -- variation and repair --------------------------------------------------


def crossover(random: np.random.Generator, a: np.ndarray, b: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Exchanges each unit that only one parent holds with even chance."""
    if random.random() >= chance:
        return a, b
    both, differ = np.intersect1d(a, b), np.setxor1d(a, b)
    to_first = random.random(len(differ)) < 0.5
    return np.union1d(both, differ[to_first]), np.union1d(both, differ[~to_first])


def swap_within_groups(random: np.random.Generator, chosen: np.ndarray, groups: np.ndarray, members: list[np.ndarray], swaps: int = 1) -> np.ndarray:
    """Replaces ``swaps`` chosen units by others of their groups, where a group has any."""
    out = set(chosen.tolist())
    for _ in range(swaps):
        for _try in range(50):
            i = random.choice(list(out))
            others = np.setdiff1d(members[groups[i]], list(out), assume_unique=True)
            if len(others):
                out.remove(i)
                out.add(int(random.choice(others)))
                break
    return np.array(sorted(out))


def flip(random: np.random.Generator, chosen: np.ndarray, n: int, chance: float) -> np.ndarray:
    """Each unit's membership turns with ``chance``; repair brings the size back."""
    return np.setxor1d(chosen, np.flatnonzero(random.random(n) < chance))


def repair_size(random: np.random.Generator, chosen: np.ndarray, n: int, k: int) -> np.ndarray:
    if len(chosen) > k:
        return np.sort(random.choice(chosen, k, replace=False))
    if len(chosen) < k:
        return np.union1d(chosen, random.choice(np.setdiff1d(np.arange(n), chosen), k - len(chosen), replace=False))
    return chosen


def repair_quotas(random: np.random.Generator, chosen: np.ndarray, groups: np.ndarray, members: list[np.ndarray], quotas: np.ndarray) -> np.ndarray:
    """Drops from groups above their quota and adds to groups below, at random."""
    parts = []
    for g, want in enumerate(quotas):
        own = chosen[groups[chosen] == g]
        if len(own) > want:
            own = random.choice(own, want, replace=False)
        elif len(own) < want:
            own = np.r_[own, random.choice(np.setdiff1d(members[g], own), want - len(own), replace=False)]
        parts.append(own)
    return np.sort(np.concatenate(parts).astype(int))


def least_harm_size(chosen: np.ndarray, n: int, k: int, harm: Callable[[np.ndarray], float], random: np.random.Generator, tries: int = 32) -> np.ndarray:
    """Brings a selection to ``k`` units, each step the one of ``tries`` random moves that raises ``harm`` least."""
    out = chosen.copy()
    while len(out) != k:
        pool = out if len(out) > k else np.setdiff1d(np.arange(n), out)
        moves = random.choice(pool, min(tries, len(pool)), replace=False)
        results = [np.setdiff1d(out, [m]) if len(out) > k else np.union1d(out, [m]) for m in moves]
        out = results[int(np.argmin([harm(r) for r in results]))]
    return out


def least_harm_quotas(chosen: np.ndarray, groups: np.ndarray, members: list[np.ndarray], quotas: np.ndarray, harm: Callable[[np.ndarray], float], random: np.random.Generator, tries: int = 32) -> np.ndarray:
    """Brings every group to its quota, each step the one of ``tries`` random moves inside a group that raises ``harm`` least."""
    out = chosen.copy()
    for g, want in enumerate(quotas):
        while (have := int((groups[out] == g).sum())) != want:
            pool = out[groups[out] == g] if have > want else np.setdiff1d(members[g], out)
            moves = random.choice(pool, min(tries, len(pool)), replace=False)
            results = [np.setdiff1d(out, [m]) if have > want else np.union1d(out, [m]) for m in moves]
            out = results[int(np.argmin([harm(r) for r in results]))]
    return out


@dataclass
class Proportionality:
    """A limit on the divergence of a selection's smoothed group shares, by count or by weight, from target shares."""

    target: np.ndarray
    weights: np.ndarray | None = None
    alpha: float = 1.0
    limit: float = 0.02
    tried: list[int] = field(default_factory=list)

    def divergence(self, chosen: np.ndarray, groups: np.ndarray) -> float:
        if not len(chosen):
            return float("inf")
        own = np.ones(len(chosen)) if self.weights is None else self.weights[chosen] / max(self.weights[chosen].mean(), 1e-30)
        sums = np.bincount(groups[chosen], own, len(self.target))
        share = (sums + self.alpha) / (sums.sum() + self.alpha * len(sums))
        positive = self.target > 0
        return float((self.target[positive] * np.log(self.target[positive] / (share[positive] + 1e-30))).sum())

    def violation(self, chosen: np.ndarray, groups: np.ndarray) -> float:
        return max(self.divergence(chosen, groups) - self.limit, 0.0)

    def swap_towards(self, chosen: np.ndarray, groups: np.ndarray, members: list[np.ndarray], random: np.random.Generator, keep_counts: bool) -> np.ndarray | None:
        """One swap from the group furthest above its share to the one furthest below; within groups by weight where counts must stay."""
        own = np.ones(len(groups)) if self.weights is None else self.weights
        sums = np.bincount(groups[chosen], own[chosen], len(self.target))
        share = sums / max(sums.sum(), 1e-30)
        ratio = np.where(self.target > 0, share / np.maximum(self.target, 1e-30), np.inf)
        if keep_counts:
            over, under = int(np.argmax(np.where(sums > 0, ratio, -np.inf))), int(np.argmin(ratio))
            for g, heavy in ((over, True), (under, False)):
                inside, outside = chosen[groups[chosen] == g], np.setdiff1d(members[g], chosen)
                if len(inside) and len(outside):
                    out = inside[own[inside].argmax() if heavy else own[inside].argmin()]
                    into = outside[own[outside].argmin() if heavy else own[outside].argmax()]
                    if (own[into] < own[out]) == heavy and own[into] != own[out]:
                        return np.sort(np.r_[np.setdiff1d(chosen, [out]), into])
            return None
        counts = np.bincount(groups[chosen], minlength=len(self.target))
        room = np.array([len(m) for m in members]) - counts
        donors, takers = np.flatnonzero(counts > 1), np.flatnonzero(room > 0)
        if not len(donors) or not len(takers):
            return None
        donor, taker = donors[ratio[donors].argmax()], takers[ratio[takers].argmin()]
        if donor == taker:
            return None
        out = random.choice(chosen[groups[chosen] == donor])
        into = random.choice(np.setdiff1d(members[taker], chosen))
        return np.sort(np.r_[np.setdiff1d(chosen, [out]), into])


def repair_constraints(chosen: np.ndarray, groups: np.ndarray, members: list[np.ndarray], limits: Sequence[Proportionality], random: np.random.Generator, keep_counts: bool = False, steps: int = 200) -> np.ndarray:
    """Swaps for the most violated limit until none is violated or no swap helps."""
    total = lambda s: sum(c.violation(s, groups) for c in limits)
    now = total(chosen)
    for _ in range(steps):
        if now <= 0:
            break
        worst = max(limits, key=lambda c: c.violation(chosen, groups))
        tried = worst.swap_towards(chosen, groups, members, random, keep_counts)
        if tried is None or (after := total(tried)) >= now - 1e-12:
            break
        chosen, now = tried, after
    return chosen


def greedy_start(groups: np.ndarray, members: list[np.ndarray], limits: Sequence[Proportionality], k: int, random: np.random.Generator) -> np.ndarray:
    """Units added one by one from the group that lowers the summed divergences most."""
    chosen: list[int] = []
    free = [list(random.permutation(m)) for m in members]
    for _ in range(k):
        best, value = -1, float("inf")
        for g, pool in enumerate(free):
            if pool:
                total = sum(c.divergence(np.array([*chosen, pool[-1]]), groups) for c in limits)
                if total < value:
                    best, value = g, total
        if best < 0:
            break
        chosen.append(int(free[best].pop()))
    return np.sort(chosen)


def hypervolume_2d(f: np.ndarray, reference: np.ndarray) -> float:
    inside = f[(f <= reference).all(1)]
    area, top = 0.0, reference[1]
    for x, y in inside[np.lexsort(inside.T[::-1])]:
        if y < top:
            area += (reference[0] - x) * (top - y)
            top = y
    return area


def population_diversity(population: Sequence[np.ndarray], random: np.random.Generator, pairs: int = 100) -> float:
    """Mean number of units in which random pairs differ."""
    if len(population) < 2:
        return 0.0
    picks = [random.choice(len(population), 2, replace=False) for _ in range(pairs)]
    return float(np.mean([len(np.setxor1d(population[a], population[b])) for a, b in picks]))


# -- first selections --------------------------------------------------------


def weighted_start(random: np.random.Generator, weights: np.ndarray, k: int) -> np.ndarray:
    """``k`` units drawn without replacement by weight; units of no weight only where others run out."""
    return np.sort(np.argsort(-(np.log(np.maximum(weights, 1e-300)) + random.gumbel(size=len(weights))), kind="stable")[:k])


def shares_of(count: int, parts: Sequence[tuple[str, float]]) -> list[str]:
    """The kind of each of ``count`` starts: whole shares of each kind, rounded down, and the rest of the last."""
    total = sum(share for _, share in parts)
    if not parts or total <= 0 or min(share for _, share in parts) < 0:
        raise ValueError("shares of starts must be positive")
    kinds = [kind for kind, share in parts[:-1] for _ in range(int(count * share / total + 1e-9))]
    return kinds + [parts[-1][0]] * (count - len(kinds))


# -- checkpoints -------------------------------------------------------------


def _state_path(path: str, generation: int) -> str:
    return f"{path.rstrip('/')}/generation-{generation:06d}"


def _save(spark, path: str, generation: int, state: dict) -> None:
    """Writes the state after ``generation`` and deletes the one before; the engine's committer marks it when it is whole."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(_state_path(path, generation))
    if generation:
        delete(spark, _state_path(path, generation - 1))


def _saved(spark, path: str, generations: int) -> tuple[int, dict] | None:
    """The last whole state, if any, and its generation."""
    for generation in range(generations - 1, -1, -1):
        if exists(spark, _state_path(path, generation) + "/_SUCCESS"):
            return generation, json.loads(spark.read.text(_state_path(path, generation)).first()["value"])
    return None


# -- the search -------------------------------------------------------------


@dataclass
class Search:
    """What a search found: ``ids`` of each front member, objectives, violations and a log of generations."""

    ids: list[np.ndarray]
    objectives: np.ndarray
    violations: np.ndarray
    names: list[str]
    log: pd.DataFrame
    evaluations: int

    def frame(self, spark) -> DataFrame:
        rows = [(c, [int(i) for i in ids], [float(v) for v in f], float(cv)) for c, (ids, f, cv) in enumerate(zip(self.ids, self.objectives, self.violations))]
        wide = spark.createDataFrame(rows, "candidate long, units array<long>, f array<double>, violation double")
        return wide.select("candidate", "units", *(F.col("f")[i].alias(n) for i, n in enumerate(self.names)), "violation")


def search(
    units: DataFrame, k: int, objectives: Callable[[DataFrame], DataFrame], names: Sequence[str], limits: dict[str, float] | None = None, quotas: DataFrame | None = None, population: int = 40, generations: int = 20,
    crossover_chance: float = 0.9, mutation_chance: float = 0.2, swaps: int = 1, alpha: float = 1.0, seed: int = 0, patience: int = 0, start: Sequence[np.ndarray] = (), on_generation: Callable[[int, list[np.ndarray], np.ndarray], None] | None = None,
    starts: Sequence[tuple[str, float]] = (("uniform", 1.0),), start_weight: str = "weight", harm: Callable[[np.ndarray], float] | None = None, checkpoint: str | None = None,
) -> Search:
    """Searches selections of ``k`` units for small ``names``.

    ``objectives`` turns ``candidate, unit_id`` rows into ``candidate`` and
    ``names``, for all new selections of a generation at once; known ones come
    from a cache. ``limits`` bounds divergences by ``count`` or ``weight``; with ``quotas`` every
    selection meets them exactly. The result is the feasible first front, or the 50 least violating selections.

    ``starts`` mixes kinds of first selections by share: ``uniform``, ``weighted`` (by the column ``start_weight``) and ``greedy``
    (towards the limits). With ``harm``, a cheap figure for an array of unit ids, sizes and quotas are
    repaired by the moves that raise it least, at random otherwise. With ``checkpoint``, a folder in the shared store, the state of
    each generation is kept there, and a search of the same arguments goes on from the last whole one, to the same result.
    """
    spark = units.sparkSession
    unknown = {kind for kind, _ in starts} - {"uniform", "weighted", "greedy"}
    if unknown:
        raise ValueError(f"unknown starts: {sorted(unknown)}")
    positive = lambda c: F.greatest(F.coalesce(finite(F.col(c)), F.lit(0.0)), F.lit(0.0))
    by_weight = any(kind == "weighted" for kind, _ in starts)
    own = units.select(
        "unit_id", F.coalesce(F.col("grp").cast("string"), F.lit("null")).alias("grp"), *([positive("weight").alias("weight")] if "weight" in units.columns else []), *([positive(start_weight).alias("start")] if by_weight else [])
    )
    table = own.orderBy("unit_id").limit(MOST_UNITS + 1).toPandas()
    if len(table) > MOST_UNITS:
        raise ValueError(f"over {MOST_UNITS} units; search among a sample of them")
    ids = table["unit_id"].to_numpy()
    names_of, groups = np.unique(table["grp"].to_numpy(), return_inverse=True)
    members = [np.flatnonzero(groups == g) for g in range(len(names_of))]
    n, random = len(ids), np.random.default_rng(seed)
    counts = np.array([len(m) for m in members])
    constraints = []
    for kind, limit in sorted((limits or {}).items()):
        w = table["weight"].to_numpy() if kind == "weight" else None
        target = counts / n if w is None else np.bincount(groups, w, len(counts)) / w.sum()
        constraints.append(Proportionality(target, w, alpha, limit))
    want = None
    if quotas is not None:
        given = {("null" if r["grp"] is None else str(r["grp"])): r["c"] for r in quotas.select("grp", "c").collect()}
        want = np.array([given.get(g, 0) for g in names_of])

    repairs: list[int] = []

    def repaired(s: np.ndarray) -> np.ndarray:
        given = s
        if harm is None:
            s = repair_quotas(random, s, groups, members, want) if want is not None else repair_size(random, s, n, k)
        else:
            cost = lambda x: harm(ids[x])
            s = least_harm_quotas(s, groups, members, want, cost, random) if want is not None else least_harm_size(s, n, k, cost, random)
        s = repair_constraints(s, groups, members, constraints, random, want is not None) if constraints else s
        repairs.append(len(np.setxor1d(given, s)))
        return s

    cache: dict[bytes, np.ndarray] = {}

    def evaluated(pop: list[np.ndarray]) -> np.ndarray:
        new = {s.tobytes(): s for s in pop if s.tobytes() not in cache}
        if new:
            listed = list(new.items())
            rows = pd.DataFrame({"candidate": np.repeat(np.arange(len(listed)), [len(s) for _, s in listed]), "unit_id": ids[np.concatenate([s for _, s in listed])]})
            got = objectives(spark.createDataFrame(rows)).select("candidate", *names).toPandas().set_index("candidate")
            for i, (key, _) in enumerate(listed):
                values = got.loc[i].to_numpy(float) if i in got.index else np.full(len(names), 1e18)
                cache[key] = np.where(np.isfinite(values), values, 1e18)
        return np.array([cache[s.tobytes()] for s in pop])

    violations = lambda pop: np.array([sum(c.violation(s, groups) for c in constraints) for s in pop])
    place = {u: i for i, u in enumerate(ids.tolist())}
    log, best, idle, first = [], np.inf, 0, 0
    saved = _saved(spark, checkpoint, generations) if checkpoint else None
    if saved:
        first, state = saved[0] + 1, saved[1]
        if (state["k"], state["seed"], state["names"], state["units"]) != (k, seed, list(names), n):
            raise ValueError(f"{checkpoint} holds another search")
        pop, f, cv, ranks, crowd = [np.array(s, np.int64) for s in state["population"]], np.array(state["objectives"]), np.array(state["violations"]), np.array(state["ranks"]), np.array(state["crowding"])
        log, best, idle = state["log"], state["best"], state["idle"]
        random.bit_generator.state = state["random"]
        cache |= {s.tobytes(): v for s, v in zip(pop, f)}
    else:
        pop = [repaired(np.sort([place[u] for u in s])) for s in start]
        if constraints and want is None:
            pop.append(greedy_start(groups, members, constraints, k, random))
        for kind in shares_of(max(0, population - len(pop)), starts):
            if kind == "greedy" and constraints:
                s = greedy_start(groups, members, constraints, k, random)
            else:
                s = weighted_start(random, table["start"].to_numpy(), k) if kind == "weighted" else np.sort(random.choice(n, k, replace=False))
            pop.append(repaired(s))
        f, cv = evaluated(pop), violations(pop)
        kept, ranks, crowd = survivors(f, cv, population)
        pop, f, cv = [pop[i] for i in kept], f[kept], cv[kept]
    for generation in range(first, generations):
        if patience and idle >= patience:
            break
        parents = tournament(random, ranks, crowd, population + population % 2)
        children, _ = [], repairs.clear()
        for a, b in parents.reshape(-1, 2):
            for child in crossover(random, pop[a], pop[b], crossover_chance):
                child = repaired(child)
                if random.random() < mutation_chance:
                    child = swap_within_groups(random, child, groups, members, swaps) if want is not None else repaired(flip(random, child, n, 1 / n))
                children.append(np.sort(child))
        both = [*pop, *children]
        f_both, cv_both = np.vstack([f, evaluated(children)]), np.r_[cv, violations(children)]
        kept, ranks, crowd = survivors(f_both, cv_both, population)
        pop, f, cv = [both[i] for i in kept], f_both[kept], cv_both[kept]
        level = float(f.min(axis=0).sum())
        log.append({"generation": generation, **{f"best_{m}": float(v) for m, v in zip(names, f.min(axis=0))}, "feasible": float((cv <= 0).mean()), "front": int((ranks == 0).sum()), "diversity": population_diversity(pop, random), "repaired": float(np.mean([r > 0 for r in repairs])), "repair_size": float(np.mean(repairs))})
        if on_generation:
            on_generation(generation, [ids[s] for s in pop], f)
        idle = idle + 1 if level >= best * (1 - 1e-6) else 0
        best = min(best, level)
        if checkpoint:
            _save(spark, checkpoint, generation, {
                "k": k, "seed": seed, "names": list(names), "units": n, "population": [s.tolist() for s in pop], "objectives": f.tolist(), "violations": cv.tolist(), "ranks": ranks.tolist(),
                "crowding": crowd.tolist(), "log": log, "best": best, "idle": idle, "random": random.bit_generator.state,
            })
    good = np.flatnonzero(cv <= 0)
    final = good[fronts(f[good])[0]] if len(good) else np.argsort(cv, kind="stable")[:50]
    unique = list({pop[i].tobytes(): i for i in final}.values())
    return Search([ids[pop[i]] for i in unique], f[unique], cv[unique], list(names), pd.DataFrame(log), len(cache))


def greedy_floors(units: DataFrame, k: int, kinds: Sequence[str] = ("count", "weight"), alpha: float = 1.0, seed: int = 0) -> dict[str, float]:
    """The divergence of each kind that units added greedily for that kind alone come down to."""
    out = {}
    for kind in kinds:
        table = units.select("unit_id", F.coalesce(F.col("grp").cast("string"), F.lit("null")).alias("grp"), (F.greatest(F.coalesce(finite(F.col("weight")), F.lit(0.0)), F.lit(0.0)) if kind == "weight" else F.lit(1.0)).alias("w")).orderBy("unit_id").limit(MOST_UNITS + 1).toPandas()
        if len(table) > MOST_UNITS:
            raise ValueError(f"over {MOST_UNITS} units")
        _, groups = np.unique(table["grp"].to_numpy(), return_inverse=True)
        members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
        w = table["w"].to_numpy() if kind == "weight" else None
        target = np.bincount(groups, w) / (len(groups) if w is None else w.sum())
        limit = Proportionality(target, w, alpha, 0.0)
        out[kind] = limit.divergence(greedy_start(groups, members, [limit], k, np.random.default_rng(seed)), groups)
    return out


def search_with_growing_limits(units: DataFrame, k: int, objectives: Callable[[DataFrame], DataFrame], names: Sequence[str], kinds: Sequence[str] = ("count",), growth: float = 1.5, rounds: int = 6, wanted: float = 0.5, seed: int = 0, **options) -> tuple[Search, dict[str, float]]:
    """Searches with limits at the greedy floors, and wider ones until ``wanted`` of the result is feasible.

    Each round starts from the selections of the one before.
    """
    limits = {kind: max(floor, 1e-6) for kind, floor in greedy_floors(units, k, kinds, seed=seed).items()}
    found: Search | None = None
    for r in range(rounds):
        found = search(units, k, objectives, names, limits, seed=seed + r, start=found.ids if found else (), **options)
        if (found.violations <= 0).mean() >= wanted:
            break
        limits = {kind: limit * growth for kind, limit in limits.items()}
    return found, limits
