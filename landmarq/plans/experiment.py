"""Experiments: selections by many methods, spaces and sizes, evaluated by the same figures, as one long table.

A run is a set of ``Settings``; ``run_specs`` lists named ones with what they wait for.
"""

from __future__ import annotations

import argparse
import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison, evolution, geometry, groups, kernels, metrics, objectives, prepare, quotas, selectors
from ..operators.embedding import embed_space
from ..sources.sinks import is_complete


@dataclass(frozen=True)
class Settings:
    """One experiment: subset size, methods, spaces, regimes (``exact``, ``quota``, ``global_then_quota``) and replicates.

    ``hard`` names what quotas go by (``count`` or ``weight``; they hold exactly), ``limits`` the divergences that are bounded. ``grid`` are sizes, ``dimensions``
    widths of the space and ``efforts`` pairs of population and generations that ``sweep_settings`` goes through.
    """

    name: str = "default"
    k: int = 100
    methods: tuple[str, ...] = tuple(selectors.METHODS)
    spaces: tuple[str, ...] = ("raw",)
    regimes: tuple[str, ...] = ("exact",)
    replicates: int = 1
    seed: int = 0
    evaluation_rows: int = 1000
    features: int = 128
    search: bool = False
    generations: int = 5
    population: int = 16
    limits: Mapping[str, float] = field(default_factory=dict)
    after: tuple[str, ...] = ()
    objectives: tuple[str, ...] = ("mmd2", "sinkhorn")
    hard: str = ""
    grid: tuple[int, ...] = ()
    dimension: int = 8
    dimensions: tuple[int, ...] = ()
    efforts: tuple[tuple[int, int], ...] = ()

    def key(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:12]


#: Sizes and widths of the sweeps, and the divergence that a soft and a tight limit allow.
SIZES, WIDTHS = (30, 50, 100, 200, 300, 400, 500), (4, 8, 16, 32, 64, 128)
SOFT, TIGHT = 0.02, 0.001
#: What a run's constraint code stands for: p or first place the weight, m or second place the count; s soft, h hard, 0 none.
CONSTRAINTS: dict[str, dict] = {
    "0": {}, "ps": {"limits": {"weight": SOFT}}, "ms": {"limits": {"count": SOFT}}, "ph": {"hard": "weight"}, "mh": {"hard": "count"},
    "sh": {"hard": "count", "limits": {"weight": SOFT}}, "hs": {"hard": "weight", "limits": {"count": SOFT}}, "hh": {"hard": "count", "limits": {"weight": TIGHT}},
}
SPACES = {"r": "raw", "v": "vae", "p": "pca"}
#: The numbered runs of the constraint grid, in order: blocks of searches (N) or selectors (B) in one space under some constraints.
NUMBERED = (
    ("N", "r", "ph mh hh 0"), ("B", "r", "ph mh hh 0"), ("N", "v", "ph mh hh 0"), ("B", "v", "ph mh hh 0"), ("N", "r", "ps ms"), ("N", "v", "ps ms"), ("N", "p", "ps ms"), ("N", "p", "ph mh hh 0"), ("B", "p", "ph mh hh 0"),
    ("B", "r", "ps ms"), ("B", "v", "ps ms"), ("B", "p", "ps ms"), ("N", "r", "sh hs"), ("B", "r", "sh hs"), ("N", "v", "sh hs"), ("B", "v", "sh hs"), ("N", "p", "sh hs"), ("B", "p", "sh hs"),
)


def run_specs() -> dict[str, Settings]:
    """Named experiments: the numbered ones (R), the grid of kind, space and constraint (``N_r_ph`` and so on), its numbers (G), sweeps and diagnostics."""
    base = Settings(search=True, methods=(), spaces=("vae",), limits={"weight": SOFT}, after=("R0",))
    selectors_only = {"search": False, "methods": Settings.methods, "regimes": ("exact",)}
    specs = {
        "R0": Settings(methods=(), grid=SIZES), "R1": replace(base, grid=SIZES, replicates=5), "R2": replace(base, objectives=("mmd2",)), "R3": replace(base, objectives=("sinkhorn",)),
        "R4": replace(base, limits={}, hard="count"), "R5": replace(base, **CONSTRAINTS["hh"]), "R6": replace(base, limits={}), "R7": replace(base, objectives=("mmd2", "sinkhorn", "skl")),
        "R8": replace(base, spaces=("raw",), grid=SIZES), "R9": replace(base, spaces=("pca",), grid=SIZES), "R10": replace(base, **selectors_only, replicates=5), "R11": replace(base, search=False, after=("R1",)),
        "R12": replace(base, efforts=((8, 5), (16, 5), (16, 20), (40, 20))), "R13": replace(base, dimensions=WIDTHS), "R14": replace(base, spaces=("pca",), dimensions=WIDTHS), "R15": replace(base, objectives=("mmd2", "sinkhorn", "logdet")),
    }
    for kind in "NB":
        for letter, space in SPACES.items():
            for code, constraint in CONSTRAINTS.items():
                one = replace(base, spaces=(space,), replicates=5, **{"limits": {}, **constraint})
                specs[f"{kind}_{letter}_{code}"] = replace(one, **selectors_only) if kind == "B" else one
    cells = [f"{kind}_{letter}_{code}" for kind, letter, codes in NUMBERED for code in codes.split()]
    specs |= {f"G{i}": specs[cell] for i, cell in enumerate(cells, 1)}
    specs |= {"K_vae": specs["R1"], "K_raw": specs["R8"], "K_pca": specs["R9"], "T_eff": specs["R12"], "T_vdim": specs["R13"], "T_pdim": specs["R14"]}
    specs |= {f"D_{space}": replace(specs["R11"], spaces=(space,)) for space in SPACES.values()}
    return {name: replace(spec, name=name) for name, spec in specs.items()}


def sweep_settings(settings: Settings) -> list[Settings]:
    """The single experiments of a sweep: one for each size, width and effort that is named."""
    out = []
    for k in settings.grid or (settings.k,):
        for d in settings.dimensions or (settings.dimension,):
            for population, generations in settings.efforts or ((settings.population, settings.generations),):
                name = settings.name + f"_k{k}" * bool(settings.grid) + f"_d{d}" * bool(settings.dimensions) + f"_p{population}g{generations}" * bool(settings.efforts)
                out.append(replace(settings, name=name, k=k, dimension=d, population=population, generations=generations, grid=(), dimensions=(), efforts=()))
    return out


def in_order(specs: Mapping[str, Settings]) -> list[list[str]]:
    """Names in waves: each waits only for earlier ones; ValueError for a ring or an unknown name."""
    left, waves = {n: set(s.after) for n, s in specs.items()}, []
    if unknown := {a for s in left.values() for a in s} - set(left):
        raise ValueError(f"no {sorted(unknown)}")
    while left:
        free = sorted(n for n, waits in left.items() if not waits)
        if not free:
            raise ValueError(f"{sorted(left)} wait for each other")
        waves.append(free)
        left = {n: waits - set(free) for n, waits in left.items() if n not in free}
    return waves


def quota_report(units: DataFrame, grid: Sequence[int], alpha: float = 1.0) -> DataFrame:
    """The quota path over ``grid`` with what each k can reach."""
    path = quotas.quota_path(groups.group_shares(units, weight=None), grid, alpha)
    return path.join(quotas.path_report(path, alpha), "k")


def evaluate_selection(units: DataFrame, chosen: DataFrame, target: str | None, sigma_sq: float, evaluation_rows: int = 1000, seed: int = 0) -> dict[str, float]:
    """Figures of one selection: coverage, shares, kernel errors, and prediction of ``target`` by kernel ridge, overall and by group."""
    shares = groups.group_shares(units, weight=None)
    out = {**geometry.coverage(units, chosen).first().asDict(), **geometry.representation_error(units.select("unit_id", "vec"), chosen).first().asDict()}
    out |= {f"geo_{k}": v for k, v in quotas.group_diagnostics(units, chosen, shares).first().asDict().items()}
    rest = units.join(F.broadcast(chosen.select("unit_id")), "unit_id", "left_anti")
    sample = quotas.uniform_sample(rest, evaluation_rows, seed=f"{seed}|evaluation")
    _, points = kernels.matrix(geometry.chosen_vectors(units, chosen))
    model = kernels.Nystrom.fit(points, sigma_sq)
    out |= {"nystrom_error": kernels.nystrom_error(sample, model), "kpca_distortion": kernels.kernel_pca_distortion(sample, model)}
    if target:
        marked = prepare.stratified_split(sample, 0.2, seed=f"{seed}|split")
        scored = kernels.kernel_ridge(marked.where(~F.col("is_test")), marked.where("is_test"), model, target).withColumn("y_true", F.col(target)).cache()
        out |= {f"krr_{k}": v for k, v in metrics.regression_metrics(scored).first().asDict().items() if k != "n"}
        out |= {f"krr_{k}": v for k, v in metrics.tail_errors(scored).first().asDict().items()}
        out |= {f"krr_{k}": v for k, v in metrics.group_summary(scored).first().asDict().items() if k != "groups"}
        out |= {f"drift_{k}": v for k, v in metrics.drift_summary(units, chosen, target).first().asDict().items()}
        scored.unpersist()
    return {k: float(v) for k, v in out.items() if v is not None}


def hard_quotas(units: DataFrame, k: int, hard: str) -> DataFrame | None:
    """Quotas by ``count`` or ``weight``; None for neither."""
    if not hard:
        return None
    return quotas.quota_counts(groups.group_shares(units, weight="weight" if hard == "weight" else None), k, pi="pi_weight" if hard == "weight" else "pi")


def select_by(units: DataFrame, method: str, regime: str, k: int, seed: int, sigma_sq: float, hard: str = "count") -> DataFrame:
    if regime == "exact":
        return selectors.select(units, method, k, seed=seed, sigma_sq=sigma_sq)
    wanted = hard_quotas(units, k, hard)
    if regime == "quota":
        return selectors.select(units, method, quotas=wanted, seed=seed, sigma_sq=sigma_sq)
    return selectors.global_then_quota(units, method, wanted, k, seed=seed, sigma_sq=sigma_sq)


def search_selection(units: DataFrame, settings: Settings, sigma_sq: float, seed: int) -> DataFrame:
    """The knee of a search's front, or the best selection for a single objective."""
    names = list(settings.objectives)
    built = objectives.Objectives.build(units, settings.features, 32, seed=seed)
    found = evolution.search(
        units, settings.k, lambda c: built.table(c, names), names, dict(settings.limits), hard_quotas(units, settings.k, settings.hard), settings.population, settings.generations, seed=seed
    )
    front = found.frame(units.sparkSession)
    if len(found.ids) <= 1 or len(names) == 1:
        return front.orderBy("violation", *names, "candidate").limit(1).select(F.explode("units").alias("unit_id"))
    return comparison.knee(front, names).select(F.explode("units").alias("unit_id"))


def constrained_selection(units: DataFrame, settings: Settings, method: str, regime: str, seed: int, sigma_sq: float) -> DataFrame:
    """A selector's units under the settings' constraints: by hard quotas, then moved towards the limits."""
    if not settings.hard and not settings.limits:
        return select_by(units, method, regime, settings.k, seed, sigma_sq)
    chosen = select_by(units, method, "quota" if settings.hard else regime, settings.k, seed, sigma_sq, settings.hard)
    if not settings.limits:
        return chosen
    from .reports import repair_baseline

    found = repair_baseline(units, chosen, settings.k, settings.limits, seed, keep_counts=bool(settings.hard))
    return units.sparkSession.createDataFrame([(i,) for i in found], f"unit_id {dict(units.dtypes)['unit_id']}")


def run_experiment(units: DataFrame, settings: Settings, target: str | None = None) -> DataFrame:
    """``run, rep, space, regime, method, metric, value`` of every selection; figures are always taken in the raw space.

    ``units``: ``unit_id, grp, vec`` and the target.
    """
    sigma_sq = geometry.median_squared_distance(units, 500, seed=settings.seed) / 2
    rows = []
    for rep in range(settings.replicates):
        seed = settings.seed + rep
        for space in settings.spaces:
            within = embed_space(units, space, settings.dimension, seed=seed)
            width = sigma_sq if space == "raw" else geometry.median_squared_distance(within, 500, seed=seed) / 2
            jobs = [(regime, method) for regime in settings.regimes for method in settings.methods] + [("limits", "search")] * settings.search
            for regime, method in jobs:
                chosen = search_selection(within, settings, width, seed) if method == "search" else constrained_selection(within, settings, method, regime, seed, width)
                chosen = units.sparkSession.createDataFrame([(r["unit_id"],) for r in chosen.select("unit_id").collect()], "unit_id long")  # k ids
                figures = evaluate_selection(units, chosen, target, sigma_sq, settings.evaluation_rows, seed)
                rows += [(settings.name, rep, space, regime, method, m, v) for m, v in sorted(figures.items())]
    return units.sparkSession.createDataFrame(rows, "run string, rep int, space string, regime string, method string, metric string, value double")


def sweep(units: DataFrame, settings: Settings, grid: Sequence[int], target: str | None = None) -> DataFrame:
    """``run_experiment`` for every k of ``grid``, with ``k`` beside."""
    out = None
    for k in grid:
        one = run_experiment(units, replace(settings, k=k, name=f"{settings.name}_k{k}"), target).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def championship_of(results: DataFrame) -> DataFrame:
    return comparison.championship(results, ["space", "regime", "metric", "rep"])


def bootstrap_evaluation(units: DataFrame, chosen: Mapping[str, DataFrame], pool: Sequence[str], draws: int = 10, size: int = 3, seed: int = 0) -> DataFrame:
    """``draw, method, target, rmse, r2``: each method's selection predicts random sets of targets by kernel ridge.

    Draws are sets of names without repeats, so the same sets serve every method.
    """
    random = np.random.default_rng(seed)
    sets = [sorted(random.choice(len(pool), size, replace=False).tolist()) for _ in range(draws)]
    sigma_sq = geometry.median_squared_distance(units, 500, seed=seed) / 2
    rows = []
    for method, selection in chosen.items():
        _, points = kernels.matrix(geometry.chosen_vectors(units, selection))
        model = kernels.Nystrom.fit(points, sigma_sq)
        rest = units.join(F.broadcast(selection.select("unit_id")), "unit_id", "left_anti")
        marked = prepare.stratified_split(rest, 0.2, seed=f"{seed}|split")
        scores = {}
        for i in sorted({i for s in sets for i in s}):
            scored = kernels.kernel_ridge(marked.where(~F.col("is_test")), marked.where("is_test"), model, pool[i]).withColumn("y_true", F.col(pool[i]))
            scores[i] = metrics.regression_metrics(scored).first()
        rows += [(b, method, pool[i], float(scores[i]["rmse"]), float(scores[i]["r2"])) for b, s in enumerate(sets) for i in s]
    return units.sparkSession.createDataFrame(rows, "draw int, method string, target string, rmse double, r2 double")


def objective_alignment(front: DataFrame, objectives: Sequence[str], figures: Sequence[str]) -> DataFrame:
    """``objective, metric, n, rho``: rank correlation of objectives with figures over a front."""
    out = None
    for o in objectives:
        for m in figures:
            one = metrics.spearman(front.where(F.col(o).isNotNull() & F.col(m).isNotNull()), o, m).select(F.lit(o).alias("objective"), F.lit(m).alias("metric"), "n", "rho")
            out = one if out is None else out.union(one)
    return out


def proxy_stability(units: DataFrame, candidates: DataFrame, feature_counts: Sequence[int], reference: int = 1024, seed: int = 0) -> DataFrame:
    """``features, n, rho``: how far a coarser feature map ranks candidates as a fine one does."""
    sigma_sq = geometry.median_squared_distance(units, 500, seed=seed) / 2
    dimension = units.select(F.size("vec").alias("d")).limit(1).first()["d"]
    build = lambda m: kernels.mmd2(units, candidates, kernels.RandomFeatures.build(dimension, m, sigma_sq, seed))
    fine = build(reference).withColumnRenamed("mmd2", "_fine").cache()
    out = None
    for m in feature_counts:
        one = metrics.spearman(build(m).join(fine, "candidate"), "mmd2", "_fine").select(F.lit(m).alias("features"), "n", "rho")
        out = one if out is None else out.union(one)
    return out


def run_all(units: DataFrame, specs: Mapping[str, Settings], path: str, target: str | None = None) -> DataFrame:
    """Runs every experiment in order and keeps each one's rows under ``path``; those already there aren't run again."""
    spark = units.sparkSession
    for wave in in_order(specs):
        for name in wave:
            for one in sweep_settings(specs[name]):
                folder = f"{path}/spec={one.key()}"
                if not is_complete(spark, folder) and (one.methods or one.search):
                    run_experiment(units, one, target).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(path)


def main(arguments: Sequence[str] | None = None) -> None:
    """Command line: ``quota`` prints a quota path, ``run`` an experiment over a unit table in Parquet."""
    parser = argparse.ArgumentParser(prog="landmarq")
    parser.add_argument("command", choices=["quota", "run"])
    parser.add_argument("units", help="Parquet with unit_id, grp, vec and targets")
    parser.add_argument("--k", type=int, nargs="+", default=[100])
    parser.add_argument("--spec", default="R10")
    parser.add_argument("--target")
    parser.add_argument("--out")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    units = spark.read.parquet(given.units)
    if given.command == "quota":
        found = quota_report(units, given.k)
    else:
        found = sweep(units, run_specs()[given.spec], given.k, given.target)
    if given.out:
        found.write.mode("overwrite").parquet(given.out)
    else:
        found.show(1000, truncate=False)


if __name__ == "__main__":
    main()
