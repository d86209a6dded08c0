"""The objectives of a space, built once and computed for any number of candidates together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import median_squared_distance
from .kernels import Anchors, RandomFeatures, column_sums, map_vectors, negative_log_determinant, per_candidate
from .quotas import group_diagnostics

NAMES = ("mmd2", "sinkhorn", "skl", "logdet")


@dataclass
class Objectives:
    """Feature map and mean embedding, anchors, and the moments of all units."""

    units: DataFrame
    sigma_sq: float
    features: RandomFeatures
    embedding: np.ndarray
    anchors: Anchors
    mean: np.ndarray
    variance: np.ndarray

    @classmethod
    def build(cls, units: DataFrame, features: int = 256, anchors: int = 64, scale: float = 1.0, seed: int = 0, sample: int = 2048) -> Objectives:
        """Bandwidth: half the median squared distance of the pairs of ``sample`` units, times ``scale``. One scan for the embedding, one for the moments, those of the anchors."""
        rows = units.select("unit_id", "vec")
        sigma_sq = median_squared_distance(rows, sample, seed) / 2 * scale
        dimension = rows.select(F.size("vec").alias("d")).limit(1).first()["d"]
        mapped = RandomFeatures.build(dimension, features, sigma_sq, seed)
        sums, n = column_sums(map_vectors(rows.select("vec"), lambda x: np.hstack([x, x * x])))
        mean = sums[:dimension] / n
        return cls(rows, sigma_sq, mapped, mapped.mean(rows), Anchors.build(rows, anchors, seed=seed), mean, np.maximum(sums[dimension:] / n - mean**2, 1e-9))

    def of_vectors(self, x: np.ndarray) -> dict[str, float]:
        """All objectives of one set of vectors."""
        mean, variance = x.mean(axis=0), np.maximum(x.var(axis=0), 1e-9)
        gap = (mean - self.mean) ** 2
        skl = 0.5 * (variance / self.variance + self.variance / variance - 2 + gap * (1 / variance + 1 / self.variance)).sum()
        return {
            "mmd2": float(((self.features(x).mean(axis=0) - self.embedding) ** 2).sum()), "sinkhorn": self.anchors.divergence(x), "skl": float(skl), "logdet": negative_log_determinant(x, self.sigma_sq),
        }

    def table(self, candidates: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
        """``candidate`` and ``names`` for rows ``candidate, unit_id``; what isn't finite becomes 1e18."""
        if unknown := set(names) - set(NAMES):
            raise ValueError(f"no objective {sorted(unknown)}")
        small = Objectives(None, self.sigma_sq, self.features, self.embedding, self.anchors, self.mean, self.variance)  # without the table, which tasks can't hold
        return per_candidate(self.units, candidates, small.of_vectors, names)

    def with_shares(self, units: DataFrame, candidates: DataFrame, shares: DataFrame, names: Sequence[str] = ("mmd2", "sinkhorn")) -> DataFrame:
        """``table`` with ``kl``, the divergence of each candidate's group shares, as a further objective."""
        return self.table(candidates, names).join(group_diagnostics(units, candidates, shares).select("candidate", "kl"), "candidate")


def mmd2_between(units: DataFrame, first: DataFrame, second: DataFrame, features: RandomFeatures) -> float:
    """Squared distance of the mean embeddings of two selections; an empty one has the zero embedding."""
    means = []
    for chosen in (first, second):
        rows = units.join(chosen.select("unit_id").distinct(), "unit_id", "left_semi")
        sums, n = column_sums(features.transform(rows.select("vec")))
        means.append(sums / n if n else np.zeros(len(features.offsets)))
    return float(((means[0] - means[1]) ** 2).sum())


def cross_space(spaces: dict[str, DataFrame], candidates: DataFrame, names: Sequence[str] = ("mmd2", "sinkhorn"), seed: int = 0) -> DataFrame:
    """``candidate`` and ``<objective>_<space>`` for each space: rank correlations between them tell whether a space is a fair stand-in."""
    out = None
    for space, units in spaces.items():
        one = Objectives.build(units, seed=seed).table(candidates, names)
        one = one.select("candidate", *(F.col(n).alias(f"{n}_{space}") for n in names))
        out = one if out is None else out.join(one, "candidate")
    return out
