"""Linear models from Gram sums.

The rows are read once by a distributed sum of cross products (d² numbers for d
features, whatever the rows); fits, folds and penalties are small dense algebra on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Features beyond this make the sums too large for the driver.
MOST_FEATURES = 2000
PENALTIES = tuple(10.0**e for e in range(-6, 7))


@dataclass
class Gram:
    """Sums over rows of z zᵀ with z = (1, x, y)."""

    z: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.z + other.z)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.z - other.z)

    @property
    def n(self) -> float:
        return self.z[0, 0]

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Mean of x, centred xᵀx and xᵀy, mean of y."""
        mean = self.z[0, 1:-1] / self.n
        y = self.z[0, -1] / self.n
        return mean, self.z[1:-1, 1:-1] - self.n * np.outer(mean, mean), self.z[1:-1, -1] - self.n * mean * y, y


@dataclass
class LinearModel:
    weights: np.ndarray
    intercept: float

    def error(self, sums: Gram) -> float:
        """Mean squared error over the rows behind ``sums``."""
        v = np.concatenate([[-self.intercept], -self.weights, [1.0]])
        return float(v @ sums.z @ v) / max(sums.n, 1.0)


def gram_by(rows: DataFrame, features: Sequence[str], target: str, by: str | None = None) -> dict:
    """A ``Gram`` for each value of ``by`` (one under None without it); rows with a missing number are left out."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"over {MOST_FEATURES} features")
    ship(rows.sparkSession)
    wanted = rows.select(F.col(by).cast("long").alias("k") if by else F.lit(0).cast("long").alias("k"), F.array(*(F.col(c).cast("double") for c in [*features, target])).alias("v"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in batches:
            if frame.empty:
                continue
            z = np.column_stack([np.ones(len(frame)), np.array(frame["v"].tolist(), float)])
            good = np.isfinite(z).all(axis=1)
            for k in frame["k"][good].unique():
                part = z[good & (frame["k"] == k).to_numpy()]
                held[k] = held.get(k, 0) + part.T @ part
        yield pd.DataFrame({"k": list(held), "z": [h.ravel() for h in held.values()]})

    found: dict = {}
    for row in wanted.mapInPandas(sums, "k long, z array<double>").toLocalIterator():
        z = np.array(row["z"]).reshape(len(features) + 2, -1)
        key = row["k"] if by else None
        found[key] = found.get(key, Gram(np.zeros_like(z))) + Gram(z)
    return found


def gram(rows: DataFrame, features: Sequence[str], target: str) -> Gram:
    return gram_by(rows, features, target).get(None) or Gram(np.zeros((len(features) + 2,) * 2))


def expanding_folds(rows: DataFrame, features: Sequence[str], target: str, time: str, folds: int = 5) -> list[Gram]:
    """Sums of ``folds`` + 1 successive stretches of time with about equal row counts."""
    points = [i / (folds + 1) for i in range(1, folds + 1)]
    seconds = F.col(time).cast("timestamp").cast("double") if dict(rows.dtypes)[time] in ("timestamp", "timestamp_ntz", "date") else F.col(time).cast("double")
    cuts = rows.agg(F.percentile(seconds, points).alias("q")).first()["q"] or []
    fold = sum(((seconds > F.lit(q)).cast("int") for q in cuts), F.lit(0))
    found = gram_by(rows.withColumn("_fold", fold), features, target, "_fold")
    return [found[k] for k in sorted(found)]


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge(sums: Gram, penalty: float) -> LinearModel:
    mean, xx, xy, y = sums.centred()
    w = _solve(xx + penalty * np.eye(len(xx)), xy)
    return LinearModel(w, float(y - mean @ w))


def least_squares(sums: Gram) -> LinearModel:
    return ridge(sums, 0.0)


def _merge(parts: Sequence[Gram]) -> Gram:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def ridge_by_folds(parts: Sequence[Gram], penalties: Sequence[float] = PENALTIES, expanding: bool = True) -> LinearModel:
    """Ridge with the first penalty of least mean RMSE over folds (each after those before it, or each left out), fitted on all."""
    whole = _merge(parts)
    if len(parts) < 2:
        return ridge(whole, penalties[len(penalties) // 2])
    tests = range(1, len(parts)) if expanding else range(len(parts))
    errors = [np.mean([ridge(_merge(parts[:i]) if expanding else whole - parts[i], p).error(parts[i]) ** 0.5 for i in tests]) for p in penalties]
    return ridge(whole, penalties[int(np.argmin(errors))])


def elastic_net(sums: Gram, alpha: float = 0.01, l1_ratio: float = 0.5, steps: int = 1000, tolerance: float = 1e-8) -> LinearModel:
    """Coordinate descent on mean squared error / 2 + alpha * (l1 + l2 / 2)."""
    mean, xx, xy, y = sums.centred()
    xx, xy = xx / sums.n, xy / sums.n
    w = np.zeros(len(xy))
    for _ in range(steps):
        before = w.copy()
        for j in range(len(w)):
            rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            scale = xx[j, j] + alpha * (1 - l1_ratio)
            w[j] = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0.0) / scale if scale > 0 else 0.0
        if np.abs(w - before).max(initial=0) < tolerance:
            break
    return LinearModel(w, float(y - mean @ w))


def _pls(sums: Gram, components: int) -> LinearModel:
    """PLS of one target from centred and scaled sums: conjugate directions of xᵀx in the Krylov space of xᵀy."""
    mean, xx, xy, y = sums.centred()
    deviation = np.sqrt(np.maximum(np.diag(xx) / max(sums.n - 1, 1), 1e-300))
    xx, xy = xx / np.outer(deviation, deviation), xy / deviation
    w, rest = np.zeros(len(xy)), xy.copy()
    direction = rest.copy()
    for _ in range(components):
        curve = direction @ xx @ direction
        size = rest @ rest
        if curve < 1e-12 or size < 1e-24:
            break
        w = w + size / curve * direction
        rest = rest - size / curve * (xx @ direction)
        direction = rest + (rest @ rest) / size * direction
    w = w / deviation
    return LinearModel(w, float(y - mean @ w))


def partial_least_squares(parts: Sequence[Gram], most: int = 10) -> LinearModel:
    """PLS with the number of components of least error over expanding folds."""
    whole = _merge(parts)
    sizes = range(1, min(most, len(whole.z) - 2) + 1)
    if len(parts) < 2:
        return _pls(whole, max(sizes))
    errors = [np.mean([_pls(_merge(parts[:i]), c).error(parts[i]) for i in range(1, len(parts))]) for c in sizes]
    return _pls(whole, sizes[int(np.argmin(errors))])


def _onto_simplex(w: np.ndarray, least: float, most: float) -> np.ndarray:
    """The nearest point with entries in [least, most] that sum to 1."""
    low, high = w.min() - most - 1.0, w.max() - least + 1.0
    for _ in range(100):
        middle = (low + high) / 2
        if np.clip(w - middle, least, most).sum() > 1:
            low = middle
        else:
            high = middle
    return np.clip(w - (low + high) / 2, least, most)


def constrained_least_squares(sums: Gram, least: float = 0.05, most: float = 0.50, spread: float = 0.01, steps: int = 5000) -> LinearModel:
    """Least mean squared error less ``spread`` times the weights' variance; weights in [least, most] that sum to 1, no intercept.

    Bounds that no weights can meet are widened. Solved by projected gradient.
    """
    xx, xy = sums.z[1:-1, 1:-1] / sums.n, sums.z[1:-1, -1] / sums.n
    d = len(xy)
    least = max(1e-6, 0.5 / d) if d * least > 1 + 1e-9 else least
    most = min(1.0, 2.0 / d) if d * most < 1 - 1e-9 else most
    w = _onto_simplex(np.full(d, 1.0 / d), least, most)
    step = 0.5 / max(np.linalg.eigvalsh(xx)[-1], 1e-12)
    for _ in range(steps):
        after = _onto_simplex(w - step * (2 * (xx @ w - xy) - 2 * spread / d * (w - w.mean())), least, most)
        if np.abs(after - w).max() < 1e-12:
            break
        w = after
    return LinearModel(w, 0.0)


def predict(rows: DataFrame, model: LinearModel, features: Sequence[str], out: str = "y_pred") -> DataFrame:
    """Adds the model's value as one expression."""
    value = F.lit(float(model.intercept))
    for c, w in zip(features, model.weights):
        value = value + F.col(c).cast("double") * F.lit(float(w))
    return rows.withColumn(out, value)
