"""Representations: principal components, and a variational autoencoder for mixed columns.

Components come from one distributed sum of cross products. The autoencoder
trains in NumPy on the driver, on a bounded sample; embedding then runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import shuffle_key
from .kernels import column_sums, gram_matrix, map_vectors, matrix

#: Rows that train an autoencoder at most.
TRAIN_ROWS = 10_000


@dataclass
class Components:
    """Mean, directions (columns) and variances of principal components."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float
    whiten: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.directions
        return z / np.sqrt(np.maximum(self.variances, 1e-12)) if self.whiten else z

    @property
    def explained(self) -> np.ndarray:
        return self.variances / max(self.total, 1e-300)

    def embed(self, units: DataFrame, out: str = "pca") -> DataFrame:
        return map_vectors(units, self, out)


def _components(n: float, total: np.ndarray, cross: np.ndarray, count: int, whiten: bool) -> Components:
    mean = total / n
    covariance = (cross - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(covariance)
    top = np.argsort(values)[::-1][:count]
    directions = vectors[:, top]
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(top))] < 0, -1, 1)
    return Components(mean, directions, np.maximum(values[top], 0.0), float(values.clip(0).sum()), whiten)


def fit_components(units: DataFrame, count: int, whiten: bool = False) -> Components:
    """``count`` principal components of ``vec``; each direction's largest entry is positive."""
    rows = units.select("vec")
    total, n = column_sums(rows, "vec")
    return _components(n, total, gram_matrix(rows, "vec"), count, whiten)


class IncrementalComponents:
    """Principal components of batches that come one after another: sums are kept, not rows."""

    def __init__(self, count: int, whiten: bool = False):
        self.count, self.whiten = count, whiten
        self.n, self.total, self.cross = 0, 0.0, 0.0

    def add(self, batch: DataFrame) -> IncrementalComponents:
        total, n = column_sums(batch.select("vec"), "vec")
        self.n, self.total, self.cross = self.n + n, self.total + total, self.cross + gram_matrix(batch.select("vec"), "vec")
        return self

    def fit(self) -> Components:
        return _components(self.n, self.total, self.cross, self.count, self.whiten)


def explained_variance(model: Components) -> np.ndarray:
    """Running share of variance."""
    return np.cumsum(model.explained)


def components_for_variance(units: DataFrame, share: float) -> int:
    """The least number of components that explain ``share`` of the variance."""
    dimension = units.select(F.size("vec").alias("d")).limit(1).first()["d"]
    return int(min(np.searchsorted(explained_variance(fit_components(units, dimension)), share - 1e-12) + 1, dimension))


@dataclass(frozen=True)
class MixedColumns:
    """Places of a vector's entries by kind; ``categories`` maps a place to its number of codes (from 0)."""

    continuous: tuple[int, ...] = ()
    binary: tuple[int, ...] = ()
    categories: tuple[tuple[int, int], ...] = ()

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Continuous and binary entries as they are, codes as indicators."""
        parts = [x[:, list(self.continuous)], x[:, list(self.binary)]]
        parts += [np.eye(size)[np.clip(x[:, at].astype(int), 0, size - 1)] for at, size in self.categories]
        return np.hstack(parts)


class Autoencoder:
    """A variational autoencoder with hidden layers of given widths and Gaussian, Bernoulli and categorical outputs.

    ``hidden`` is one width or several: the encoder's layers in order, which the decoder mirrors; their
    ``activation`` is ``tanh`` or ``relu``. Trained by Adam on the sum of negative log-likelihoods and a divergence whose
    weight rises over the first epochs; stops when the held-out loss no longer falls.
    """

    def __init__(self, columns: MixedColumns, latent: int = 8, hidden: int | Sequence[int] = 64, seed: int = 0, activation: str = "tanh"):
        self.columns, self.latent, self.seed = columns, latent, seed
        self.hidden = (hidden,) if isinstance(hidden, int) else tuple(hidden)
        if not self.hidden or min(self.hidden) < 1 or activation not in ("tanh", "relu"):
            raise ValueError("hidden layers of positive width, tanh or relu")
        self.activation = activation
        self.weights: dict[str, np.ndarray] = {}
        self.history: list[tuple[float, float]] = []

    def _start(self, width: int) -> None:
        random = np.random.default_rng(self.seed)
        last = self.hidden[-1]
        sizes = {f"e{i}": pair for i, pair in enumerate(zip((width, *self.hidden), self.hidden))} | {"m": (last, self.latent), "v": (last, self.latent)}
        back = (self.latent, *self.hidden[::-1])
        sizes |= {f"d{i}": pair for i, pair in enumerate(zip(back, back[1:]))} | {"o": (back[-1], width)}
        for name, (a, b) in sizes.items():
            self.weights[f"w{name}"] = random.normal(0, np.sqrt(2 / (a + b)), (a, b))
            self.weights[f"b{name}"] = np.zeros(b)

    def _forward(self, x: np.ndarray, part: str) -> list[np.ndarray]:
        """The input and every layer's output of the encoder (``e``) or decoder (``d``)."""
        out = [x]
        for i in range(len(self.hidden)):
            z = out[-1] @ self.weights[f"w{part}{i}"] + self.weights[f"b{part}{i}"]
            out.append(np.tanh(z) if self.activation == "tanh" else np.maximum(z, 0.0))
        return out

    def _backward(self, layers: list[np.ndarray], slope: np.ndarray, part: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """From the slope at the last layer's output to that at the input, with the layers' gradients."""
        grads = {}
        for i in range(len(self.hidden) - 1, -1, -1):
            h = layers[i + 1]
            slope = slope * (1 - h**2 if self.activation == "tanh" else h > 0)
            grads |= {f"w{part}{i}": layers[i].T @ slope, f"b{part}{i}": slope.sum(0)}
            slope = slope @ self.weights[f"w{part}{i}"].T
        return slope, grads

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and log-variance of each row's code."""
        return self._encode_inputs(self.columns.inputs(x))[1:]

    def _encode_inputs(self, inputs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        w = self.weights
        layers = self._forward(inputs, "e")
        return layers, layers[-1] @ w["wm"] + w["bm"], np.clip(layers[-1] @ w["wv"] + w["bv"], -10, 2)

    def _loss(self, inputs: np.ndarray, noise: np.ndarray, beta: float) -> tuple[float, dict[str, np.ndarray]]:
        w, n = self.weights, len(inputs)
        layers, mean, logvar = self._encode_inputs(inputs)
        deviation = np.exp(logvar / 2)
        z = mean + deviation * noise
        back = self._forward(z, "d")
        g = back[-1]
        out = g @ w["wo"] + w["bo"]
        c, b = len(self.columns.continuous), len(self.columns.binary)
        loss, d_out = 0.5 * ((out[:, :c] - inputs[:, :c]) ** 2).sum(), np.zeros_like(out)
        d_out[:, :c] = out[:, :c] - inputs[:, :c]
        at = c
        chance = 1 / (1 + np.exp(-out[:, at : at + b]))
        truth = inputs[:, at : at + b]
        loss -= (truth * np.log(chance + 1e-12) + (1 - truth) * np.log(1 - chance + 1e-12)).sum()
        d_out[:, at : at + b] = chance - truth
        at += b
        for _, size in self.columns.categories:
            scores = out[:, at : at + size] - out[:, at : at + size].max(axis=1, keepdims=True)
            chance = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
            loss -= (inputs[:, at : at + size] * np.log(chance + 1e-12)).sum()
            d_out[:, at : at + size] = chance - inputs[:, at : at + size]
            at += size
        loss += beta * 0.5 * (np.exp(logvar) + mean**2 - 1 - logvar).sum()
        d_out /= n
        grads = {"wo": g.T @ d_out, "bo": d_out.sum(0)}
        d_z, more = self._backward(back, d_out @ w["wo"].T, "d")
        d_mean = d_z + beta * mean / n
        d_logvar = d_z * noise * deviation / 2 + beta * 0.5 * (np.exp(logvar) - 1) / n
        d_logvar = np.where((logvar <= -10) | (logvar >= 2), 0.0, d_logvar)
        h = layers[-1]
        grads |= more | {"wm": h.T @ d_mean, "bm": d_mean.sum(0), "wv": h.T @ d_logvar, "bv": d_logvar.sum(0)}
        return float(loss / n), grads | self._backward(layers, d_mean @ w["wm"].T + d_logvar @ w["wv"].T, "e")[1]

    def fit(self, units: DataFrame, epochs: int = 60, batch: int = 128, rate: float = 3e-3, warm_up: int = 20, patience: int = 10, beta: float = 1.0, sample: int = TRAIN_ROWS) -> Autoencoder:
        """Trains on a random sample of at most ``sample`` units, a tenth of it held out."""
        _, x = matrix(units.select("unit_id", "vec").orderBy(shuffle_key(self.seed, F.col("unit_id"))).limit(sample), most=sample)
        inputs = self.columns.inputs(x)
        random = np.random.default_rng(self.seed)
        order = random.permutation(len(inputs))
        held, train = inputs[order[: max(1, len(order) // 10)]], inputs[order[max(1, len(order) // 10) :]]
        self._start(inputs.shape[1])
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        best, kept, idle, step = np.inf, dict(self.weights), 0, 0
        for epoch in range(epochs):
            weight = beta * min(1.0, (epoch + 1) / max(warm_up, 1))
            losses = []
            for at in np.array_split(random.permutation(len(train)), max(1, len(train) // batch)):
                loss, grads = self._loss(train[at], random.normal(size=(len(at), self.latent)), weight)
                losses.append(loss)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            level = self._loss(held, np.zeros((len(held), self.latent)), beta)[0]
            self.history.append((float(np.mean(losses)), level))
            if level < best - 1e-6:
                best, kept, idle = level, {k: v.copy() for k, v in self.weights.items()}, 0
            else:
                idle += 1
                if idle >= patience:
                    break
        self.weights = kept
        return self

    def embed(self, units: DataFrame, mean: str = "latent", variance: str = "latent_var") -> DataFrame:
        """Adds each unit's code: its mean, and its variance."""
        both = map_vectors(units, lambda x: np.hstack(self.encode(x)), "_code")
        d = self.latent
        return both.withColumns({mean: F.slice("_code", 1, d), variance: F.transform(F.slice("_code", d + 1, d), F.exp)}).drop("_code")


def embed_space(units: DataFrame, space: str, count: int = 8, columns: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """``units`` whose ``vec`` lies in the space ``raw``, ``pca`` or ``vae``."""
    if space == "raw":
        return units
    if space == "pca":
        return fit_components(units, count).embed(units, "_m").drop("vec").withColumnRenamed("_m", "vec")
    dimension = units.select(F.size("vec").alias("d")).limit(1).first()["d"]
    model = Autoencoder(MixedColumns(tuple(columns or range(dimension))), count, seed=seed).fit(units)
    return model.embed(units, "_m", "_v").drop("vec", "_v").withColumnRenamed("_m", "vec")
