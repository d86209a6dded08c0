"""Functions over ``array<double>`` columns, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a clamped variance: exp(-10) and exp(2).
LOW_VARIANCE, HIGH_VARIANCE = 4.5399929762484854e-05, 7.38905609893065


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def gaussian_kernel(a: Column, b: Column, sigma_sq: float | Column) -> Column:
    """exp(-d² / 2σ²)."""
    return F.exp(-squared_distance(a, b) / (F.lit(2.0) * sigma_sq))


def clamp_variance(variance: Column) -> Column:
    return F.least(F.greatest(variance.cast("double"), F.lit(LOW_VARIANCE)), F.lit(HIGH_VARIANCE))


def _clamped(values: Column, clamp: bool) -> Column:
    return F.transform(values, clamp_variance) if clamp else values


def kl_gaussians(mean_p: Column, var_p: Column, mean_q: Column, var_q: Column, clamp: bool = True) -> Column:
    """Divergence of diagonal Gaussians p from q."""
    var_p, var_q = _clamped(var_p, clamp), _clamped(var_q, clamp)
    spread = F.zip_with(var_p, var_q, lambda p, q: F.log(q / p) + p / q - 1.0)
    shift = F.zip_with(F.zip_with(mean_p, mean_q, lambda p, q: (p - q) * (p - q)), var_q, lambda d, q: d / q)
    return (total(spread) + total(shift)) * 0.5


def symmetric_kl_gaussians(mean_p: Column, var_p: Column, mean_q: Column, var_q: Column, clamp: bool = True) -> Column:
    """Sum of both divergences of two diagonal Gaussians."""
    var_p, var_q = _clamped(var_p, clamp), _clamped(var_q, clamp)
    spread = F.zip_with(var_p, var_q, lambda p, q: p / q + q / p - 2.0)
    weight = F.zip_with(var_p, var_q, lambda p, q: 1.0 / p + 1.0 / q)
    shift = F.zip_with(F.zip_with(mean_p, mean_q, lambda p, q: (p - q) * (p - q)), weight, lambda d, w: d * w)
    return (total(spread) + total(shift)) * 0.5
