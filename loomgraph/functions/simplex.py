"""Euclidean projection onto the simplex and log-ratio transforms as array expressions, inside codegen."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def project(w: Column, total: float = 1.0) -> Column:
    """The nearest array of non-negative numbers with the given sum. For arrays of a few entries; null stays null."""
    u = F.sort_array(w, asc=False)
    # state: entries seen, their sum, and the threshold at the last entry that stays positive
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("theta"))

    def step(a: Column, x: Column) -> Column:
        i, s = a["i"] + 1, a["s"] + x
        theta = (s - F.lit(total)) / i
        return F.struct(i.alias("i"), s.alias("s"), F.when(x > theta, theta).otherwise(a["theta"]).alias("theta"))

    theta = F.aggregate(u, zero, step, lambda a: a["theta"])
    return F.transform(w, lambda x: F.greatest(x - theta, F.lit(0.0)))


def project_rows(a: np.ndarray, total: float = 1.0) -> np.ndarray:
    """The same for the rows of a small matrix on the driver."""
    u = -np.sort(-a, axis=1)
    theta = (np.cumsum(u, axis=1) - total) / np.arange(1, a.shape[1] + 1)
    rho = a.shape[1] - 1 - np.argmax((u > theta)[:, ::-1], axis=1)
    return np.maximum(a - theta[np.arange(len(a)), rho][:, None], 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def argmax(w: Column) -> Column:
    """Index of the first largest entry, from 0."""
    return F.array_position(w, F.array_max(w)).cast("int") - 1


def clr(w: Column, least: float = 1e-6) -> Column:
    """Centred log-ratios; entries below `least` count as it."""
    logs = F.transform(w, lambda x: F.log(F.greatest(x, F.lit(least))))
    mean = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(w)
    return F.transform(logs, lambda x: x - mean)


def ilr_basis(k: int) -> np.ndarray:
    """k x (k - 1) orthonormal basis of the vectors that sum to zero."""
    b = np.zeros((k, k - 1))
    for j in range(1, k):
        b[:j, j - 1] = np.sqrt(j / (j + 1)) / j
        b[j, j - 1] = -np.sqrt(j / (j + 1))
    return b


def ilr(w: Column, k: int, least: float = 1e-6) -> Column:
    c, basis = clr(w, least), ilr_basis(k)
    return F.array(*[dot(c, F.array(*map(F.lit, map(float, basis[:, j])))) for j in range(k - 1)])


def from_ilr(z: np.ndarray) -> np.ndarray:
    """Coefficients on log-ratio coordinates, back on the centred log-ratios."""
    z = np.asarray(z)
    return z @ ilr_basis(z.shape[-1] + 1).T
