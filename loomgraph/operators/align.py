"""Bringing topics of different models into one order: small matrices on the driver, relabelling by a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.special import assignment


def unit_rows(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def mapping(a: np.ndarray, b: np.ndarray, signed: bool = False) -> np.ndarray:
    """0/1 matrix m with m[i, j] = 1 where row i of a is matched with row j of b: the best total (absolute) cosine."""
    s = unit_rows(a) @ unit_rows(b).T
    m = np.zeros(s.shape)
    for i, j in assignment(-s if signed else 1 - np.abs(s)):
        m[i, j] = 1
    return m


def aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows of a in the order of the rows of b that they match."""
    return mapping(a, b).T @ a


def permutation(a: np.ndarray, b: np.ndarray) -> list[int]:
    """For models of different K: a position for each row of a; matched rows take their partner's, the rest follow in order."""
    m = mapping(a, b)
    place = {i: int(m[i].argmax()) for i in range(len(a)) if m[i].any()}
    free = [j for j in range(max(len(a), len(b))) if j not in place.values()]
    return [place[i] if i in place else free.pop(0) for i in range(len(a))]


def consistent_orders(models: list[np.ndarray]) -> list[list[int]]:
    """For each model the order of its rows that follows the model before it; unmatched rows come last."""
    orders = [list(range(len(models[0])))]
    for before, now in zip(models, models[1:], strict=False):
        m = mapping(before, now, signed=True)
        next_ = [int(m[i].argmax()) for i in orders[-1] if m[i].any()]
        orders.append(next_ + [j for j in range(len(now)) if j not in next_])
    return orders


def relabelled(df: DataFrame, order: list[int], topic: str = "topic") -> DataFrame:
    """df with old topic order[i] called i."""
    return df.withColumn(topic, F.create_map(*[F.lit(x) for i, old in enumerate(order) for x in (old, i)])[F.col(topic)])


def topic_paths(models: list[np.ndarray]) -> list[dict]:
    """Of models of rising K: a path goes on where a topic's best match looks back at it. Paths, and the first K at which one breaks."""
    paths, rows = [[i] for i in range(len(models[0]))], []
    for before, now in zip(models, models[1:], strict=False):
        s = unit_rows(before) @ unit_rows(now).T
        ahead, back = s.argmax(1), s.argmax(0)
        live = [p for p in paths if back[ahead[p[-1]]] == p[-1]]
        rows.append({"k": len(now), "paths": len(live), "broken": len(paths) - len(live)})
        held = {int(ahead[p[-1]]) for p in live}
        paths = [[*p, int(ahead[p[-1]])] for p in live] + [[j] for j in range(len(now)) if j not in held]
    return rows


def stability(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Of two models of one K on different folds: L1 distance by K, mean matched cosine, its ratio to the mean of the others."""
    k = len(a)
    s = unit_rows(aligned(a, b)) @ unit_rows(b).T
    off = (s.sum() - np.trace(s)) / max(k * (k - 1), 1)
    return {"l1_dist": float(np.abs(aligned(a, b) - b).sum() / k), "cos_sim": float(np.trace(s) / k), "cos_sim_ratio": float(np.trace(s) / k / max(off, 1e-12))}
