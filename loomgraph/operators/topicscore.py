"""Topics from ratios of singular vectors: the terms x terms matrix is aggregated, the geometry of p terms is solved on the driver."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import linalg
from loomgraph.functions.simplex import project, project_rows
from loomgraph.shared import materialise


def lloyd(points: np.ndarray, centres: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """k-means from given centres: centres and labels; an empty cluster keeps its centre."""
    label = None
    for _ in range(rounds):
        new = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        centres = np.array([points[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
    return centres, label


def spread_centres(points: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Starting centres drawn with chances that grow with the squared distance to those before."""
    rng = np.random.default_rng(seed)
    picked = [points[rng.integers(len(points))]]
    while len(picked) < k:
        d = ((points[:, None, :] - np.array(picked)[None, :, :]) ** 2).sum(2).min(1)
        picked.append(points[rng.choice(len(points), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(points))])
    return np.array(picked)


def barycentric(points: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    """Weights, summing to one, that give each point from the vertices of a simplex; negative outside."""
    m = np.vstack([vertices.T, np.ones(len(vertices))])
    return np.linalg.lstsq(m, np.vstack([points.T, np.ones(len(points))]), rcond=None)[0].T


def distance_to_simplex(points: np.ndarray, vertices: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Euclidean distance of each point to the hull of the vertices: accelerated projected gradient on the weights."""
    w = project_rows(barycentric(points, vertices))
    step = 1 / max(np.linalg.norm(vertices @ vertices.T, 2), 1e-12)
    ahead, t = w, 1.0
    for _ in range(rounds):
        new = project_rows(ahead - step * (ahead @ vertices - points) @ vertices.T)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return np.linalg.norm(w @ vertices - points, axis=1)


def vertices(points: np.ndarray, k: int, clusters: int, most: int, seed: int = 0) -> np.ndarray:
    """k vertices: centres of clusters, of which far ones are kept, of which the k whose simplex lies closest to the rest."""
    centres, _ = lloyd(points, spread_centres(points, min(clusters, len(points)), seed))
    centres = np.unique(np.round(centres, 12), axis=0)
    most = min(max(most, k), len(centres))
    d = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2)
    kept = list(np.unravel_index(d.argmax(), d.shape)) if len(centres) > 1 else [0]
    while len(kept) < most:  # farthest, on average, from those kept
        gain = d[:, kept].mean(1)
        gain[kept] = -1
        kept.append(int(gain.argmax()))
    return min((centres[list(c)] for c in combinations(sorted(set(map(int, kept))), k)), key=lambda v: distance_to_simplex(centres, v).max())


def fit(x: DataFrame, vocab: DataFrame, k: int, doc: str = "doc_id", most: int | None = None, clusters: int | None = None, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(doc, w) and the K x p topics. x: (doc, term, x) with rows summing to one; vocab: (term, term_id)."""
    p = vocab.count()
    most = most or int(np.ceil(1.5 * k))
    clusters = clusters or min(10 * k, int(np.ceil(0.7 * p)))
    sparse = materialise(linalg.rows(x, vocab, doc), "score-rows")
    g, sums, n = linalg.gram(sparse, p)
    mean = np.maximum(sums / max(n, 1), 1e-12)
    xi, _ = linalg.top_eigen(g / np.sqrt(np.outer(mean, mean)), k)
    first = np.maximum(np.abs(xi[:, 0]), 1e-12)
    if k > 1:
        ratio = xi[:, 1:] / np.where(xi[:, 0] < 0, -first, first)[:, None]
        ratio = np.clip(ratio, -np.log(max(n, 3)), np.log(max(n, 3)))
        share = np.maximum(barycentric(ratio, vertices(ratio, k, clusters, most, seed)), 0)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
    else:
        share = np.ones((p, 1))
    a = (np.sqrt(mean) * first)[:, None] * share
    a = a / np.maximum(a.sum(0, keepdims=True), 1e-300)
    back = (a / mean[:, None]) @ np.linalg.pinv(a.T @ (a / mean[:, None]))
    w = linalg.times(sparse, back, doc, "w").select(doc, project(F.col("w")).alias("w"))
    return w, a.T
