"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and towards its own diagonal; the score is
a logistic of the difference of Mahalanobis log-densities, computed with cached inverse Cholesky factors. Shrinkage and
the logistic's scale are chosen by cross-validated log-loss on the training sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_by_hash, free_names, with_result

UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
SPACE, MARKS = b" \t\n\r\x0b\f", b".,;:!?'\"()-"
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in MARKS)
STATISTICS = ("log_chars", "log_words", "upper", "digit", "symbol", "mark", "bang", "space", "wide", "mean_word", "long_word", "distinct", "distinct_pairs", "top", "repeat", "log_lines", "same_lines", "short_lines", "marked_words", "capital_words", "sentence", "bare_words")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; a null or empty text has those of no words."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n, words = max(len(b), 1), b.split()
    w = max(len(words), 1)
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    low = b.lower().split()
    counts = Counter(low)
    lines = [x for x in b.split(b"\n") if x.strip()]
    ends = Counter(x[-1] for x in words)
    starts = Counter(x[0] for x in words)
    angle = lambda p: float(np.arcsin(np.sqrt(min(max(p, 0.0), 1.0))))
    return [
        np.log1p(len(b)), np.log1p(len(words)), angle(share(UPPER)), angle(share(DIGITS)), angle(share(SYMBOLS)), angle(share(MARKS)), angle(share(b"!")), angle(share(SPACE)),
        angle((len(b) - len(text or "")) / n), np.log1p(sum(map(len, counts)) / max(len(counts), 1)), np.log1p(max(map(len, counts), default=0)),
        angle(len(counts) / w), angle(len(set(zip(low, low[1:]))) / max(len(low) - 1, 1)), angle(max(counts.values(), default=0) / w), angle(sum(map(eq, low, low[1:])) / w),
        np.log1p(len(lines)), angle(1 - len(set(lines)) / max(len(lines), 1)), angle(sum(1 for x in lines if len(x) < 30) / max(len(lines), 1)),
        angle(sum(v for k, v in ends.items() if k in SYMBOLS) / w), angle(sum(v for k, v in starts.items() if 65 <= k <= 90) / w), angle(sum(ends[k] for k in b".!?") / w), angle(sum(v for k, v in counts.items() if len(k) == 1 and not k.isalnum()) / w),
    ]


@dataclass
class Model:
    mean: np.ndarray  # of all statistics, and their scale
    scale: np.ndarray
    centres: list[np.ndarray]  # by class: 0, 1
    factors: list[np.ndarray]  # inverse lower Cholesky factors
    log_dets: list[float]
    a: float  # score = logistic(a * difference + b)
    b: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z, d = (x - self.mean) / self.scale, []
        for c, f, g in zip(self.centres, self.factors, self.log_dets, strict=True):
            d.append(-0.5 * (((z - c) @ f.T) ** 2).sum(1) - 0.5 * g)
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.difference(x) + self.b, -40, 40)))


def _gaussians(x: np.ndarray, y: np.ndarray, to_pooled: float, to_diagonal: float) -> Model:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    centres, covs = [], []
    for k in (0, 1):
        own = z[y == k] if (y == k).any() else z
        centres.append(own.mean(0))
        covs.append(np.cov(own.T, bias=True) if len(own) > 1 else np.eye(z.shape[1]))
    weight = [max((y == k).mean(), 1e-9) for k in (0, 1)]
    pooled = (weight[0] * covs[0] + weight[1] * covs[1]) / sum(weight)
    factors, log_dets = [], []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Model(mean, scale, centres, factors, log_dets, 1.0, float(np.log(weight[1] / weight[0])))


def _logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """a, b and the log-loss of logistic(a * d + b), by Newton's method with a small ridge.

    The targets are Platt's, a little inside 0 and 1, so that classes which the sample separates keep finite scores.
    """
    d = np.clip(d, -200, 200)
    y = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    a, b = 0.05, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))
        w, r = p * (1 - p) + 1e-9, p - y
        g = np.array([r @ d + 1e-3 * a, r.sum()])
        h = np.array([[w @ (d * d) + 1e-3, w @ d], [w @ d, w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a * d + b, -40, 40))), 1e-12, 1 - 1e-12)
    return float(max(a, 1e-6)), float(b), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(x: np.ndarray, y: np.ndarray, folds: int = 4) -> Model:
    """x: statistics, y: 0 or 1. With fewer than two rows of a class, every score is the (smoothed) share of class 1."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        k = x.shape[1] if x.ndim == 2 and len(x) else len(STATISTICS)
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(k), np.ones(k), [np.zeros(k)] * 2, [np.eye(k)] * 2, [0.0, 0.0], 1.0, float(np.log(share / (1 - share))))
    part, best = np.arange(len(y)) % folds, None
    for to_pooled in (0.02, 0.1, 0.3):
        for to_diagonal in (0.02, 0.1, 0.5):
            d = np.zeros(len(y))
            for f in range(folds):
                d[part == f] = _gaussians(x[part != f], y[part != f], to_pooled, to_diagonal).difference(x[part == f])
            a, b, loss = _logistic(d, y)
            if best is None or loss < best[0]:
                best = (loss, to_pooled, to_diagonal, a, b)
    model = _gaussians(x, y, best[1], best[2])
    model.a, model.b = best[3], best[4]
    return model


def _column(text_col: str):
    @F.pandas_udf("array<double>")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(x) for x in texts])

    return column(F.col(text_col))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 6000) -> Model:
    """Fits on at most per_class labelled rows of each class, taken in the order of a hash of their id, whole texts.

    labels that are null or not 0 or 1 are left out; an id with both labels counts as 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    picked = first_by_hash(known, "y", "id", per_class)  # at most 2 * per_class rows
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    # of an id that repeats the text with the smallest hash counts
    one = own.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text")))).where(F.col("_nth") == 1)
    rows = one.select("id", "y", _column("text").alias("x")).collect()
    if not rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    rows.sort(key=lambda r: str(r[0]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in rows], dtype=float))


def scored(model: Model, text_col: str = "text", threshold: float = 0.5) -> Column:
    """A struct column of score and predicted; see with_quality()."""

    @F.pandas_udf("score double, predicted int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            s = model.score(np.array([statistics(x) for x in texts])) if len(texts) else np.zeros(0)
            yield pd.DataFrame({"score": s, "predicted": (s >= threshold).astype(np.int32)})

    return score(F.col(text_col))


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1, higher: class 1 likelier) and predicted (1 if score >= threshold, else 0).

    Null and empty texts get the score of a text without words. Texts of any length are read whole; repeated rows each
    get the same result. Input columns of these names give way; all others stay. No rows: no rows.
    """
    (found,) = free_names(docs, "found")
    held = docs.withColumn(found, scored(model, text_col, threshold))
    return with_result(held, score=F.col(f"{found}.score"), predicted=F.col(f"{found}.predicted")).drop(found)
