"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

A text's features are its hashed character n-grams, within words and over their ends, and its hashed words; its vector
is the mean of their embeddings. As everything behind the embeddings is linear, each bucket adds a fixed row to the
logits, and scoring is one gather over the whole text. A temperature is fitted on rows set aside, and a text is rejected
when the probability of its language is below the least that all but a stated share of those rows reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_by_hash, free_names, with_result

UNKNOWN = "und"
#: Odd multipliers of the hash.
MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
#: Characters hashed at a time; what a text's features are does not depend on it.
PART = 1 << 18


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def _powers() -> np.ndarray:
    return np.cumprod(np.full(4096, 2654435761, dtype=np.uint32), dtype=np.uint32)


def _marked(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters made one zero, zeros at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[0], np.where(_letters()[c], c, 0), [0]]).astype(np.uint32)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def _grams(c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of c without a gap inside."""
    letter = c != 0
    h = np.full(len(c) - n + 1, n * 40503, np.uint32)
    whole = np.ones(len(h), bool)
    for i in range(n):
        h = (h + c[i : len(c) - n + 1 + i]) * MIX[i]
        if 0 < i < n - 1:
            whole &= letter[i : len(c) - n + 1 + i]
    return h[whole]


def _sum(c: np.ndarray, lo: int, hi: int) -> np.uint32:
    """Sum of the characters of a word times the powers of their places, in parts."""
    total = 0
    for at in range(lo, hi, PART):
        stop = min(at + PART, hi)
        total += int((c[at:stop] * _powers()[np.minimum(np.arange(at - lo, stop - lo), 4095)]).sum(dtype=np.uint32))
    return np.uint32(total & 0xFFFFFFFF)


def _words(c: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the words of c, those that start within PART of each other at once."""
    letter = c != 0
    starts, ends = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PART)))
        if j > i + 1 and ends[j - 1] - starts[j - 1] > PART:
            j -= 1  # a word longer than a part comes by itself
        size = ends[i:j] - starts[i:j]
        if size[0] > PART:
            sums = np.array([_sum(c, starts[i], ends[i])], np.uint32)
        else:
            at = starts[i:j] - starts[i]
            place = np.arange(ends[j - 1] - starts[i])
            place -= np.repeat(at, np.diff(np.append(at, len(place))))
            sums = np.add.reduceat(c[starts[i] : ends[j - 1]] * _powers()[np.minimum(place, 4095)], at, dtype=np.uint32)
        yield sums * MIX[1] + size.astype(np.uint32)
        i = j


def buckets(text: str | None, size: int) -> Iterator[np.ndarray]:
    """All buckets of a whole text, in parts: of the n-grams of 2, 3 and 4 characters, then of the words; none if it has no letter.

    size: a power of two. n-grams are dealt by where they start and words are whole, so the parts do not change what is found.
    """
    c = _marked(text) if text else np.zeros(0, np.uint32)
    if not c.any():
        return
    shift = np.uint32(32 - (size.bit_length() - 1))

    def bucket(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint32(15))) * MIX[0]) >> shift

    for n in (2, 3, 4):
        for at in range(0, len(c) - n + 1, PART):
            yield bucket(_grams(c[at : at + PART + n - 1], n))
    for h in _words(c):
        yield bucket(h)


def features(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets (int32) and weights (float32) of a whole text; the weights sum to one."""
    total = np.zeros(size)
    for b in buckets(text, size):
        total += np.bincount(b, minlength=size)
    own = np.flatnonzero(total)
    return own.astype(np.int32), (total[own] / max(total.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    classes: list[str]
    rows: np.ndarray  # bucket x class: what a bucket adds to the logits
    bias: np.ndarray
    temperature: float
    threshold: float  # texts whose best probability is below it are rejected

    def logits(self, texts) -> np.ndarray:
        """NaN for texts without letters."""
        out = np.full((len(texts), len(self.classes)), np.nan)
        for i, text in enumerate(texts):
            total, n = np.zeros(len(self.classes)), 0
            for b in buckets(text, len(self.rows)):
                total += self.rows[b].sum(0)
                n += len(b)
            if n:
                out[i] = total / n + self.bias
        return out

    def probabilities(self, texts) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        e = np.exp(z - np.nan_to_num(z.max(1, keepdims=True)) if len(z) else z)
        return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], size: int, width: int = 16, epochs: int = 10, rate: float = 0.15, aside: float = 0.2, rejected: float = 0.001, seed: int = 7) -> Model:
    """SGD on rows (buckets, weights, language); every 1/aside-th row is set aside for the calibration."""
    classes = sorted({r[2] for r in rows})
    if not classes:
        return Model([UNKNOWN], np.zeros((size, 1)), np.zeros(1), 1.0, 0.0)
    rng, k = np.random.default_rng(seed), len(classes)
    emb, out, bias = rng.normal(0, 0.1, (size, width)), rng.normal(0, 0.1, (width, k)), np.zeros(k)
    y = np.array([classes.index(r[2]) for r in rows])
    own = [(r[0], r[1]) for r in rows]
    held = np.arange(len(rows)) % max(2, round(1 / aside)) == 0 if len(rows) >= 20 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    # sample rows of a rare language more often
    weight = 1.0 / np.maximum(np.bincount(y[train], minlength=k), 1)[y[train]]
    weight /= weight.sum()
    steps = epochs * len(train)
    order = rng.choice(train, steps, p=weight) if steps else []
    for i, d in enumerate(order):
        idx, w = own[d]
        if not len(idx):
            continue
        lr = rate * (1 - i / steps)
        x = w @ emb[idx]
        z = x @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[d]] -= 1
        back = out @ p
        out -= lr * np.outer(x, p)
        bias -= lr * p
        emb[idx] -= (lr / (w @ w)) * np.outer(w, back)  # moves the text's own vector by lr times the gradient
    table = emb @ out
    z = np.array([w @ table[i] + bias for i, w in own])
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    slack = 1 / (len(check) + 2)  # targets a little inside 0 and 1: languages that the rows separate keep finite scores

    def loss(t: float) -> float:
        p = np.log(np.maximum(_soft(z[check] / t), 1e-15))
        return float(-((1 - slack) * p[np.arange(len(check)), y[check]] + slack * p.mean(1)).mean())

    best = min((loss(t), t) for t in np.geomspace(0.02, 50, 80))
    p = _soft(z[check] / best[1])
    right = np.sort(p.max(1)[p.argmax(1) == y[check]])
    least = right[int(rejected * len(right))] * 0.9 if len(right) else 0.0
    return Model(classes, table, bias, best[1], float(least))


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, size: int = 1 << 15, **options) -> Model:
    """Fits on at most per_language rows of each value of lang_col, in the order of a hash of their id.

    Rows whose language or id is null are left out. Whole texts are turned into features on the executors.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    picked = first_by_hash(known.select("id", "lang"), "lang", "id", per_language).distinct()

    @F.pandas_udf("b binary, w binary")  # packed: the driver holds no objects for single features
    def featured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([[a.tobytes() for a in features(x, size)] for x in texts], columns=["b", "w"])

    # of an id that repeats the row with the least language, then the least hash of its text, counts
    least = Window.partitionBy("id").orderBy("lang", F.xxhash64("text"))
    one = known.join(F.broadcast(picked), ["id", "lang"], "left_semi").withColumn("_nth", F.row_number().over(least)).where(F.col("_nth") == 1)
    rows = one.select("id", "lang", featured("text").alias("f")).collect()
    rows.sort(key=lambda r: zlib.crc32(str(r["id"]).encode()))
    return fit([(np.frombuffer(r["f"]["b"], np.int32), np.frombuffer(r["f"]["w"], np.float32), r["lang"]) for r in rows], size, **options)


def predicted(model: Model, text_col: str = "text") -> Column:
    """A struct column of lang_pred, score and rejected; see with_language()."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = model.probabilities(texts)
            none = np.isnan(p).any(1) if len(p) else np.zeros(0, bool)
            p = np.nan_to_num(p)
            score = np.where(none, 0.0, p.max(1) if len(p) else 0.0)
            names = np.array(model.classes, dtype=object)[p.argmax(1)] if len(p) else np.zeros(0, object)
            yield pd.DataFrame({"lang_pred": np.where(none, UNKNOWN, names), "score": score, "rejected": none | (score < model.threshold)})

    return predict(F.col(text_col))


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language; `und` if the text is null or has no letter), score (the calibrated
    probability of it; 0 for `und`) and rejected (score below the model's threshold, or `und`).

    Input columns of these names give way; all others stay. Ties go to the language first in order. Texts of any length
    are read whole; repeated rows each get the same result. No rows: no rows.
    """
    (found,) = free_names(docs, "found")
    held = docs.withColumn(found, predicted(model, text_col))
    return with_result(held, lang_pred=F.col(f"{found}.lang_pred"), score=F.col(f"{found}.score"), rejected=F.col(f"{found}.rejected")).drop(found)
