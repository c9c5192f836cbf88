"""Embedding whitening by a tall-and-skinny QR.

Rows become integers, so that sums are exact and centring loses nothing but one rounding. Each task folds its centred rows
into one triangular factor R, the factors are merged in a tree, a few in each task, and the last R, whose size is that of
the dimensions squared, gives singular values and right vectors: those of all rows. No covariance is formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .topk import usable

#: Scale and shift of the integers; greatest size of one.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 53
#: Factors that one task merges, and rows that are worked on at a time.
FAN_IN, CHUNK = 16, 4096
#: Singular values up to this share of the greatest are zero.
ZERO = 1e-13


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x: array<long>): floor(scale * c) + shift of every usable vector; entries too large for an exact double take none part."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall(F.col(f"`{vector_col}`"), lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) <= float(LARGEST))
    held = vectors.where(usable(F.col(f"`{vector_col}`")) & fits)
    return held.select(F.col(f"`{id_col}`").alias("id"), F.transform(x, lambda v: v.cast("long") + F.lit(shift).cast("long")).alias("x"))


def _blocks(batch: pa.RecordBatch, width: int, fill: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x width) of the column x, a chunk at a time; shorter rows are filled up."""
    x = batch.column(batch.schema.get_field_index("x"))
    ends, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
    for at in range(0, len(x), CHUNK):
        lo, hi = ends[at : at + CHUNK + 1][:-1], ends[at : at + CHUNK + 1][1:]
        if len(lo) and (hi - lo == width).all():
            yield at, flat[lo[0] : hi[-1]].reshape(-1, width)
        elif len(lo):
            out = np.full((len(lo), width), fill, np.int64)
            for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
                out[i, : b - a] = flat[a:b]
            yield at, out


def totals(rows: DataFrame, fill: int = SHIFT) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension, as Python integers; a row for each dimension reaches the driver."""
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    width = max(width or 0, 0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for _, x in _blocks(batch, width, fill):
                high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"dim": np.arange(width, dtype=np.int32), "high": high, "low": low})

    if not n or not width:
        return n, []
    found = rows.select("x").mapInArrow(partial, "dim int, high long, low long").groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    sums = [0] * width
    for r in found:
        sums[r["dim"]] = (int(r["high"]) << 32) + int(r["low"])
    return n, sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: as longs where they hold it, else as Python integers."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def deviations(c: np.ndarray) -> list[int]:
    """The sum of squares of each row of centred(), exact."""
    if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * max(c.shape[1], 1) < 2**62:
        return (c * c).sum(1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in c]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """R of the rows of a over those of b."""
    return np.linalg.qr(np.vstack([a, b]), mode="r")


def tsqr(rows: DataFrame, n: int, sums: list[int], fill: int = SHIFT, fan_in: int = FAN_IN) -> np.ndarray:
    """R of all centred rows: one factor a task, then merged `fan_in` at a time until one is left."""
    width, total = len(sums), np.array(sums, dtype=object)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for _, x in _blocks(batch, width, fill):
                r = merged(r, centred(x, n, total).astype(float) / n)
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [np.ascontiguousarray(r).tobytes()]})

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, width))
        for data in pdf["r"]:
            r = merged(r, np.frombuffer(data).reshape(-1, width))
        return pd.DataFrame({"r": [np.ascontiguousarray(r).tobytes()]})

    spread = lambda df: df.select(F.xxhash64("r").alias("key"), "r")
    held = materialise(spread(rows.select("x").mapInArrow(factor, "r binary")), "tsqr")
    while (left := held.count()) > 1:
        groups = max(1, left // fan_in)
        fewer = held.groupBy(F.pmod("key", F.lit(groups)).alias("g")).applyInPandas(again, "r binary")
        nxt = materialise(spread(fewer), "tsqr")
        release(held)
        held = nxt
    out = held.first()
    release(held)
    return np.frombuffer(out["r"]).reshape(-1, width) if out else np.zeros((0, width))


def identity_error(rows: DataFrame, n: int, sums: list[int], projection: np.ndarray, fill: int = SHIFT) -> float:
    """Greatest entry of the whitened rows' covariance less the identity; a row for each cell reaches the driver."""
    width, k, total = len(sums), projection.shape[1], np.array(sums, dtype=object)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, x in _blocks(batch, width, fill):
                w = centred(x, n, total).astype(float) / n @ projection
                w = np.hstack([w, np.ones((len(w), 1))])
                both += w.T @ w
        yield pa.RecordBatch.from_pydict({"cell": np.arange(both.size, dtype=np.int32), "v": both.ravel()})

    cells = rows.select("x").mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    both = np.zeros((k + 1) ** 2)
    for r in cells:
        both[r["cell"]] = r["v"]
    both = both.reshape(k + 1, k + 1) / n
    return float(np.abs(both[:k, :k] - np.outer(both[:k, k], both[:k, k]) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = SCALE, shift: int = SHIFT, fan_in: int = FAN_IN) -> DataFrame:
    """(id_col, n, deviation, whitened: array, explained: array, identity_error): one row for each usable row.

    Vectors that are null or hold null or non-finite entries take no part, nor do those with entries beyond LARGEST / scale,
    which have no exact integer. Rows without an id are rows like any other; repeated rows count each; shorter vectors are
    filled up with zero entries. Where the rows vary in fewer directions than `components` (one row, constant dimensions),
    the whitened values of the others are 0, so that identity_error is 1. deviation is a decimal: longs end at 9.2e18. Other
    columns take no part. No usable row: no rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    rows = materialise(integers(vectors, id_col, vector_col, scale, shift), "whiten-rows")
    n, sums = totals(rows, shift)
    schema = f"id {kind.simpleString()}, deviation string, whitened array<double>"
    k, total = min(components, len(sums)), np.array(sums, dtype=object)
    r = tsqr(rows, n, sums, shift, fan_in) if k else np.zeros((0, 0))
    _, sigma, vt = np.linalg.svd(r, full_matrices=True) if k else (None, np.zeros(0), None)
    width = len(sums)
    sigma = np.pad(sigma, (0, max(0, width - len(sigma))))
    projection, explained = np.zeros((width, k)), np.zeros(k)
    for j in range(k):
        v = vt[j]
        v = v if v[np.abs(v).argmax()] >= 0 else -v
        if sigma[j] > ZERO * sigma[0]:
            projection[:, j] = v / (sigma[j] / np.sqrt(n))
            explained[j] = sigma[j] ** 2 / (sigma**2).sum()
    error = identity_error(rows, n, sums, projection, shift) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch, width, shift):
                c = centred(x, n, total)
                w = c.astype(float) / n @ projection
                ends = np.arange(0, w.size + 1, k, dtype=np.int32) if k else np.zeros(len(x) + 1, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(map(str, deviations(c)), pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], ["id", "deviation", "whitened"])

    if not n:
        made = spark.createDataFrame([], schema)
    else:
        made = rows.select("id", "x").mapInArrow(run, schema)
    return made.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", F.array(*[F.lit(float(x)) for x in explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def long_form(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each component of whiten()'s rows: (id_col, component from 1, n, deviation, whitened, explained, identity_error)."""
    each = whitened.select(id_col, "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("p", "w"))
    return each.select(id_col, (F.col("p") + 1).cast("int").alias("component"), "n", "deviation", F.col("w").alias("whitened"), F.col("explained")[F.col("p")].alias("explained"), "identity_error")
