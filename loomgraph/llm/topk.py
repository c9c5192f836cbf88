"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of a fixed size, each small enough to travel to every task. For a block, every candidate is
scored in each pass: the first pass bounds each query's k-th best score, the next ones refine global histograms between
the bounds until the k-th value itself is known, the last keeps what lies above it and the ties at it, of which each
task needs only the k smallest ids. Candidates are never shuffled or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BINS = 256
#: Candidates scored at a time.
CHUNK = 2048


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vectors, width: int | None = None) -> np.ndarray:
    """floor(256 * x) of each component, shorter vectors filled up with zeros."""
    rows = [np.floor(256.0 * np.asarray(v, dtype=np.float64)) for v in vectors]
    width = max([width or 0, *map(len, rows)])
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; sums that doubles cannot hold exactly are made of longs (modulo 2**64)."""
    w = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (q, c))
    if not len(q) or not len(c) or np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * w < 2**53:
        return (q @ c.T).astype(np.int64)
    return np.clip(q, -(2.0**62), 2.0**62).astype(np.int64) @ np.clip(c, -(2.0**62), 2.0**62).astype(np.int64).T


def _bounds(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """q, n (candidates), most, least, kth (the best k-th score that any one task has; null if none has k)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.iinfo(np.int64).min
        top, n, least = np.full((len(ids), k), floor), np.zeros(len(ids), np.int64), np.full(len(ids), np.iinfo(np.int64).max)
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                s = scores(queries, quantised(part["v"]))
                other = ids[:, None] != part["id"].to_numpy(np.int64)[None, :]
                n += other.sum(1)
                least = np.minimum(least, np.where(other, s, np.iinfo(np.int64).max).min(1))
                both = np.hstack([top, np.where(other, s, floor)])
                top = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        some = np.flatnonzero(n)
        yield pd.DataFrame({"q": some.astype(np.int32), "n": n[some], "most": top.max(1)[some], "least": least[some], "kth": pd.Series(top.min(1)[some]).astype("Int64").where(pd.Series(n[some] >= k))})

    rows = candidates.mapInPandas(run, "q int, n long, most long, least long, kth long")
    return rows.groupBy("q").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"), F.max("kth").alias("kth")).orderBy("q").toPandas()


def _histogram(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> pd.DataFrame:
    """q, bin, n: counts of scores in the bins above low, only those that can hold a task's k best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(ids), BINS + 1), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                s = scores(queries, quantised(part["v"]))
                q, c = np.nonzero((s >= low[:, None]) & (ids[:, None] != part["id"].to_numpy(np.int64)[None, :]))
                b = np.minimum((s[q, c] - low[q]) // width[q], BINS)
                n += np.bincount(q * (BINS + 1) + b, minlength=n.size).reshape(n.shape)
        above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n  # counted in higher bins
        q, b = np.nonzero((n > 0) & (above < k))
        yield pd.DataFrame({"q": q.astype(np.int32), "bin": b.astype(np.int32), "n": n[q, b]})

    return candidates.mapInPandas(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas()


def _kth(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query, or its least one where it has fewer candidates."""
    found = _bounds(candidates, ids, queries, k)
    kth = np.full(len(ids), np.iinfo(np.int64).max)
    if found.empty:
        return kth
    q = found["q"].to_numpy(np.int64)
    few = found["n"].to_numpy() < k
    low, high = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), np.iinfo(np.int64).max - 1)
    low[q] = np.where(few | found["kth"].isna(), found["least"], found["kth"].fillna(0)).astype(np.int64)
    high[q] = np.where(few, low[q], found["most"])
    above = np.zeros(len(ids), np.int64)  # scores beyond high
    while (open_ := low < high).any():
        width = np.where(open_, (high - low) // BINS + 1, 1)
        h = _histogram(candidates, ids[open_], queries[open_], low[open_], width[open_], k)
        where = np.flatnonzero(open_)
        n = np.zeros((len(where), BINS + 1), np.int64)
        n[h["q"].to_numpy(np.int64), h["bin"].to_numpy(np.int64)] = h["n"]
        reach = np.cumsum(n[:, ::-1], axis=1)[:, ::-1]  # in this bin and higher ones
        b = (reach >= k).sum(1) - 1  # the highest bin that the k-th value can lie in
        low[where] = low[where] + b * width[where]
        high[where] = np.minimum(high[where], low[where] + width[where] - 1)
    kth[q] = low[q]
    return kth


def _block(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    kth = _kth(candidates, ids, queries, k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ties = pd.DataFrame({"q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                own = part["id"].to_numpy(np.int64)
                s = scores(queries, quantised(part["v"]))
                q, c = np.nonzero((s >= kth[:, None]) & (ids[:, None] != own[None, :]))
                got = pd.DataFrame({"q": q, "vec_id": own[c], "score": s[q, c]})
                tie = got["score"].to_numpy() == kth[q]
                yield got[~tie].assign(query_id=lambda x: ids[x["q"]])[["query_id", "vec_id", "score"]]
                ties = pd.concat([ties, got[tie]]).sort_values(["q", "vec_id"]).groupby("q").head(k)
        yield ties.assign(query_id=ids[ties["q"].to_numpy(np.int64)])[["query_id", "vec_id", "score"]]

    kept = candidates.mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k best rows of another id, by score, then id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part; a query with
    fewer candidates gets all; repeated rows count each as a candidate, and once as a query (with the least vector, where they differ). Vectors of unequal length
    are filled up with zeros. No queries: no rows.
    """
    spark = vectors.sparkSession
    held = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    candidates = held.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = held.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialise(asked, "topk-queries")
    parts = -(-asked.count() // block)
    # the k-th part of the ids in hashed order; each holds about `block` queries
    outs = []
    for i in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).orderBy("id").toPandas()
        if len(rows):
            out = _block(candidates, rows["id"].to_numpy(np.int64), quantised(rows["v"]), k)
            outs.append(materialise(out, "topk-block") if parts > 1 else out)
    if not outs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, outs)
