"""Synthetic documents on a map: every row is drawn from its own seed, so partitioning never changes the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.topicscore import lloyd, spread_centres


def points(spark: SparkSession, n: int, k: int, clusters: int = 30, seed: int = 0, sample: int = 20_000) -> DataFrame:
    """(node, x, y, blob, grp): uniform points, blobs of a k-means on at most `sample` of them, grp = blob mod k."""
    u = lambda axis: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(axis)), F.lit(1 << 40)) / float(1 << 40)
    xy = spark.range(n).select(F.col("id").alias("node"), u(0).alias("x"), u(1).alias("y"))
    some = xy.where(F.col("node") < sample).select("x", "y").toPandas().to_numpy()
    centres, _ = lloyd(some, spread_centres(some, min(clusters, len(some)), seed))
    d = F.array(*[F.pow(F.col("x") - float(a), 2) + F.pow(F.col("y") - float(b), 2) for a, b in centres])
    return xy.withColumn("d", d).withColumn("blob", (F.array_position("d", F.array_min("d")) - 1).cast("int")).select("node", "x", "y", "blob", (F.col("blob") % k).alias("grp"))


def topic_weights(nodes: DataFrame, k: int, noise: float = 0.05, seed: int = 0, strong: bool = False) -> DataFrame:
    """nodes with w: a Dirichlet draw whose largest entry is the group's topic (shuffled with chance `noise`), and a pure
    document for the first node of each group. strong: one mixture for each blob, jittered and renormalised."""
    pure = {r["node"]: r["grp"] for r in nodes.groupBy("grp").agg(F.min("node").alias("node")).collect()}

    def mixture(rng: np.random.Generator, g: int) -> np.ndarray:
        w = np.sort(rng.dirichlet(rng.uniform(0.1, 0.5, k)))[::-1]
        return np.insert(w[1:], g, w[0])

    def draw(node: int, g: int, blob: int) -> np.ndarray:
        if pure.get(node) == g:
            return np.eye(k)[g]
        rng = np.random.default_rng([seed, node])
        if strong:
            w = np.abs(mixture(np.random.default_rng([seed, 10**9 + blob]), g) + np.abs(rng.normal(0, 0.03, k)))
            return w / w.sum()
        w = mixture(rng, g)
        return rng.permutation(w) if rng.random() < noise else w

    @F.pandas_udf("array<double>")
    def run(node: pd.Series, grp: pd.Series, blob: pd.Series) -> pd.Series:
        return pd.Series([draw(*x) for x in zip(node.tolist(), grp.tolist(), blob.tolist(), strict=True)], dtype=object)

    return nodes.withColumn("w", run("node", "grp", "blob"))


def topics(k: int, p: int, seed: int = 0) -> np.ndarray:
    """K x p: uniform draws and one pure term for each topic; rows sum to one."""
    a = np.random.default_rng([seed, 7]).random((k, p))
    a[:, :k] = np.eye(k)
    return a / a.sum(1, keepdims=True)


def draw_counts(weights: DataFrame, a: np.ndarray, length: int, seed: int = 0) -> DataFrame:
    """(node, term, n) with n > 0: multinomial counts of `length` words under w A."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for node, w in zip(pdf["node"], pdf["w"], strict=True):
                q = np.asarray(w) @ a
                n = np.random.default_rng([seed, int(node), 3]).multinomial(length, q / q.sum())
                own = np.flatnonzero(n)
                parts.append(pd.DataFrame({"node": node, "term": [f"t{j:05d}" for j in own], "n": n[own].astype(np.int64)}))
            if parts:
                yield pd.concat(parts)

    return weights.select("node", "w").mapInPandas(run, "node long, term string, n long")
