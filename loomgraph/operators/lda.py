"""Variational LDA with a prior for each document: the E-step runs on the executors, statistics are summed, the M-step is small."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.special import dirichlet_expectation, gammaln
from loomgraph.shared import materialise, spread


def e_step(idx: np.ndarray, val: np.ndarray, prior: np.ndarray, beta: np.ndarray, rounds: int = 100, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """gamma and the K x len(idx) statistics (without beta's factor) of one document. beta: exp(E[log topic]), K x terms."""
    gamma = np.full(len(prior), 1.0)
    theta = np.exp(dirichlet_expectation(gamma))
    b = beta[:, idx]
    for _ in range(rounds):
        before = gamma
        norm = theta @ b + 1e-100
        gamma = prior + theta * (b @ (val / norm))
        theta = np.exp(dirichlet_expectation(gamma))
        if np.abs(gamma - before).mean() < tol:
            break
    return gamma, np.outer(theta, val / (theta @ b + 1e-100))


def dense_parts(pdf: pd.DataFrame, p: int, cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts (documents x terms) and priors of the rows of pdf, in parts of bounded size."""
    size = max(1, cells // max(p, 1))
    for at in range(0, len(pdf), size):
        part = pdf.iloc[at : at + size]
        lengths = [len(i) for i in part["idx"]]
        out = np.zeros((len(part), p))
        if sum(lengths):
            out[np.repeat(np.arange(len(part)), lengths), np.concatenate(part["idx"].to_list())] = np.concatenate(part["val"].to_list())
        yield out, np.array(part["prior"].to_list(), dtype=float)


def e_steps(counts: np.ndarray, prior: np.ndarray, beta: np.ndarray, rounds: int = 100, tol: float = 1e-3) -> np.ndarray:
    """e_step()'s gamma of many documents at once; a document that has settled leaves the rounds."""
    gamma, open_ = np.ones_like(prior), np.arange(len(prior))
    for _ in range(rounds):
        theta = np.exp(dirichlet_expectation(gamma[open_]))
        new = prior[open_] + theta * ((counts[open_] / (theta @ beta + 1e-100)) @ beta.T)
        change = np.abs(new - gamma[open_]).mean(1)
        gamma[open_] = new
        open_ = open_[change >= tol]
        if not len(open_):
            break
    return gamma


@dataclass
class Lda:
    components: np.ndarray  # K x terms, variational parameters
    eta: float

    @property
    def topics(self) -> np.ndarray:
        return self.components / self.components.sum(1, keepdims=True)

    def _beta(self) -> np.ndarray:
        return np.exp(dirichlet_expectation(self.components))

    def transform(self, docs: DataFrame, doc: str = "doc_id", normal: bool = True) -> DataFrame:
        """(doc, w): topic shares (or the variational gamma) of docs (doc, idx, val, prior)."""
        beta = self._beta()

        @F.pandas_udf("array<double>")
        def run(idx: pd.Series, val: pd.Series, prior: pd.Series) -> pd.Series:
            parts = dense_parts(pd.DataFrame({"idx": idx, "val": val, "prior": prior}), beta.shape[1])
            out = [g / g.sum() if normal else g for counts, a in parts for g in e_steps(counts, a, beta)]
            return pd.Series(out, dtype=object)

        return docs.select(doc, run("idx", "val", "prior").alias("w"))

    def statistics(self, docs: DataFrame) -> tuple[np.ndarray, int]:
        """Expected topic x term counts over docs, and the number of documents."""
        beta, (k, p) = self._beta(), self.components.shape

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, n = np.zeros((k, p)), 0
            for pdf in batches:
                for counts, a in dense_parts(pdf, p):
                    theta = np.exp(dirichlet_expectation(e_steps(counts, a, beta)))
                    s += theta.T @ (counts / (theta @ beta + 1e-100))
                    n += len(a)
            t, j = np.nonzero(s)
            yield pd.DataFrame({"t": np.append(t, -1).astype(np.int32), "j": np.append(j, 0).astype(np.int32), "v": np.append(s[t, j], n)})

        cells = docs.select("idx", "val", "prior").mapInPandas(partial, "t int, j int, v double").groupBy("t", "j").agg(F.sum("v").alias("v")).toPandas()
        s, own = np.zeros((k, p)), cells["t"] >= 0
        s[cells["t"][own], cells["j"][own]] = cells["v"][own]
        return s * beta, int(cells["v"][~own].sum())

    def em_step(self, docs: DataFrame) -> Lda:
        return Lda(self.eta + self.statistics(docs)[0], self.eta)

    def partial_fit(self, docs: DataFrame, step: int, total: float, offset: float = 10.0, decay: float = 0.7) -> Lda:
        """One online update with a mini-batch, weighted by (offset + step)^-decay. total: documents in the whole corpus."""
        s, n = self.statistics(docs)
        if not n:
            return self
        weight = (offset + step) ** -decay
        return Lda((1 - weight) * self.components + weight * (self.eta + total / n * s), self.eta)

    def bound(self, docs: DataFrame) -> tuple[float, float]:
        """The evidence lower bound of docs, and their number of words."""
        logs, beta = dirichlet_expectation(self.components), self._beta()

        @F.pandas_udf("bound double, words double")
        def run(idx: pd.Series, val: pd.Series, prior: pd.Series) -> pd.DataFrame:
            rows = []
            for i, v, a in zip(idx, val, prior, strict=True):
                i, v, a = np.asarray(i, int), np.asarray(v, float), np.asarray(a, float)
                g = e_step(i, v, a, beta)[0]
                e = dirichlet_expectation(g)
                x = e[:, None] + logs[:, i]
                top = x.max(0) if len(i) else np.zeros(0)
                s = float(v @ (np.log(np.exp(x - top).sum(0)) + top)) + float(((a - g) * e).sum() + (gammaln(g) - gammaln(a)).sum() + gammaln(a.sum()) - gammaln(g.sum()))
                rows.append((s, float(v.sum())))
            return pd.DataFrame(rows, columns=["bound", "words"])

        r = docs.select(run("idx", "val", "prior").alias("r")).agg(F.sum("r.bound"), F.sum("r.words")).first()
        c = self.components
        s = ((self.eta - c) * logs).sum() + (gammaln(c) - gammaln(np.array(self.eta))).sum() + (gammaln(np.array(self.eta * c.shape[1])) - gammaln(c.sum(1))).sum()
        return float((r[0] or 0.0) + s), float(r[1] or 0.0)

    def perplexity(self, docs: DataFrame) -> float:
        b, n = self.bound(docs)
        return float(np.exp(-b / max(n, 1e-300)))


def start(k: int, p: int, eta: float | None = None, seed: int = 0) -> Lda:
    return Lda(np.random.default_rng(seed).gamma(100.0, 0.01, (k, p)), 1 / k if eta is None else eta)


def with_prior(sparse: DataFrame, k: int, alpha: float | None = None) -> DataFrame:
    return sparse.withColumn("prior", F.array(*[F.lit(float(1 / k if alpha is None else alpha))] * k))


def fit(docs: DataFrame, k: int, p: int, rounds: int = 10, model: Lda | None = None, seed: int = 0, tol: float = 0.0) -> Lda:
    """Batch variational EM over docs (doc, idx, val: counts, prior)."""
    docs = materialise(spread(docs), "lda")
    model = model or start(k, p, seed=seed)
    for _ in range(rounds):
        new = model.em_step(docs)
        done = np.abs(new.topics - model.topics).max() < tol
        model = new
        if done:
            break
    return model
