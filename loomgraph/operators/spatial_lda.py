"""LDA whose documents' priors vary little along a graph: ADMM between Dirichlet Newton steps and total variation on each sample's edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.special import digamma, dirichlet_expectation, gammaln, trigamma
from loomgraph.operators import fusion, graph, lda
from loomgraph.operators.graph import edge_blocks as _blocks
from loomgraph.operators.running import number_rows
from loomgraph.shared import materialise, release


def dirichlet_newton(r: np.ndarray, logs: np.ndarray, rho: float | np.ndarray, start: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Rows tau that minimise sum lnG(tau) - lnG(sum tau) - tau . logs + rho/2 |tau - r|^2, tau > 0; rho: one, or one for each row.

    The Hessian is a diagonal plus a constant, so Newton's step has a closed form; steps are halved until they descend.
    """
    tau = np.maximum(start, 1e-3)
    rho = np.reshape(rho, (-1, 1))

    def value(t: np.ndarray) -> np.ndarray:
        return gammaln(t).sum(1) - gammaln(t.sum(1)) - (t * logs).sum(1) + (rho / 2 * (t - r) ** 2).sum(1)

    now = value(tau)
    for _ in range(rounds):
        total = tau.sum(1, keepdims=True)
        g = digamma(tau) - digamma(total) - logs + rho * (tau - r)
        d, c = trigamma(tau) + rho, trigamma(total)
        s = g / d
        step = s + (1 / d) * (c * s.sum(1, keepdims=True)) / (1 - c * (1 / d).sum(1, keepdims=True))
        size, slope = np.ones(len(tau)), (g * step).sum(1)
        if slope.max(initial=0) < 1e-10:
            break
        for _ in range(30):
            new = tau - size[:, None] * step
            ok = (new > 1e-6).all(1)
            v = np.where(ok, value(np.maximum(new, 1e-6)), np.inf)
            bad = v > now - 1e-4 * size * slope
            if not bad.any():
                break
            size = np.where(bad, size / 2, size)
        good = v <= now
        tau, now = np.where(good[:, None], new, tau), np.where(good, v, now)
    return tau


def admm(gamma: np.ndarray, src: np.ndarray, tgt: np.ndarray, weight: np.ndarray, penalty: float = 0.25, rho: float = 1.0, rounds: int = 15, tol: float = 0.0) -> np.ndarray:
    """Priors xi of one sample's documents: Dirichlet likelihood of their topic weights, total variation along its edges."""
    logs = dirichlet_expectation(gamma)
    xi = tau = np.maximum(gamma / gamma.sum(1, keepdims=True), 1e-2)
    v, dual, before = np.zeros_like(xi), None, np.inf
    for _ in range(rounds):
        xi, dual, _ = fusion.solve(tau + v, src, tgt, weight, penalty / rho, dual, l2=False, tol=1e-5, most=200)
        old = tau
        tau = dirichlet_newton(xi - v, logs, rho, tau)
        v = v + tau - xi
        primal, change = np.linalg.norm(tau - xi), rho * np.linalg.norm(tau - old)
        if primal > 4 * change:
            rho, v, dual = rho * 2, v / 2, None if dual is None else dual / 2
        elif change > 4 * primal:
            rho, v, dual = rho / 2, v * 2, None if dual is None else dual * 2
        now = float((gammaln(tau).sum(1) - gammaln(tau.sum(1)) - (tau * logs).sum(1)).sum() + penalty * (weight[:, None] * np.abs(xi[src] - xi[tgt])).sum())
        if tol and abs(before - now) < tol * max(abs(before), 1e-12):
            break
        before = now
    return np.maximum(tau, 1e-3)


@dataclass
class SpatialLda:
    model: lda.Lda
    priors: DataFrame  # (doc, prior)
    w: DataFrame


def _newton_steps(r: np.ndarray, rho: np.ndarray, tau: np.ndarray, logs: np.ndarray, share: np.ndarray, steps: int = 2) -> np.ndarray:
    """A few steps towards the rows that minimise share * likelihood + rho/2 |tau - r|^2; none falls below a fifth of itself."""
    for _ in range(steps):
        total = tau.sum(1, keepdims=True)
        g = share * (digamma(tau) - digamma(total) - logs) + rho * (tau - r)
        d, c = share * trigamma(tau) + rho, share * trigamma(total)
        s = g / d
        tau = np.maximum(tau - s - (1 / d) * (c * s.sum(1, keepdims=True)) / (1 - c * (1 / d).sum(1, keepdims=True)), 0.2 * tau)
    return tau


def admm_large(weights: DataFrame, edges: DataFrame, k: int, penalty: float = 0.25, rho: float = 0.25, rounds: int = 60, tol: float = 1e-5, inner: int = 20, block: int = 40_000, hub: int = 1000, held: int = 200_000) -> DataFrame:
    """(node, prior) as admm() gives them at its end, for components of any size: consensus ADMM over blocks of edges.

    weights: (node, w: gamma); edges: (src, tgt, weight), each once. Each edge holds a copy of the priors at its ends, pulled
    together by soft thresholding; each node solves its likelihood against its copies. A block, which is one row, does that
    `inner` times in a task. Nodes of several blocks (ends of cut edges, hubs) have a copy and an equal share of the likelihood
    in each, and after a round only these are averaged. It ends when neither the priors nor the copies move by more than
    tol, or after `rounds`. A step is doubled or halved if one of the two moves far more than the other.
    """
    dealt = materialise(_blocks(edges.select("src", "tgt", "weight").where("src <> tgt"), block, hub, held), "admm-edges")
    copies = dealt.select("part", F.explode(F.array("src", "tgt")).alias("node")).distinct()
    times = copies.groupBy("node").agg(F.count("*").alias("times"))
    places = materialise(copies.join(times, "node").join(weights.select("node", "w"), "node"), "admm-nodes")
    parts = (dealt.agg(F.max("part")).first()[0] or 0) + 1
    arrays = ("w", "times", "weight", "tau", "mean", "pull", "z", "u")  # rows of nodes or edges, flattened
    schema = "part long, node array<long>, src array<int>, tgt array<int>, " + ", ".join(f"{c} array<double>" for c in arrays) + ", moved double, apart double, copies_moved double, copies_apart double"

    def begin(nodes: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        ids, w = nodes["node"].to_numpy(), np.array(nodes["w"].to_list()).reshape(-1, k)
        src, tgt = (np.searchsorted(ids, e[c].to_numpy()) for c in ("src", "tgt"))
        tau = np.maximum(w / w.sum(1, keepdims=True), 1e-2)
        z = np.concatenate([tau[src], tau[tgt]])
        row = {"part": nodes["part"].iloc[0], "node": ids, "src": src, "tgt": tgt, "w": w, "times": nodes["times"].to_numpy(float), "weight": e["weight"].to_numpy(float), "tau": tau, "mean": tau, "pull": 0 * tau, "z": z, "u": 0 * z}
        return pd.DataFrame([{c: v.ravel() if isinstance(v, np.ndarray) else v for c, v in row.items()} | {c: 0.0 for c in ("moved", "apart", "copies_moved", "copies_apart")}])

    def step(rho: float, across: float, grow: float, grow_across: float):
        def one(r: dict) -> dict:
            w, tau, mean, pull, z, u = (np.array(r[c]).reshape(-1, k) for c in ("w", "tau", "mean", "pull", "z", "u"))
            src, tgt, times, weight = (np.array(r[c]) for c in ("src", "tgt", "times", "weight"))
            shared, share, logs, ends = times > 1, (1 / times)[:, None], dirichlet_expectation(w), np.concatenate([src, tgt])
            r["copies_moved"] = r["copies_apart"] = 0.0
            if r["at"] is not None and len(r["at"]):  # what the last round's copies have in common
                found = np.searchsorted(r["node"], r["at"])
                new = mean.copy()
                new[found] = np.array(list(r["to"])).reshape(-1, k)
                r["copies_moved"], r["copies_apart"] = float(np.abs(new - mean)[shared].max()), float(np.abs(tau - new)[shared].max())
                pull, mean = np.where(shared[:, None], pull + tau - new, 0.0), new
            pull, u = pull / grow_across, u / grow
            total = (rho * np.bincount(ends, minlength=len(tau)) + across * shared)[:, None]
            for _ in range(inner):
                sums = np.stack([np.bincount(ends, (z - u)[:, i], len(tau)) for i in range(k)], 1)
                tau = _newton_steps((rho * sums + across * shared[:, None] * (mean - pull)) / total, total, tau, logs, share)
                ahead = 1.6 * tau[ends] - 0.6 * z + u  # over-relaxed
                a, b = ahead[: len(src)], ahead[len(src) :]
                half = np.sign(a - b) * np.maximum(np.abs(a - b) - 2 * penalty / rho * weight[:, None], 0) / 2
                new = np.concatenate([(a + b) / 2 + half, (a + b) / 2 - half])
                r["moved"], r["apart"] = float(np.abs(new - z).max(initial=0)), float(np.abs(new - tau[ends]).max(initial=0))
                z, u = new, ahead - new
                if max(r["moved"], r["apart"]) <= tol / 4:
                    break
            return {c: v for c, v in r.items() if c not in ("at", "to")} | {c: v.ravel() for c, v in (("tau", tau), ("mean", mean), ("pull", pull), ("z", z), ("u", u))}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    yield pd.DataFrame([one(r)])

        return run

    blocks = materialise(places.groupBy("part").cogroup(dealt.groupBy("part")).applyInPandas(begin, schema), "admm-blocks")
    means, grow, across, grow_across = None, 1.0, 16 * rho, 1.0
    several = F.filter(F.arrays_zip("node", "times", F.sequence(F.lit(0), F.size("node") - 1).alias("i")), lambda v: v["times"] > 1)
    for it in range(rounds):
        asked = blocks.withColumns({"at": F.lit(None).cast("array<long>"), "to": F.lit(None).cast("array<array<double>>")}) if means is None else blocks.join(means, "part", "left")
        new = materialise(asked.repartitionById(parts, F.col("part").cast("int")).mapInPandas(step(rho, across, grow, grow_across), schema), "admm-blocks")
        release(blocks)
        blocks = new
        found = blocks.agg(*[F.max(c).alias(c) for c in ("moved", "apart", "copies_moved", "copies_apart")]).first()
        if max(found) <= tol and it:
            break
        each = blocks.select("part", "tau", "pull", F.explode(several).alias("v")).select("part", "v.node", *[(F.get("tau", F.col("v.i") * k + i) + F.get("pull", F.col("v.i") * k + i)).alias(f"m{i}") for i in range(k)])
        pooled = each.groupBy("node").agg(*[F.avg(f"m{i}").alias(f"m{i}") for i in range(k)])
        means = each.select("part", "node").join(pooled, "node").groupBy("part").agg(F.collect_list(F.struct("node", F.array(*[f"m{i}" for i in range(k)]).alias("to"))).alias("v")).select("part", F.col("v.node").alias("at"), F.col("v.to").alias("to"))
        ratio = lambda moved, apart, step: 2.0 if apart > 4 * step * moved else 0.5 if step * moved > 4 * apart else 1.0
        grow = ratio(found["moved"], found["apart"], rho)
        grow_across = ratio(found["copies_moved"], found["copies_apart"], across) if it > 1 else 1.0
        rho, across = rho * grow, across * grow_across
    rows = blocks.select("tau", F.posexplode("node").alias("i", "node")).select("node", *[F.get("tau", F.col("i") * k + i).alias(f"t{i}") for i in range(k)])
    out = rows.groupBy("node").agg(F.array(*[F.greatest(F.avg(f"t{i}"), F.lit(1e-3)) for i in range(k)]).alias("prior"))
    out = materialise(out, "admm-priors")
    release(blocks)
    return out


def update_priors(weights: DataFrame, edges: DataFrame, sample: str, doc: str, k: int, largest: int = 10_000, **options) -> DataFrame:
    """(sample, doc, prior) from (sample, doc, w: gamma) and (sample, src, tgt, weight).

    The problem falls apart into the connected components of the samples' graphs: those of up to `largest` documents are
    solved in tasks, packed by size; larger ones as rows (admm_large). No sample has to fit a task.
    """
    nodes = materialise(weights.select(F.struct(F.col(sample), F.col(doc)).alias("key"), "w"), "spatial-nodes")
    names = materialise(number_rows(nodes.select("key"), "key", name="node"), "spatial-names")
    end = lambda e: names.select(F.col("node").alias(f"n_{e}"), F.col(f"key.{sample}").alias(sample), F.col(f"key.{doc}").alias(e))
    own = edges.join(end("src"), [sample, "src"]).join(end("tgt"), [sample, "tgt"]).select(F.col("n_src").alias("src"), F.col("n_tgt").alias("tgt"), "weight")
    own = materialise(graph.undirected(own), "spatial-edges")
    roots = materialise(graph.component_of(own, names), "spatial-roots")
    sizes = materialise(roots.groupBy("root").count(), "spatial-sizes")
    parts = graph.packed(sizes.where(F.col("count") <= largest), largest)
    gamma = materialise(nodes.join(names, "key").select("node", "w"), "spatial-gamma")
    held = materialise(gamma.join(roots, "node").join(parts, "root").select("part", "root", "node", "w"), "spatial-held")
    linked = own.join(held.select(F.col("node").alias("src"), "part", "root"), "src").select("part", "root", "src", "tgt", "weight")
    linked = materialise(linked, "spatial-linked")

    def run(pdf: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": np.zeros(0, np.int64), "prior": []})]
        by = dict(tuple(e.groupby("root"))) if len(e) else {}
        for root, own in pdf.sort_values("node").groupby("root"):
            ids, g, pairs = own["node"].to_numpy(), np.array(own["w"].to_list()).reshape(-1, k), by.get(root, e.iloc[:0])
            at = [np.searchsorted(ids, pairs[c].to_numpy()) for c in ("src", "tgt")]
            out.append(pd.DataFrame({"node": ids, "prior": list(admm(g, *at, pairs["weight"].to_numpy(float), **options))}))
        return pd.concat(out)

    found = held.groupBy("part").cogroup(linked.groupBy("part")).applyInPandas(run, "node long, prior array<double>")
    big = sizes.where(F.col("count") > largest).select("root")
    if big.take(1):
        rest = materialise(roots.join(big, "root").select("node"), "spatial-rest")
        apart = admm_large(gamma.join(rest, "node"), own.join(rest.withColumnRenamed("node", "src"), "src"), k, **{c: v for c, v in options.items() if c == "penalty"})
        found = found.unionByName(apart)
    return names.join(found, "node").select(F.col(f"key.{sample}").alias(sample), F.col(f"key.{doc}").alias(doc), "prior")


def train(sparse: DataFrame, edges: DataFrame, k: int, p: int, sample: str = "sample_id", doc: str = "doc_id", rounds: int = 3, lda_rounds: int = 5, spatial: bool = True, seed: int = 0, **options) -> SpatialLda:
    """Alternates LDA with per-document priors and their update along each sample's edges; the last priors are used.

    sparse: (sample, doc, idx, val), ids unique over samples; edges: (sample, src, tgt, weight). spatial False: priors stay as they are.
    """
    docs = materialise(lda.with_prior(sparse.select(sample, doc, "idx", "val"), k), "spatial-docs")
    model = lda.start(k, p, seed=seed)
    for _ in range(rounds):
        model = lda.fit(docs, k, p, lda_rounds, model)
        if spatial:
            docs = infer_priors(model, docs, edges, k, sample, doc, **options)
    model = lda.fit(docs, k, p, lda_rounds, model)
    return SpatialLda(model, docs.select(doc, "prior"), materialise(model.transform(docs, doc), "spatial-w"))


def infer_priors(model: lda.Lda, docs: DataFrame, edges: DataFrame, k: int, sample: str, doc: str, **options) -> DataFrame:
    gamma = model.transform(docs, doc, normal=False).join(docs.select(sample, doc), doc)
    priors = update_priors(gamma, edges, sample, doc, k, **options)
    return materialise(docs.drop("prior").join(priors.select(doc, "prior"), doc), "spatial-docs")


def infer(model: lda.Lda, sparse: DataFrame, edges: DataFrame, k: int, sample: str = "sample_id", doc: str = "doc_id", rounds: int = 3, **options) -> DataFrame:
    """(doc, w) of new documents under fixed topics."""
    docs = lda.with_prior(sparse.select(sample, doc, "idx", "val"), k)
    for _ in range(rounds):
        docs = infer_priors(model, docs, edges, k, sample, doc, **options)
    return model.transform(docs, doc)
