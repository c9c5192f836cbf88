"""Whole analyses: preprocessing, all methods on one input, choice of K by fold stability, outcome tables, simulations."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import linalg
from loomgraph.functions.simplex import argmax
from loomgraph.operators import align, graph, lda, metrics, simulate, spatial_lda, topicscore
from loomgraph.operators import counts as C
from loomgraph.operators.running import number_rows
from loomgraph.plans.model import GraphTopics
from loomgraph.shared import materialise

METHODS = ("plain", "graph", "lda", "spatial_lda", "topicscore")


def preprocess_regions(counts: DataFrame, coords: DataFrame, edges: DataFrame, least: int = 10, phi: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts, unit coordinates and weighted edges of the cells kept, with one node id, {region_id}:{cell_id}."""
    counts, coords, edges = C.prune_regions(counts, coords, edges, least)
    node = lambda c: F.concat_ws(":", "region_id", c)
    coords = graph.unit_square(coords.select(node("cell_id").alias("node"), "region_id", "x", "y"))
    pairs = edges.select(node("src").alias("src"), node("tgt").alias("tgt"))
    return counts.select(node("cell_id").alias("doc_id"), "region_id", "term", "n"), coords, graph.exp_weights(graph.undirected(pairs), coords, phi)


def preprocess_baskets(baskets: DataFrame, mapping: DataFrame, neighbours: DataFrame, cap: int = 2000, least: int = 10, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Counts and unit-weight edges of baskets (basket_id, group, tokens).

    At most `cap` baskets of a group by a hash of their id, canonical tokens (mapping: key, value; a side table joined on
    the token), rare terms and short baskets out, then the nearest baskets in neighbouring groups (group, other).
    """
    kept = C.balanced(baskets, "group", cap, F.xxhash64("basket_id", F.lit(1)), "basket_id")
    one = mapping.groupBy(F.col("value").alias("term")).agg(F.max("key").alias("key"))
    words = kept.select(F.col("basket_id").alias("doc_id"), "group", F.explode("tokens").alias("term")).join(one, "term", "left")
    counts = words.select("doc_id", "group", F.lower(F.coalesce("key", "term")).alias("term")).groupBy("doc_id", "group", "term").agg(F.count("*").alias("n"))
    counts = materialise(C.filter_both(counts, least, least), "baskets")
    size = counts.agg(F.countDistinct("term")).first()[0]
    items = counts.select(F.col("doc_id").alias("node"), F.col("term").alias("token"), "group")
    edges = graph.undirected(graph.shared_counts(items, size, top, neighbours).select("src", "tgt"))
    return counts.select("doc_id", "term", "n"), edges.withColumn("weight", F.lit(1.0))


def fit_method(method: str, counts: DataFrame, edges: DataFrame | None, k: int, sample: DataFrame | None = None, most_terms: int = 4000, **options) -> tuple[DataFrame, np.ndarray, DataFrame, float]:
    """(doc, w), K x p topics, the vocabulary, and seconds. sample: (doc_id, sample_id) for the spatial LDA; one sample by default.

    More than `most_terms` terms are an error ("plain" and "graph" have a bound of their own): topics are held on the driver.
    """
    began = time.time()
    if method in ("plain", "graph"):
        m = GraphTopics(k, method, **options).fit(counts, edges)
        return m.w, m.a, m.vocab, time.time() - began
    counts = materialise(counts, "counts")
    vocab = C.whole_vocabulary(counts, most_terms)
    if method == "topicscore":
        w, a = topicscore.fit(C.normalise(counts), vocab, k, **options)
        return materialise(w, "w"), a, vocab, time.time() - began
    rows = materialise(linalg.rows(counts.withColumn("x", F.col("n").cast("double")), vocab), "counts")
    if method == "lda":
        docs = lda.with_prior(rows, k)
        model = lda.fit(docs, k, vocab.count(), **options)
        return materialise(model.transform(docs), "w"), model.topics, vocab, time.time() - began
    named = rows.withColumn("sample_id", F.lit("all")) if sample is None else rows.join(sample, "doc_id")
    own = edges.withColumn("sample_id", F.lit("all")) if sample is None else edges.join(sample.withColumnRenamed("doc_id", "src"), "src")
    s = spatial_lda.train(named, own.select("sample_id", "src", "tgt", "weight"), k, vocab.count(), **options)
    return s.w, s.model.topics, vocab, time.time() - began


def preprocess_samples(counts: DataFrame, coords: DataFrame, edges: DataFrame, phi: float = 0.1, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (doc_id, sample_id, term, n), coordinates and weighted edges of many samples with one node id, {sample_id}:{node}.

    Each sample's coordinates fill its own unit square, weights are exp(-phi d^2) within it. Cells with less than `least`
    counts, and edges between samples or to cells that are not there, go.
    """
    key = ["sample_id", "node"]
    total = counts.groupBy(*key).agg(F.sum("n").alias("total")).where(F.col("total") >= least).select(*key)
    square = graph.unit_square(coords, ("sample_id",)).join(total, key, "left_semi")
    name = lambda c: F.concat_ws(":", "sample_id", c)
    square = materialise(square.select(name("node").alias("node"), "sample_id", "x", "y"), "sample-coords")
    pairs = graph.undirected(edges.select(name("src").alias("src"), name("tgt").alias("tgt")))
    kept = counts.join(total, key, "left_semi").select(name("node").alias("doc_id"), "sample_id", "term", "n")
    return kept, square, graph.exp_weights(pairs, square, phi)


def analyse_samples(counts: DataFrame, coords: DataFrame, edges: DataFrame, k: int, methods: tuple[str, ...] = METHODS, **options: dict) -> tuple[DataFrame, DataFrame]:
    """One model of each method over all samples' graphs: (method, sample_id, doc_id, w), and (method, sample_id, metric, value).

    counts, coords, edges: as from preprocess_samples(). Metrics of a sample: Moran's I, PAS and CHAOS of the heaviest
    topics, from its own cells and edges; null where a sample has no edge, or one topic only.
    """
    spark = counts.sparkSession
    samples = counts.select("doc_id", "sample_id").distinct()
    numbered = number_rows(coords.select("sample_id").distinct(), "sample_id", name="place")
    # samples lie side by side, farther apart than any two cells of one
    apart = coords.join(numbered, "sample_id").withColumn("x", F.col("x") + 3 * F.col("place"))
    near = graph.nearest(apart, 1)
    own = coords.select("node", "sample_id")
    near = materialise(graph.with_ends(near, own, "sample_id").where("sample_id_src = sample_id_tgt").select(F.col("sample_id_src").alias("sample_id"), "src", "tgt", "distance"), "sample-near")
    linked = materialise(edges.join(own.withColumnRenamed("node", "src"), "src"), "sample-edges")
    outs, rows = [], []
    for method in methods:
        extra = options.get(method, {}) | ({"sample": samples} if method == "spatial_lda" else {})
        w = fit_method(method, counts.select("doc_id", "term", "n"), edges, k, **extra)[0]
        outs.append(w.join(samples, "doc_id").select(F.lit(method).alias("method"), "sample_id", "doc_id", "w"))
        topics = materialise(w.select(F.col("doc_id").alias("node"), argmax(F.col("w")).alias("topic")).join(own, "node"), "sample-topics")
        rows.append(metrics.by_sample(topics, linked, near).select(F.lit(method).alias("method"), "sample_id", "metric", "value"))
    return reduce(DataFrame.unionByName, outs), reduce(DataFrame.unionByName, rows)


def compare(counts: DataFrame, edges: DataFrame, k: int, coords: DataFrame | None = None, methods: tuple[str, ...] = METHODS, **options: dict) -> DataFrame:
    """(method, k, metric, value): seconds, Moran's I, PAS and CHAOS of each method's heaviest topics."""
    spark, rows = counts.sparkSession, []
    near = graph.nearest(coords, 1) if coords is not None else None
    for method in methods:
        w, _, _, seconds = fit_method(method, counts, edges, k, **options.get(method, {}))
        topics = materialise(w.select(F.col("doc_id").alias("node"), argmax(F.col("w")).alias("topic")), "topics")
        found = {"seconds": seconds, "moran": metrics.moran(topics, edges).first()["moran"], "pas": metrics.pas(topics, edges).first()["pas"]}
        if near is not None:
            found["chaos"] = metrics.chaos(topics, near).first()["chaos"]
        rows += [(method, k, m, None if v is None else float(v)) for m, v in found.items()]
    return spark.createDataFrame(rows, "method string, k int, metric string, value double")


def choose_k(counts: DataFrame, edges: DataFrame, units: DataFrame, ks: list[int], folds: int = 5, method: str = "plain", fit: Callable | None = None, most_terms: int = 4000, **options) -> DataFrame:
    """(k, a, b, l1_dist, cos_sim, cos_sim_ratio) of each pair of folds: topics fitted on different regions should agree.

    units: (doc_id, region_id); regions are dealt into folds. Fits of different folds run as concurrent jobs.
    """
    spark = counts.sparkSession
    dealt = materialise(units.join(graph.random_folds(units.select(F.col("region_id").alias("node")).distinct(), folds).withColumnRenamed("node", "region_id"), "region_id").select("doc_id", "fold"), "fold-units")
    terms = [r["term"] for r in C.whole_vocabulary(counts, most_terms).orderBy("term").collect()]
    place = {t: i for i, t in enumerate(terms)}

    def one(k: int, f: int) -> np.ndarray | None:
        docs = dealt.where(F.col("fold") == f).select("doc_id")
        own = materialise(counts.join(docs, "doc_id", "left_semi"), "fold-counts")
        if own.select("doc_id").distinct().limit(k + 1).count() <= k:
            return None
        mine = C.semi_edges(edges, docs.select(F.col("doc_id").alias("node")))
        _, a, vocab, _ = (fit or fit_method)(method, own, mine, k, **options)
        out = np.zeros((k, len(terms)))
        for r in vocab.collect():
            out[:, place[r["term"]]] = a[:, r["term_id"]]
        return out

    rows = []
    with ThreadPoolExecutor(min(4, folds)) as pool:
        for k in ks:
            models = list(pool.map(lambda f, k=k: one(k, f), range(folds)))
            for a, b in combinations(range(folds), 2):
                if models[a] is not None and models[b] is not None:
                    rows.append((k, a, b, *align.stability(models[a], models[b]).values()))
    return spark.createDataFrame(rows, "k int, a int, b int, l1_dist double, cos_sim double, cos_sim_ratio double")


def align_models(counts: DataFrame, edges: DataFrame, ks: list[int], methods: tuple[str, ...] = ("graph", "plain"), main: str = "graph", most_terms: int = 4000, **options: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Factors of all methods and K in one order of topics: (method, k, doc_id, w), (method, k, topic, term, a), (method, k, paths, broken).

    Topics of the main method follow those of the K before; at each K, the other methods follow the main one. The third
    table counts, for each method, the paths of topics that go on from one K to the next, and those that break.
    """
    if main not in methods:
        raise ValueError(f"{main} is not among the methods")
    spark, ks = counts.sparkSession, sorted(set(ks))
    terms = [r["term"] for r in C.whole_vocabulary(counts, most_terms).orderBy("term").collect()]
    place, weights, models = {t: i for i, t in enumerate(terms)}, {}, {}
    for m in methods:
        for k in ks:
            weights[m, k], a, vocab, _ = fit_method(m, counts, edges, k, **options.get(m, {}))
            models[m, k] = np.zeros((k, len(terms)))
            for r in vocab.collect():
                models[m, k][:, place[r["term"]]] = a[:, r["term_id"]]
    orders = {(main, k): o for k, o in zip(ks, align.consistent_orders([models[main, k] for k in ks]), strict=True)}
    for m, k in models:
        if m != main:
            match = align.mapping(models[m, k], models[main, k][orders[main, k]])
            orders[m, k] = [int(match[:, j].argmax()) for j in range(k)]
    w = reduce(DataFrame.unionByName, [d.select(F.lit(m).alias("method"), F.lit(k).alias("k"), "doc_id", F.array(*[F.col("w")[old] for old in orders[m, k]]).alias("w")) for (m, k), d in weights.items()])
    rows = [(m, k, i, terms[j], float(models[m, k][old, j])) for (m, k), o in orders.items() for i, old in enumerate(o) for j in range(len(terms))]
    paths = [(m, r["k"], r["paths"], r["broken"]) for m in methods for r in align.topic_paths([models[m, k] for k in ks])]
    return w, spark.createDataFrame(rows, "method string, k int, topic int, term string, a double"), spark.createDataFrame(paths, "method string, k int, paths int, broken int")


def survival_table(topics: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """(region_id, Topic0.., outcome columns): shares of the heaviest topics of each region, joined with its outcome."""
    return metrics.shares(topics, "region_id", "topic", list(range(k))).join(meta, "region_id")


def simulate_trial(spark: SparkSession, N: int, n: int, K: int, p: int, seed: int = 0, methods: tuple[str, ...] = ("plain", "graph"), noise: float = 0.05, neighbours: int = 5, phi: float = 0.1, clusters: int = 30, strong: bool = False, **options: dict) -> DataFrame:  # noqa: N803
    """(method, metric, value) of one synthetic corpus: errors of W and A after alignment, accuracy, seconds, jump size."""
    nodes = materialise(simulate.topic_weights(simulate.points(spark, n, K, clusters, seed), K, noise, seed, strong), "simulated")
    a = simulate.topics(K, p, seed)
    counts = materialise(simulate.draw_counts(nodes, a, N, seed).withColumnRenamed("node", "doc_id"), "simulated-counts")
    edges = materialise(graph.undirected(graph.rbf_graph(nodes.select("node", "x", "y"), neighbours, phi)), "simulated-edges")
    truth = nodes.select("node", F.posexplode("w").alias("topic", "w"))
    rows = [("data", "jump", graph.jump(edges, nodes.select("node", F.col("w").alias("v"))).first()["jump"])]
    for method in methods:
        w, found, vocab, seconds = fit_method(method, counts, edges, K, **options.get(method, {}))
        own = np.zeros((K, p))
        for r in vocab.collect():
            own[:, int(r["term"][1:])] = found[:, r["term_id"]]
        order = align.mapping(own, a).argmax(1)  # own topic -> true topic
        to = F.create_map(*[F.lit(int(x)) for i, t in enumerate(order) for x in (i, t)])
        long = w.select(F.col("doc_id").alias("node"), F.posexplode("w").alias("_t", "w")).select("node", to[F.col("_t")].alias("topic"), "w")
        e = metrics.factor_errors(truth, long, "node", "topic").first()
        hit = w.join(nodes.select(F.col("node").alias("doc_id"), "grp"), "doc_id").agg(metrics.accuracy(to[argmax(F.col("w"))], F.col("grp")).alias("acc")).first()["acc"]
        matched = align.aligned(own, a)
        rows += [(method, "err", e["frobenius"]), (method, "l1_err", e["l1"]), (method, "acc", hit), (method, "time", seconds), (method, "A_err", float(np.linalg.norm(matched - a))), (method, "A_l1_err", float(np.abs(matched - a).sum()))]
    return spark.createDataFrame([(m, x, float(v)) for m, x, v in rows], "method string, metric string, value double")


def simulate_grid(spark: SparkSession, grid: DataFrame, task_id: int, start_seed: int = 50, trials: int | None = None, **options) -> DataFrame:
    """(task_id, trial, length, n, K, p, method, metric, value) of one row of the parameter grid."""
    g = grid.where(F.col("task_id") == task_id).first()
    if g is None:
        raise ValueError(f"the grid has no task {task_id}")
    outs = []
    for t in range(g["nsim"] if trials is None else trials):
        r = simulate_trial(spark, g["length"], g["n"], g["K"], g["p"], start_seed + t, **options)
        outs.append(r.select(F.lit(task_id).alias("task_id"), F.lit(t).alias("trial"), *[F.lit(g[c]).alias(c) for c in ("length", "n", "K", "p")], "method", "metric", "value"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out
