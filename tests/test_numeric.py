"""Kernels and models against independent dense computations, identities and hand-made graphs."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import linalg, simplex, special
from loomgraph.operators import align, fusion, graph, lda, metrics, simulate, spatial_lda, survival, topicscore
from loomgraph.operators import counts as C
from loomgraph.plans import pipelines
from loomgraph.plans.model import GraphTopics, anchors

# special functions and small solvers


def test_digamma_and_trigamma_by_differences_of_gammaln():
    x = np.array([0.05, 0.3, 1.0, 2.5, 7.0, 40.0])
    h = 1e-5 * np.maximum(x, 0.1)
    assert np.allclose(special.digamma(x), (special.gammaln(x + h) - special.gammaln(x - h)) / (2 * h), rtol=1e-6)
    assert np.allclose(special.trigamma(x), (special.digamma(x + h) - special.digamma(x - h)) / (2 * h), rtol=1e-5)
    assert math.isclose(float(special.digamma(np.array(1.0))), -0.5772156649015329, rel_tol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_the_cheapest(n, m, seed):
    cost = np.random.default_rng(seed).integers(-5, 9, (n, m)).astype(float)
    got = special.assignment(cost)
    small, wide = (cost, False) if n <= m else (cost.T, True)
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert len(got) == min(n, m) and math.isclose(sum(cost[i, j] for i, j in got), best) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    del wide


def test_ellipsoid_holds_the_points_and_is_tight():
    pts = np.random.default_rng(0).normal(size=(200, 3)) * [3, 1, 0.2]
    q = special.ellipsoid(pts, steps=20_000, tol=1e-4)
    r = np.linalg.norm(pts @ q.T, axis=1)
    assert r.max() < 1.001 and (r > 0.99).sum() >= 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=1, max_size=6))
def test_simplex_projection_is_optimal(w):
    a = np.array([w])
    p = simplex.project_rows(a)[0]
    assert (p >= 0).all() and math.isclose(p.sum(), 1, abs_tol=1e-9)
    assert np.allclose(simplex.project_rows(p[None])[0], p)
    theta = (a[0] - p)[p > 1e-12]
    assert np.allclose(theta, theta[0]) and (a[0][p <= 1e-12] <= theta[0] + 1e-9).all()  # KKT


def test_simplex_projection_column_equals_numpy(spark):
    rows = np.random.default_rng(1).normal(size=(50, 4)).round(3)
    got = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i int, w array<double>").select("i", simplex.project(F.col("w")).alias("p")).orderBy("i").collect()
    assert np.allclose([r["p"] for r in got], simplex.project_rows(rows))


def test_log_ratio_bases():
    b = simplex.ilr_basis(5)
    assert np.allclose(b.T @ b, np.eye(4)) and np.allclose(b.sum(0), 0)
    z = np.array([0.3, -1.0, 0.2, 0.0])
    assert np.allclose(simplex.from_ilr(z) @ b, z)


# fusion


def chain(n):
    return np.arange(n - 1), np.arange(1, n)


def test_fusion_extremes_and_gap():
    rng = np.random.default_rng(0)
    y, (s, t) = rng.normal(size=(30, 2)), chain(30)
    w = np.ones(29)
    assert np.allclose(fusion.solve(y, s, t, w, 0.0)[0], y)
    u, _, gap = fusion.solve(y, s, t, w, 100.0, most=20_000)
    assert gap < 1e-6 and np.abs(u - y.mean(0)).max() < 0.02
    for l2 in (True, False):
        u, z, gap = fusion.solve(y, s, t, w, 0.3, l2=l2, tol=1e-9, most=20_000)
        d = u[s] - u[t]
        best = 0.5 * ((u - y) ** 2).sum() + 0.3 * (np.linalg.norm(d, axis=1).sum() if l2 else np.abs(d).sum())
        for _ in range(200):
            v = u + rng.normal(0, 0.01, u.shape)
            e = v[s] - v[t]
            assert 0.5 * ((v - y) ** 2).sum() + 0.3 * (np.linalg.norm(e, axis=1).sum() if l2 else np.abs(e).sum()) >= best - 1e-6
        assert gap < 1e-9


def test_fusion_large_equals_local(spark):
    rng = np.random.default_rng(2)
    y, (s, t) = rng.normal(size=(12, 2)), chain(12)
    want = fusion.solve(y, s, t, np.ones(11), 0.2, tol=1e-10, most=20_000)[0]
    nodes = spark.createDataFrame([(i, y[i].tolist()) for i in range(12)], "node long, y array<double>")
    edges = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(s, t, strict=True)], "src long, tgt long, weight double")
    cases = nodes.selectExpr("0 AS case", "*").unionByName(nodes.selectExpr("1 AS case", "*"))
    got = fusion.solve_large(cases, edges, [0.2, 0.0], 2, tol=1e-4).orderBy("case", "node").collect()
    assert np.abs(np.array([r["u"] for r in got[:12]]) - want).max() < 0.02 and np.allclose([r["u"] for r in got[12:]], y)
    with pytest.raises(RuntimeError):
        fusion.solve_large(cases, edges, [0.2, 0.0], 2, tol=1e-12, most=2)


def test_the_size_of_a_component_changes_nothing(spark):
    """One component solved as rows gives the lambdas, errors and topics of one solved in a task."""
    from loomgraph.plans.model import GraphTopics

    rng = np.random.default_rng(5)
    rows = [(i, f"t{j}", int(c)) for i in range(24) for j, c in enumerate(rng.poisson(np.where(np.arange(6) // 3 == i // 12, 9, 2)) + 1)]
    counts = spark.createDataFrame(rows, "doc_id long, term string, n long")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(23)], "src long, tgt long, weight double")
    one, other = (GraphTopics(k=2, method="graph", grid=2, lam_start=0.01, step=8.0, folds=2, rounds=1, largest=n).fit(counts, edges) for n in (10**6, 1))
    assert one.lambdas == other.lambdas and len(one.errors) == len(other.errors)
    assert np.allclose(one.errors[0]["totals"], other.errors[0]["totals"], rtol=1e-3) and min(one.errors[0]["totals"]) > 0
    assert np.allclose(one.values, other.values, rtol=1e-4) and np.allclose(one.a, other.a, atol=1e-3)


# graphs by hand


@pytest.fixture(scope="module")
def path5(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0, t) for i, t in enumerate([0, 0, 1, 1, 0])], "node long, x double, y double, topic int")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "src long, tgt long, weight double")
    return nodes, edges


def test_smoothness_by_hand(path5, spark):
    nodes, edges = path5
    z = np.array([0, 0, 1, 1, 0]) - 0.4
    want = 5 * (z[:-1] * z[1:]).sum() / ((z**2).sum() * 4)
    assert math.isclose(metrics.moran(nodes, edges).first()["moran"], want)
    local = {r["node"]: r["moran"] for r in metrics.moran_local(nodes, edges).collect()}
    assert math.isclose(sum(local.values()) / 4, want)
    # mismatch: edges 1-2 and 3-4; src rates 0,1,0,1; tgt rates 0,1,0,1 -> nodes 0: 0, 1: 1, 2: 1, 3: 1, 4: 1
    assert math.isclose(metrics.pas(nodes, edges).first()["pas"], 1 - 4 / 5)
    assert math.isclose(metrics.chaos(nodes, graph.nearest(nodes, 1)).first()["chaos"], 1 - 3 / 5)
    assert metrics.moran(nodes.withColumn("topic", F.lit(1)), edges).first()["moran"] is None


def test_folds_components_and_self_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (8, 7), (5, 5)], "src long, tgt long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 7, 8)], "node long")
    got = {r["node"]: (r["root"], r["hop"]) for r in graph.tree_folds(graph.undirected(edges), nodes).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 1), 5: (5, 0), 7: (7, 0), 8: (7, 1)}
    sizes = [r["count"] for r in graph.random_folds(spark.range(1000).withColumnRenamed("id", "node"), 4).groupBy("fold").count().collect()]
    assert sum(sizes) == 1000 and min(sizes) > 180


def test_nearest_with_crowds_gaps_and_ties(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([np.zeros((40, 2)), rng.random((60, 2)), [[50, 50], [50.0, 50.1]], [[0.5, 0.5], [0.5, 0.7], [0.7, 0.5]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "node long, x double, y double")
    for k in (1, 4):
        got: dict[int, list] = {}
        for r in graph.nearest(df, k).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append(r["tgt"])
        for i in range(len(xy)):
            d = np.round(np.hypot(*(xy - xy[i]).T), graph.DIGITS)
            assert got[i] == [j for _, j in sorted((d[j], j) for j in range(len(xy)) if j != i)][:k]
    assert graph.nearest(df.limit(0), 2).count() == 0 and graph.nearest(df.where("node = 1"), 2).count() == 0


def test_radius_join_equals_brute_force(spark):
    xy = np.random.default_rng(5).normal(size=(120, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "node long, x double, y double")
    got = {(r["anchor"], r["node"]) for r in graph.within_radius(df, df, 0.4).collect()}
    assert got == {(i, j) for i in range(120) for j in range(120) if ((xy[i] - xy[j]) ** 2).sum() <= 0.16}


def test_delaunay_holds_the_euclidean_tree_and_empty_circles():
    xy = np.random.default_rng(6).random((60, 2))
    pairs = graph.delaunay(xy[:, 0], xy[:, 1])
    every = [(float(np.hypot(*(xy[i] - xy[j]))), i, j) for i in range(60) for j in range(i + 1, 60)]
    tree = {every[k][1:] for k in graph.spanning_tree(60, every)}
    assert tree <= pairs and 60 <= len(pairs) <= 3 * 60 - 6
    gabriel = {(i, j) for _, i, j in every if not any(((xy[k] - (xy[i] + xy[j]) / 2) ** 2).sum() < ((xy[i] - xy[j]) ** 2).sum() / 4 - 1e-12 for k in range(60) if k not in (i, j))}
    assert gabriel <= pairs
    assert graph.delaunay(np.array([0.0, 0.0, 1.0]), np.array([0.0, 0.0, 0.0])) == {(0, 1), (0, 2)}


@pytest.mark.parametrize("shape", ["even", "clusters"])
def test_tiled_delaunay_equals_one_task(spark, shape):
    """Over many tiles: an even sample; dense clusters far apart, a lone outlier, repeated places, and a second sample."""
    rng = np.random.default_rng(16)
    if shape == "even":
        xy = rng.random((700, 2))
    else:
        middles = np.repeat([[0, 0], [40, 3], [41, 3.2], [900, -700]], [300, 250, 100, 1], axis=0)
        xy = middles + rng.normal(0, 0.4, middles.shape)
        xy = np.concatenate([xy, xy[:3]])
    other = rng.random((90, 2)) * 50
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("b", i, float(x), float(y)) for i, (x, y) in enumerate(other)]
    odd = [("a", 9001, None, 1.0), ("a", 9002, 1.0, float("nan")), (None, 9003, 1.0, 1.0)]
    coords = spark.createDataFrame(rows + odd, "sample string, node long, x double, y double")
    got = [(r["sample"], r["src"], r["tgt"]) for r in graph.tiled_delaunay(coords, tile=48, fan=4).collect()]
    want = {(s, i, j) for s, p in (("a", xy), ("b", other)) for i, j in graph.delaunay(p[:, 0], p[:, 1])}
    assert len(got) == len(set(got)) and set(got) == want


def test_trees_of_wide_samples_equal_those_of_tasks(spark):
    rng = np.random.default_rng(17)
    rows = [(s, i, float(x), float(y)) for s, n in (("a", 260), ("b", 150), ("c", 20)) for i, (x, y) in enumerate(rng.random((n, 2)))]
    coords = spark.createDataFrame(rows, "sample_id string, node long, x double, y double")
    plain = lambda df: sorted((r["sample_id"], r["src"], r["tgt"], round(r["distance"], 12)) for r in df.collect())
    assert plain(graph.voronoi_graph(coords, largest=100, tile=64)) == plain(graph.voronoi_graph(coords))
    assert not graph.voronoi_graph(coords.limit(0)).count() and not graph.tiled_delaunay(coords.withColumnRenamed("sample_id", "sample").limit(0)).count()


def test_boruvka_equals_kruskal(spark):
    rng = np.random.default_rng(7)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (90, 2)) if a != b})
    rows = [(a, b, float(w)) for (a, b), w in zip(edges, rng.integers(1, 9, len(edges)), strict=True)]
    order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    want = {order[k][:2] for k in graph.spanning_tree(40, [(float(i), a, b) for i, (a, b, _) in enumerate(order)])}
    got = graph.spanning_forest(spark.createDataFrame(rows, "src long, tgt long, weight double")).collect()
    assert {(r["src"], r["tgt"]) for r in got} == want


# counts


def test_zero_rows_case_and_region_keys(spark):
    counts = spark.createDataFrame([(1, "Salt", 3), (1, "salt", 1), (2, "salt", 0)], "doc_id long, term string, n long")
    assert [tuple(r) for r in C.fold_case(counts).where("n > 0").collect()] == [(1, "salt", 4)]
    assert C.normalise(counts).select("doc_id").distinct().count() == 1
    counts = spark.createDataFrame([("a", 1, "t", 20), ("b", 1, "t", 2), ("b", 2, "t", 30)], "region_id string, cell_id long, term string, n long")
    coords = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 1, 0.0, 0.0), ("b", 2, 1.0, 1.0)], "region_id string, cell_id long, x double, y double")
    edges = spark.createDataFrame([("b", 1, 2), ("a", 1, 1)], "region_id string, src long, tgt long")
    c, xy, e = C.prune_regions(counts, coords, edges)
    assert c.count() == 2 and xy.count() == 2 and e.where("src <> tgt").count() == 0


# models


@pytest.fixture(scope="module")
def corpus(spark):
    nodes = simulate.topic_weights(simulate.points(spark, 300, 3, seed=1), 3, seed=1).cache()
    a = simulate.topics(3, 24, seed=1)
    counts = simulate.draw_counts(nodes, a, 60, seed=1).withColumnRenamed("node", "doc_id").cache()
    return nodes, a, counts


def dense(counts):
    pdf = counts.toPandas().pivot(index="doc_id", columns="term", values="n").fillna(0)
    return pdf / pdf.to_numpy().sum(1, keepdims=True)


def test_plain_model_against_dense_numpy(corpus):
    _, _, counts = corpus
    x = dense(counts)
    model = GraphTopics(3).fit(counts)
    u = np.linalg.svd(x.to_numpy(), full_matrices=False)[0][:, :3]
    ids, rows, q = [], [], np.eye(3)
    for _ in range(3):
        i = int(np.linalg.norm(u @ q, axis=1).argmax())
        ids.append(i)
        v = q @ u[i]
        q = q - np.outer(v, v @ q) / (v @ v)
        rows.append(u[i])
    assert model.anchors == [x.index[i] for i in ids]
    w = simplex.project_rows(u @ np.linalg.inv(np.array(rows)))
    got = {r["doc_id"]: r["w"] for r in model.w.collect()}
    assert np.allclose([got[i] for i in x.index], w, atol=1e-6)
    a = simplex.project_rows(np.linalg.inv(w.T @ w) @ w.T @ x.to_numpy())
    terms = [r["term"] for r in model.vocab.orderBy("term_id").collect()]
    assert np.allclose(model.a, a[:, [list(x.columns).index(t) for t in terms]], atol=1e-6)


def test_gram_and_cross_against_dense_numpy(corpus, spark):
    _, _, counts = corpus
    x = dense(counts)
    vocab = C.vocabulary(counts, 100)
    terms = [r["term"] for r in vocab.orderBy("term_id").collect()]
    m = x[terms].to_numpy()
    sparse = linalg.rows(C.normalise(counts), vocab)
    g, s, n = linalg.gram(sparse, len(terms))
    assert n == len(m) and np.allclose(g, m.T @ m) and np.allclose(s, m.sum(0))
    u = linalg.times(sparse, np.eye(len(terms))[:, :2])
    assert np.allclose(linalg.cross(sparse, u, len(terms), 2), m.T @ m[:, :2]) and np.allclose(linalg.small_gram(u, 2), m[:, :2].T @ m[:, :2])


def test_graph_model_beats_plain_on_short_documents(corpus):
    nodes, a, _ = corpus
    counts = simulate.draw_counts(nodes, a, 15, seed=1).withColumnRenamed("node", "doc_id").cache()
    edges = graph.undirected(graph.rbf_graph(nodes)).cache()
    truth = dict(nodes.select("node", "w").collect())
    errors = []
    for method, options in (("plain", {}), ("graph", {"grid": 12, "step": 2.0, "rounds": 2})):
        w, found, vocab, _ = pipelines.fit_method(method, counts, edges, 3, **options)
        full = np.zeros((3, 24))
        full[:, [int(r["term"][1:]) for r in vocab.orderBy("term_id").collect()]] = found
        p = align.mapping(full, a)
        errors.append((sum(np.abs(np.array(r["w"]) @ p - truth[r["doc_id"]]).sum() for r in w.collect()), np.abs(align.aligned(full, a) - a).sum()))
    assert errors[1][0] < errors[0][0] and errors[1][1] < errors[0][1]


def test_fixed_lambda_is_honoured_and_zero_leaves_the_plain_span(corpus):
    nodes, _, counts = corpus
    edges = graph.undirected(graph.rbf_graph(nodes))
    m = GraphTopics(3, "graph", lam=0.01, rounds=1).fit(counts, edges)
    assert m.lambdas == [0.01] and m.errors == []
    with pytest.raises(ValueError):
        GraphTopics(3, "graph").fit(counts)


def test_anchor_ties_go_to_the_smallest_id(spark):
    u = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 0.5])], "doc_id long, u array<double>")
    assert anchors(u, 2)[0] == [2, 9]


def test_preconditioned_model_recovers_topics(corpus):
    _, a, counts = corpus
    m = GraphTopics(3, precondition=True).fit(counts)
    full = np.zeros((3, 24))
    full[:, [int(r["term"][1:]) for r in m.vocab.orderBy("term_id").collect()]] = m.a
    assert np.trace(align.unit_rows(align.aligned(full, a)) @ align.unit_rows(a).T) / 3 > 0.8


def test_lda_bound_rises_and_topics_recover(corpus):
    _, a, counts = corpus
    vocab = C.vocabulary(counts, 100).cache()
    docs = lda.with_prior(linalg.rows(counts.withColumn("x", F.col("n").cast("double")), vocab), 3).cache()
    model, bounds = lda.start(3, 24, seed=1), []
    for _ in range(4):
        bounds.append(model.bound(docs)[0])
        model = lda.fit(docs, 3, 24, 4, model)
    assert bounds == sorted(bounds) and 1 < model.perplexity(docs) < 24
    full = np.zeros((3, 24))
    full[:, [int(r["term"][1:]) for r in vocab.orderBy("term_id").collect()]] = model.topics
    assert np.trace(align.unit_rows(align.aligned(full, a)) @ align.unit_rows(a).T) / 3 > 0.85
    online = lda.start(3, 24, seed=1)
    for i in range(6):
        online = online.partial_fit(docs, i, 300)
    assert online.bound(docs)[0] > bounds[0]


def test_lda_prior_belongs_to_its_document():
    beta = np.full((2, 3), 1 / 3)
    g, _ = lda.e_step(np.array([0]), np.array([1.0]), np.array([50.0, 1.0]), beta)
    assert g[0] > 40 and math.isclose(g.sum(), 52, rel_tol=1e-6)


def test_lda_steps_of_many_documents_equal_single_ones():
    rng = np.random.default_rng(13)
    beta, counts, prior = rng.random((3, 7)), rng.integers(0, 4, (9, 7)).astype(float), rng.random((9, 3)) + 0.1
    many = lda.e_steps(counts, prior, beta)
    for i in range(9):
        own = np.flatnonzero(counts[i])
        assert np.allclose(many[i], lda.e_step(own, counts[i][own], prior[i], beta)[0], atol=1e-6)


def test_dirichlet_newton_reaches_a_stationary_point():
    rng = np.random.default_rng(8)
    r, logs = rng.random((6, 3)), special.dirichlet_expectation(rng.random((6, 3)) + 0.5)
    tau = spatial_lda.dirichlet_newton(r, logs, 1.0, np.ones((6, 3)), rounds=200)
    g = special.digamma(tau) - special.digamma(tau.sum(1, keepdims=True)) - logs + tau - r
    assert (np.abs(g) < 1e-4).all() | (tau <= 2e-3).any()


def test_spatial_priors_are_smoother_along_edges():
    rng = np.random.default_rng(9)
    g = rng.random((40, 3)) * 5 + 0.5
    s, t = chain(40)
    rough = lambda x: np.abs(x[s] - x[t]).sum()
    assert rough(spatial_lda.admm(g, s, t, np.ones(39), penalty=2.0)) < 0.5 * rough(spatial_lda.admm(g, s, t, np.ones(39), penalty=0.0))


def test_topicscore_recovers_topics(corpus):
    _, a, counts = corpus
    _, found, vocab, _ = pipelines.fit_method("topicscore", counts, None, 3)
    full = np.zeros((3, 24))
    full[:, [int(r["term"][1:]) for r in vocab.orderBy("term_id").collect()]] = found
    assert np.trace(align.unit_rows(align.aligned(full, a)) @ align.unit_rows(a).T) / 3 > 0.75


def test_distance_to_simplex_by_hand():
    v = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert np.allclose(topicscore.distance_to_simplex(np.array([[0.2, 0.2], [-1.0, 0.0], [1.0, 1.0]]), v), [0, 1, math.sqrt(0.5)], atol=1e-6)


# alignment and outcomes


def test_alignment_undoes_a_rotation_of_rows():
    a = np.random.default_rng(10).random((3, 6))
    b = a[[1, 2, 0]]
    assert np.allclose(align.aligned(b, a), a) and align.stability(b, a)["l1_dist"] < 1e-12
    assert align.permutation(a[:2], a) == [0, 1] and sorted(align.permutation(np.vstack([b, np.ones(6)]), a)) == [0, 1, 2, 3]
    assert align.consistent_orders([a, b]) == [[0, 1, 2], [2, 0, 1]]
    assert align.topic_paths([a[:2], a])[0]["paths"] == 2


def test_models_of_all_methods_share_one_order(corpus, spark):
    _, _, counts = corpus
    counts = counts.select("doc_id", "term", "n")
    none = spark.createDataFrame([], "src long, tgt long, weight double")
    w, topics, paths = pipelines.align_models(counts, none, [3, 2], ("lda", "plain"), "plain")
    a = {}
    for r in topics.collect():
        a.setdefault((r["method"], r["k"]), np.zeros((r["k"], 24)))[r["topic"], int(r["term"][1:])] = r["a"]
    for k in (2, 3):
        s = align.unit_rows(a["lda", k]) @ align.unit_rows(a["plain", k]).T
        best = max(itertools.permutations(range(k)), key=lambda o: sum(s[i, j] for i, j in enumerate(o)))
        assert list(best) == list(range(k))
    s = align.unit_rows(a["plain", 2]) @ align.unit_rows(a["plain", 3]).T
    assert s[0, 0] + s[1, 1] >= max(s[0, i] + s[1, j] for i, j in itertools.permutations(range(3), 2)) - 1e-9
    own, found, vocab, _ = pipelines.fit_method("lda", counts, none, 3)
    term = {r["term_id"]: int(r["term"][1:]) for r in vocab.collect()}
    order = [next(o for o in range(3) if all(abs(found[o, j] - a["lda", 3][i, term[j]]) < 1e-9 for j in term)) for i in range(3)]
    moved = {r["doc_id"]: r["w"] for r in w.where("method = 'lda' AND k = 3").collect()}
    assert len(moved) == 300 and all(np.allclose(moved[r["doc_id"]], [r["w"][o] for o in order]) for r in own.collect())
    assert {(r["method"], r["k"]) for r in paths.collect()} == {("lda", 3), ("plain", 3)}
    with pytest.raises(ValueError, match="terms"):
        pipelines.fit_method("lda", counts, none, 2, most_terms=23)
    assert C.whole_vocabulary(counts, 24).count() == 24


def test_repeated_edges_keep_the_greatest_row(spark):
    rows = [(2, 1, 0.5, "a"), (1, 2, 0.7, "b"), (1, 2, 0.7, "a"), (3, 3, 9.0, "z"), (4, 1, None, None)]
    e = spark.createDataFrame(rows, "src long, tgt long, weight double, kind string").repartition(4)
    assert sorted(graph.undirected(e).collect(), key=lambda r: r["tgt"]) == [(1, 2, 0.7, "b"), (1, 4, None, None)]
    assert sorted(graph.undirected(e.drop("kind")).collect(), key=lambda r: r["tgt"]) == [(1, 2, 0.7), (1, 4, None)]
    assert sorted(graph.undirected(e.select("src", "tgt")).collect()) == [(1, 2), (1, 4)]


def test_auc_km_and_cox_by_hand(spark):
    s = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "score double, label int")
    assert survival.auc(s).first()["auc"] == (2 + 1.5) / 4
    k = survival.kaplan_meier(spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1)], "time long, event int")).orderBy("time").collect()
    assert [round(r["survival"], 9) for r in k] == [0.75, 0.0]
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 2))
    time = rng.exponential(np.exp(-(x @ [1.0, -0.5])))
    assert np.allclose(survival.cox(x, time, np.ones(400)), [1.0, -0.5], atol=0.2)


def test_logistic_recovers_coefficients(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=2000)
    y = rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    b = survival.logistic(spark.createDataFrame(list(zip(x.tolist(), y.astype(int).tolist(), strict=True)), "x double, label int"), ["x"])
    assert np.allclose(b, [0.5, 1.5], atol=0.25)


# any vocabulary


def projector_distance(a, b):
    return np.linalg.norm(a @ a.T - b @ b.T)


def test_matrix_free_vectors_equal_the_gram_route(corpus, spark):
    _, _, counts = corpus
    vocab, p = C.all_terms(counts)
    sparse = linalg.rows(C.normalise(counts), vocab).cache()
    g, sums, n = linalg.gram(sparse, p)
    assert np.allclose(linalg.product(sparse, np.eye(p)[:, :5]), g[:, :5])
    found, rows = linalg.column_sums(sparse, p)
    assert rows == n and np.allclose(found, sums)
    for less in (None, sums / 60):
        m = g if less is None else g - np.diag(less)
        want, val = linalg.top_eigen(m, 4)
        vec, got = linalg.leading(sparse, 4, p, less, extra=2)
        assert projector_distance(want, vec) < 1e-6 and np.allclose(got, val, rtol=1e-9)


def test_matrix_free_vectors_of_brands(spark, sf):
    from loomgraph.plans.catalog import brands

    x = C.normalise(brands(spark, "/root/testdata/sf0.01"))
    vocab, p = C.all_terms(brands(spark, "/root/testdata/sf0.01"))
    sparse = linalg.rows(x, vocab).cache()
    g, _, _ = linalg.gram(sparse, p)
    for k in (1, 4):
        assert projector_distance(linalg.top_eigen(g, k)[0], linalg.leading(sparse, k, p, extra=1)[0]) < 1e-6


def test_matrix_free_basis_cut_back_and_low_rank(spark):
    rng = np.random.default_rng(5)
    x = rng.random((120, 60)) * np.linspace(1, 3, 60)
    sparse = spark.createDataFrame([(i, list(range(60)), row.tolist()) for i, row in enumerate(x)], "doc_id long, idx array<int>, val array<double>").cache()
    want, val = linalg.top_eigen(x.T @ x, 3)
    vec, got = linalg.leading(sparse, 3, 60, extra=1, held=60 * 20)
    assert projector_distance(want, vec) < 1e-6 and np.allclose(got, val)
    flat = spark.createDataFrame([(i, [0, 7], [1.0, 2.0]) for i in range(5)], "doc_id long, idx array<int>, val array<double>")
    vec, got = linalg.leading(flat, 3, 10)
    assert np.allclose(got, [25, 0, 0], atol=1e-9) and np.allclose(np.abs(vec[[0, 7], 0]), np.array([1, 2]) / 5**0.5)


def test_model_with_200000_terms(spark):
    """Two blocks of 100,000 terms: the documents of each block have one topic, and no term is left out."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    at = (F.col("doc_id") % 2) * 100_000 + F.pmod(F.xxhash64("doc_id", "j"), F.lit(100_000))
    drawn = docs.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(49)))).select("doc_id", at.alias("t"))
    common = docs.withColumn("t", 200_000 + F.col("doc_id") % 2)  # a term of each block that all its documents hold
    whole = spark.range(200_000).select((F.floor(F.col("id") / 100_000) + 2 * (F.col("id") % 2000)).alias("doc_id"), F.col("id").alias("t"))
    counts = drawn.unionByName(common.select("doc_id", "t")).unionByName(whole).groupBy("doc_id", F.format_string("t%06d", "t").alias("term")).agg(F.count("*").alias("n"))
    model = GraphTopics(2).fit(counts)
    assert model.a.shape == (2, 200_002) and model.vocab.count() == 200_002
    topics = {r["doc_id"]: r["topic"] for r in model.topics().collect()}
    assert len({topics[i] for i in range(0, 4000, 2)}) == 1 and len({topics[i] for i in range(1, 4000, 2)}) == 1 and topics[0] != topics[1]
    assert model.terms().count() == 400_004
    exact = model.v[:, 0] @ linalg.product(linalg.rows(C.normalise(counts), model.vocab, small=False), model.v[:, :1])[:, 0]
    assert abs(exact - model.values[0] ** 2) < 1e-9


# neighbours by count, shared tokens by bounds


def brute_nearest(points, k):
    out = {}
    for i, (x, y) in points.items():
        d = sorted((round(math.sqrt((x - a) ** 2 + (y - b) ** 2), 9), j) for j, (a, b) in points.items() if j != i)
        out[i] = d[:k]
    return out


@pytest.mark.parametrize(("k", "leaf"), [(1, None), (5, None), (3, 2), (4, 50)])
def test_nearest_of_any_shape_equals_brute_force(spark, k, leaf):
    rng = np.random.default_rng(k)
    parts = [rng.random((150, 2)), rng.normal(size=(80, 2)) * 1e-4 + 0.5, np.array([[1e6, 1e6], [-3e5, 0.2], [1e6, 1e6 + 1]]), np.stack([np.linspace(0, 1, 40), np.full(40, 0.25)], 1), np.tile([[0.3, 0.3]], (k + 4, 1)), rng.integers(0, 4, (30, 2)) / 4]
    xy = np.concatenate(parts)
    points = {int(i): tuple(map(float, p)) for i, p in zip(rng.permutation(len(xy)), xy, strict=True)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "node long, x double, y double").repartition(3)
    got = {}
    for r in graph.nearest(df, k, leaf, fan=4).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append((r["distance"], r["tgt"]))
    want = brute_nearest(points, k)
    assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
    assert all(math.isclose(a[0], b[0], rel_tol=1e-14, abs_tol=1e-9) for i in want for a, b in zip(got[i], want[i], strict=True))


def test_nearest_pairs_do_not_grow_with_an_outlier(spark):
    """The leaf pairs that are met, counted with and without one far point: two more leaves, not all of them."""
    from loomgraph import shared

    rng = np.random.default_rng(3)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.random((3000, 2)))]
    met = []
    for more in ([], [(9999, 1e6, 1e6)]):
        graph.nearest(spark.createDataFrame(rows + more, "node long, x double, y double"), 5).count()
        path = [p for _, p in shared._WRITTEN if "leaf-pairs" in p][-1]
        met.append(spark.read.parquet(path).count())
    assert met[1] <= 1.3 * met[0] and met[0] < 3000 / 12 * 60


def brute_shared(items, top, size, allowed=None):
    sets, group = {}, {}
    for node, token, g in items:
        sets.setdefault(node, set()).add(token)
        group[node] = g
    out = []
    for u in sets:
        c = sorted((-len(sets[u] & sets[v]), v) for v in sets if v != u and sets[u] & sets[v] and (allowed is None or (group[u], group[v]) in allowed))
        out += [(u, v, -n, i + 1) for i, (n, v) in enumerate(c[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("held", [2, 8, 1000])
def test_shared_tokens_with_tokens_that_all_hold(spark, seed, held):
    rng = np.random.default_rng(seed)
    items = []
    for node in range(70):
        g = int(rng.integers(3))
        items += [(node, "all", g)] * int(rng.integers(1, 3))
        items += [(node, f"often{j}", g) for j in range(3) if rng.random() < 0.4]
        items += [(node, f"t{int(rng.zipf(1.5)) % 60}", g) for _ in range(int(rng.integers(0, 6)))]
    df = spark.createDataFrame(items, "node long, token string, group long")
    got = sorted((r["src"], r["tgt"], r["shared"], r["rank"]) for r in graph.shared_counts(df, 100, 3, held=held).collect())
    assert got == brute_shared(items, 3, 100)
    pairs = [(0, 1), (1, 0), (2, 2), (0, 1)]
    near = spark.createDataFrame(pairs, "group long, other long")
    got = sorted((r["src"], r["tgt"], r["shared"], r["rank"]) for r in graph.shared_counts(df, 100, 3, near, held).collect())
    assert got == brute_shared(items, 3, 100, set(pairs))


def test_a_token_of_all_nodes_makes_no_pairs_of_all(spark):
    """3,000 nodes share one token; the rows that meet on it stay linear."""
    df = spark.range(3000).select(F.col("id").alias("node"), F.explode(F.array(F.lit("all"), F.concat(F.lit("t"), (F.col("id") / 2).cast("long")))).alias("token"))
    made = graph.shared_counts(df, 10_000, 2, held=100)
    rows = {r["src"]: [] for r in made.select("src").distinct().collect()}
    for r in made.collect():
        rows[r["src"]].append((r["rank"], r["tgt"], r["shared"]))
    assert sorted(rows[10]) == [(1, 11, 2), (2, 0, 1)] and sorted(rows[0]) == [(1, 1, 2), (2, 2, 1)] and len(rows) == 3000
    kinds = spark.createDataFrame([(i, "all") for i in range(50)], "node long, token string")
    assert graph.shared_counts(kinds, 10, 2, held=3).count() == 100


# outcomes of tables of any size


def brute_scan(value, time, event):
    out = {}
    for cut in np.unique(value):
        low, o, v = value <= cut, 0.0, 0.0
        for at in np.unique(time[event > 0]):
            risk = time >= at
            n, n1, d, d1 = risk.sum(), (risk & low).sum(), event[time == at].sum(), event[(time == at) & low].sum()
            o += d1 - d * n1 / n
            v += d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0.0
        out[float(cut)] = (int(low.sum()), o, v)
    return out


@pytest.mark.parametrize("strip", [7, 40, 1000])
def test_logrank_of_every_cut_equals_the_test_at_each(spark, strip):
    rng = np.random.default_rng(strip)
    value, time, event = rng.integers(0, 60, 150) / 4, rng.integers(0, 30, 150), (rng.random(150) < 0.6).astype(int)
    rows = [(float(v), int(t), int(e)) for v, t, e in zip(value, time, event, strict=True)] + [(None, 3, 1), (1.0, None, 1), (1.0, 2, None)]
    got = survival.logrank_scan(spark.createDataFrame(rows, "value double, time long, event int").repartition(4), "value", strip=strip).collect()
    want = brute_scan(value, time, event)
    assert {r["cut"] for r in got} == set(want)
    for r in got:
        n, o, v = want[r["cut"]]
        assert r["n_low"] == n and r["n"] == 150 and abs(r["o"] - o) < 1e-9 and abs(r["v"] - v) < 1e-9


def test_cox_of_a_table_equals_the_array_solver(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 3)) * [1, 5, 0.1] + [0, 3, 0]
    time = np.ceil(10 * rng.exponential(np.exp(-(x @ [0.8, -0.1, 2.0]))))
    event = (rng.random(1000) < 0.7).astype(int)
    rows = [(*map(float, a), float(t), int(e)) for a, t, e in zip(x, time, event, strict=True)] + [(None, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, time double, event int").repartition(3)
    got = survival.cox_model(df, ["a", "b", "c"], ridge=0.0).collect()
    want = survival.cox(x, time, event, ridge=0.0)
    assert [r["name"] for r in got] == ["a", "b", "c"] and np.allclose([r["value"] for r in got], want, atol=1e-7)
    g, h = survival.cox_sums(df.na.drop(), ["a", "b", "c"], want)
    assert np.abs(g).max() < 1e-5 and np.allclose([r["error"] for r in got], np.sqrt(np.diag(np.linalg.inv(h))), rtol=1e-5)
    flat = survival.cox_model(df.withColumn("a", F.lit(1.0)), ["a"]).first()
    assert flat["value"] == 0.0


# walks and priors of graphs of any size


def test_hops_by_chains_equal_levels(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + i + 1) for i in range(40)] + [(1000, 1040), (1010, 1030), (5, 700), (700, 701), (701, 290)]
    rows += [(2000 + int(a), 2000 + int(b)) for a, b in rng.integers(0, 60, (90, 2))] + [(3000, 3001), (3, 3)]
    perm = {x: int(p) for x, p in zip(sorted({x for r in rows for x in r}), rng.permutation(5000), strict=False)}
    edges = spark.createDataFrame([(perm[a], perm[b]) for a, b in rows], "src long, tgt long").repartition(3)
    nodes = spark.createDataFrame([(p,) for p in perm.values()] + [(9999,)], "node long")
    near = {}
    for a, b in rows:
        near.setdefault(perm[a], set()).add(perm[b])
        near.setdefault(perm[b], set()).add(perm[a])
    want = {9999: (9999, 0)}
    for start in sorted(near):
        if start in want:
            continue
        front, level = {start}, 0
        while front:
            want |= {x: (start, level) for x in front}
            front = {y for x in front for y in near[x] if y not in want}
            level += 1
    for largest in (200_000, 2):
        assert {r["node"]: (r["root"], r["hop"]) for r in graph.hops(edges, nodes, largest=largest).collect()} == want


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    import loomgraph.operators.graph as g

    written = []
    whole = g.materialise
    monkeypatch.setattr(g, "materialise", lambda df, tag: written.append(tag) or whole(df, tag))
    path = spark.range(9999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("tgt"))
    roots = spark.range(10_000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
    got = g.hops(path, roots.select("node"), roots, largest=100)
    assert written.count("darts") + written.count("better") < 30
    assert got.where("hop = node").count() == 10_000


def test_priors_of_large_components_equal_those_of_tasks(spark):
    rng = np.random.default_rng(4)
    gamma = rng.random((9, 2)) * 5 + 0.3
    edges = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (5, 6)]
    weights = spark.createDataFrame([("a", 100 + i, g.tolist()) for i, g in enumerate(gamma)], "sample_id string, doc_id long, w array<double>").coalesce(1)
    e = spark.createDataFrame([("a", 100 + i, 100 + j, 1.0 + i / 10) for i, j in edges], "sample_id string, src long, tgt long, weight double").coalesce(1)
    want = spatial_lda.admm(gamma, np.array([i for i, _ in edges]), np.array([j for _, j in edges]), np.array([1.0 + i / 10 for i, _ in edges]), rounds=3000)
    for largest in (50, 2):
        got = spatial_lda.update_priors(weights, e, "sample_id", "doc_id", 2, largest, rounds=3000)
        found = {r["doc_id"]: r["prior"] for r in got.collect()}
        apart = np.abs(np.array([found[100 + i] for i in range(9)]) - want)
        assert apart[:7].max() < 2e-4 and apart.max() < 1e-3  # without an edge, Newton's own tolerance


def test_priors_by_blocks_with_a_hub_equal_those_of_one_task(spark, monkeypatch):
    written, whole = [], spatial_lda.materialise
    monkeypatch.setattr(spatial_lda, "materialise", lambda df, tag: written.append(tag) or whole(df, tag))
    rng = np.random.default_rng(4)
    gamma = rng.random((60, 2)) * 5 + 0.3
    pairs = {(min(i, j), max(i, j)) for i in range(40) for j in ((i + 1) % 40, (i + 7) % 40)} | {(0, i) for i in range(40, 60)} | {(i, i + 1) for i in range(40, 59)}
    edges = [(i, j, 1.0 + i / 50) for i, j in sorted(pairs)]
    src, tgt, weight = (np.array(x) for x in zip(*edges, strict=True))
    want = spatial_lda.admm(gamma, src, tgt, weight, rounds=1000)
    weights = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(gamma)], "node long, w array<double>").coalesce(1)
    e = spark.createDataFrame(edges, "src long, tgt long, weight double").coalesce(1)
    for held in (1000, 5):  # regions grown in one task, and what is contracted before
        dealt = spatial_lda._blocks(e, 60, 15, held).groupBy("part").count().collect()
        assert len(dealt) >= 4 and sum(r["count"] for r in dealt) == len(edges)
    got = {r["node"]: r["prior"] for r in spatial_lda.admm_large(weights, e, 2, block=60, hub=15, held=5).collect()}
    assert np.abs(np.array([got[i] for i in range(60)]) - want).max() < 2e-4
    assert len(got) == 60 and written.count("admm-blocks") <= 61 and len(written) < 200  # a round of joins for each step took hundreds


# vectors over the terms as tables


def test_model_whose_vectors_are_tables_equals_the_held_one(corpus, spark):
    _, _, counts = corpus
    one, other = GraphTopics(3).fit(counts), GraphTopics(3, gram_terms=0, held_terms=0).fit(counts)
    assert "a" not in other.__dict__ and "v" not in other.__dict__  # nothing of the size of the terms came to the driver
    left, right = ({(r["topic"], r["term"]): r["a"] for r in m.terms().collect()} for m in (one, other))
    assert left.keys() == right.keys() and max(abs(left[x] - right[x]) for x in left) < 1e-7
    assert np.allclose(one.a, other.a, atol=1e-7) and np.allclose(one.v, other.v, atol=1e-7) and np.allclose(one.values, other.values)
    w = {r["doc_id"]: r["w"] for r in one.w.collect()}
    assert max(np.abs(np.array(w[r["doc_id"]]) - np.array(r["w"])).max() for r in other.w.collect()) < 1e-6


def test_table_vectors_of_low_rank_and_few_terms(spark):
    from loomgraph.operators import factors

    flat = spark.createDataFrame([(i, t, n) for i in range(5) for t, n in (("a", 1), ("b", 3))], "doc_id long, term string, n long")
    vocab, p = C.all_terms(flat)
    x = factors.Tabled(flat, vocab, p, "doc_id")
    v, values = x.leading(3)
    assert np.allclose(values, [5 * (1 / 16 + 9 / 16), 0, 0], atol=1e-9)
    found = {r["term_id"]: r["c"] for r in x.long(v, 3).collect()}
    assert np.allclose([found[0][0], found[1][0]], np.array([3, 1]) / 10**0.5)
