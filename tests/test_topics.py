"""The topic model at size: nothing of its work is left out, and what it writes and moves stays bounded."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import shared
from loomgraph.operators import counts as C
from loomgraph.operators import factors, fusion
from loomgraph.plans import catalog
from loomgraph.plans.model import GraphTopics


def test_graph_topics_leaves_no_rounds_out(spark, sf, monkeypatch):
    """The query's search and its rounds have the estimator's own bounds."""

    class Seen(Exception):
        pass

    def fit(self, *_):
        raise Seen(self)

    monkeypatch.setattr(GraphTopics, "fit", fit)
    with pytest.raises(Seen) as seen:
        catalog.graph_topics(spark, sf)
    assert seen.value.args[0] == GraphTopics(4, "graph")


def test_singular_vectors_over_tables_hold_documents_not_terms(spark, monkeypatch):
    """Rounds write vectors over the documents; terms of one chunk alone never leave it."""
    rng = np.random.default_rng(3)
    rows = [(d, t, int(n)) for d in range(40) for t, n in [*((f"c{j}", rng.integers(1, 9)) for j in range(6)), *((f"own{d}_{j}", rng.integers(1, 4)) for j in range(50))]]
    counts = spark.createDataFrame(rows, "doc_id long, term string, n long")
    vocab, p = C.all_terms(counts)
    x = factors.Tabled(counts, vocab, p, "doc_id")
    moved = x.terms.where("NOT alone").select(F.explode("ids")).distinct().count()
    assert p == 2006 and moved == 6
    sizes = []

    def seen(df, tag):
        out = shared.materialise(df, tag)
        sizes.append(sum(r["n"] for r in out.select(sum((F.size(c) for c in out.columns if c in ("a", "b", "p")), F.lit(0)).alias("n")).collect()))
        return out

    monkeypatch.setattr(factors, "materialise", seen)
    v, values = x.leading(2)
    # three columns of 40 documents x 8; what is over the terms is written once, at the end
    assert max(sizes[:-2]) <= 3 * 40 * 8 and len(sizes) > 4
    dense = np.zeros((40, p))
    ids = {r["term"]: r["term_id"] for r in vocab.collect()}
    for d, t, n in rows:
        dense[d, ids[t]] = n
    dense /= dense.sum(1, keepdims=True)
    want = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, want[1][:2] ** 2)
    got = np.zeros((p, 2))
    for r in x.long(v, 2).collect():
        got[r["term_id"]] = r["c"]
    assert np.allclose(np.abs(got.T @ want[2][:2].T), np.eye(2), atol=1e-7)


def test_what_a_written_table_shuffled_is_deleted_with_it(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (str(x.getName()) for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles())) if f.startswith("shuffle_")}
    before = shuffles()
    shared.release(shared.materialise(spark.range(10_000).repartition(7, "id"), "moved"))
    assert not shuffles() - before


def test_plsi_topics_keeps_one_copy_of_the_counts_and_lets_it_go(spark, sf):
    known = {path for _, path in shared._WRITTEN}
    catalog.plsi_topics(spark, sf)
    assert not [path for _, path in shared._WRITTEN if path not in known and path.rsplit("/", 1)[1].startswith(("tokens-", "counts-"))]


def test_a_hub_slows_down_its_own_edges_only():
    """A star of 3,000 equal leaves beside a path: the path's steps are its own, so few of them do."""
    rng = np.random.default_rng(4)
    src = np.concatenate([np.zeros(3000, int), np.arange(3001, 3100)])
    tgt = np.concatenate([np.arange(1, 3001), np.arange(3002, 3101)])
    y = rng.normal(size=(3101, 2))
    y[:3001] = 1.0
    u, z, gap = fusion.solve(y, src, tgt, np.ones(len(src)), 0.3, tol=1e-7, most=300)
    assert gap < 1e-7 and np.linalg.norm(z, axis=1).max() < 0.3 + 1e-12
    back = y.copy()
    np.add.at(back, src, -z)
    np.add.at(back, tgt, z)
    assert np.allclose(back, u)


def test_large_components_are_solved_by_blocks_in_few_rounds(spark, monkeypatch):
    """Four blocks of a grid with a chord, two cases and ids that are names: as in one task, with a few written tables in all."""
    rng = np.random.default_rng(6)
    at = np.arange(100).reshape(10, 10)
    pairs = np.concatenate([np.stack([at[:, :-1].ravel(), at[:, 1:].ravel()], 1), np.stack([at[:-1].ravel(), at[1:].ravel()], 1), [[0, 99]]])
    y, weight = rng.normal(size=(100, 3)), rng.uniform(0.5, 1, len(pairs))
    nodes = spark.createDataFrame([(c, f"n{i:02}", y[i].tolist()) for c in (0, 1) for i in range(100)], "case int, node string, y array<double>")
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", float(w)) for (a, b), w in zip(pairs, weight, strict=True)], "src string, tgt string, weight double")
    tags = []
    monkeypatch.setattr(fusion, "materialise", lambda df, tag: tags.append(tag) or shared.materialise(df, tag))
    got = fusion.solve_large(nodes, edges, [0.05, 0.4], 3, tol=1e-7, block=130).collect()
    assert len(got) == 200 and spark.read.parquet(*[p for _, p in shared._WRITTEN if "/fusion-nodes-" in p][-1:]).where("times > 1").count() > 10
    assert tags.count("fusion-blocks") < 40
    for case, gamma in enumerate((0.05, 0.4)):
        want = fusion.solve(y, *pairs.T, weight, gamma, tol=1e-11, most=20_000)[0]
        found = {r["node"]: r["u"] for r in got if r["case"] == case}
        assert max(np.abs(np.array(found[f"n{i:02}"]) - want[i]).max() for i in range(100)) < 5e-3
