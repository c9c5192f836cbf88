"""What must not grow faster than the input: rows that move, and rows of one task."""

from __future__ import annotations

import re

import numpy as np
import pytest

from loomgraph.operators import counts as C
from loomgraph.operators import graph
from loomgraph.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_counted_where_their_texts_are(spark, sf):
    """Texts move, the tokens do not: no exchange by document and term, and none of the counts beside a document's topic."""
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term#", plan(catalog.doc_tokens(spark, sf)))
    assert len(re.findall(r"hashpartitioning\(doc_id#", plan(catalog.top_words(spark, sf)))) == 2  # texts, languages


@pytest.mark.parametrize("few", [2, 100])
def test_filters_of_odd_rows(spark, few):
    rows = [(d, f"t{t}", 1 + (d * t) % 4) for d in range(12) for t in range(d % 5 + 2)] + [(None, "t1", 20), (3, None, 20)]
    x = spark.createDataFrame(rows, "doc_id long, term string, n long")
    total = lambda i: {k: sum(r[2] for r in rows if r[i] == k) for k in {r[i] for r in rows}}
    terms, docs = total(1), total(0)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, C.filter_terms(x, 20, few=few).select(*x.columns).collect()), key=key) == sorted((r for r in rows if r[1] and terms[r[1]] >= 20), key=key)
    assert sorted(map(tuple, C.filter_docs(x, 12).select(*x.columns).collect()), key=key) == sorted((r for r in rows if r[0] is not None and docs[r[0]] >= 12), key=key)


def test_usage_is_one_pass_and_counts_every_document(spark):
    rows = [(d, f"t{t}", 1 + (d + t) % 3) for d in range(9) for t in range(1 + d % 4)] + [(None, "t0", 50), (None, "only", 1)]
    got = {r["term"]: r["mean_use"] for r in C.usage(spark.createDataFrame(rows, "doc_id long, term string, n long"), 0.02).collect()}
    totals = {d: sum(r[2] for r in rows if r[0] == d) for d in {r[0] for r in rows}}
    least = 0.02 * np.sqrt(np.log(max(len(totals), 5)) / (len(totals) * max(totals.values())))
    want = {t: sum(r[2] / totals[r[0]] for r in rows if r[1] == t and r[0] is not None) / len(totals) for t in {r[1] for r in rows if r[0] is not None}}
    want = {t: v for t, v in want.items() if v > least}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-12 for t in want)


def test_nearest_deals_rows_by_their_number(spark, monkeypatch):
    """Few bytes that meet many rows: AQE would leave them to one task."""
    seen, write = {}, graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag: seen.setdefault(tag, plan(df)) and write(df, tag))
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.random((9000, 2)))], "node long, x double, y double")
    assert graph.nearest(p, 2).count() == 18_000
    assert re.search(r"hashpartitioning\(leaf#\w+, 3\), REPARTITION_BY_NUM", seen["leaf-pairs"])
    assert re.search(r"hashpartitioning\(other#\w+, 3\), REPARTITION_BY_NUM", seen["knn"])


def test_shared_tokens_meet_without_all_pairs(spark, monkeypatch):
    """Nodes of 1 to 30 tokens against all pairs; 400 nodes of one token make 400 heads' rows each, not 400 squared."""
    rng = np.random.default_rng(9)
    held = {i: set(rng.choice(60, size=int(rng.choice([1, 2, 3, 5, 30], p=[0.2, 0.3, 0.3, 0.15, 0.05])), replace=False).tolist()) for i in range(150)}
    items = spark.createDataFrame([(i, f"t{x}") for i, s in held.items() for x in s] + [(1000 + i, "crowd") for i in range(400)] + [(None, "t1"), (5, None)], "node long, token string")
    held |= {1000 + i: {"crowd"} for i in range(400)}
    seen, few = [], getattr(graph, "_few_shared", None)
    monkeypatch.setattr(graph, "_few_shared", lambda *a: seen.append(few(*a)) or seen[0], raising=False)
    got = {}
    for r in graph.shared_counts(items, 100, 4).collect():
        got.setdefault(r["src"], {})[r["rank"]] = (r["tgt"], r["shared"])
    want = {}
    for i, s in held.items():
        best = sorted((-len(s & u), j) for j, u in held.items() if j != i and s & u)[:4]
        if best:
            want[i] = {k + 1: (j, -c) for k, (c, j) in enumerate(best)}
    assert got == want
    assert seen and seen[0].where("src >= 1000").count() <= 400 * 5

def test_spanning_forest_contracts_its_edges(spark, monkeypatch):
    """Ties, nulls, NaN, chains and islands against Kruskal's rule, by rounds and in one task; a round writes at most half the components, and broadcasts nothing."""
    rng = np.random.default_rng(12)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 300, (700, 2)).tolist() if a != b} | {(1000 + i, 1001 + i) for i in range(60)}
    weights = [None, float("nan"), 0.0, 1.0, 2.0, 2.5]
    rows = [(a, b, float(a) if a >= 1000 else weights[int(rng.integers(6))]) for a, b in sorted(pairs)]
    edges = spark.createDataFrame(rows, "src long, tgt long, weight double").repartition(3)
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] is not None and r[2] != r[2], 0 if r[2] is None or r[2] != r[2] else r[2], r[:2]))
    want = {order[k][:2] for k in graph.spanning_tree(2000, [(i, a, b) for i, (a, b, _) in enumerate(order)])}
    seen, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag: seen.append((tag, plan(df), write(df, tag))) or seen[-1][2])
    for held in (200_000, 100, 0):
        seen.clear()
        got = graph.spanning_forest(edges, held)
        assert {(r["src"], r["tgt"]) for r in got.collect()} == want and got.count() == len(want)
        least = [t.count() for tag, _, t in seen if tag == "mst-least"]
        assert all(2 * y <= x for x, y in zip(least, least[1:], strict=False)) and bool(least) == (held < 1000)
        assert not any("Broadcast" in p for _, p, _ in seen)
    assert graph.spanning_forest(edges.limit(0)).count() == 0
