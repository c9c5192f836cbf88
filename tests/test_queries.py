"""Every query with SQL equals it; every other one runs; the flagship finds the languages."""

from __future__ import annotations

import pytest
from oracle import compare

from loomgraph.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", ["graph_topics", "lda_topics", "topicscore_topics", "logistic_shares", "logrank_cut", "fold_stability", "topic_alignment"])
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and not [c for c in df.columns if df.where(f"`{c}` IS NULL").limit(1).count()]


def test_voronoi_trees_are_the_shortest(spark, sf):
    """The trees of all samples against Prim's algorithm over all pairs of points."""
    import numpy as np
    from loomgraph.plans.catalog import points

    rows, want = points(spark, sf).collect(), {}
    for k in {r["topic"] for r in rows}:
        xy = np.array([(r["x"], r["y"]) for r in rows if r["topic"] == k])
        far, total = np.hypot(*(xy - xy[0]).T), 0.0
        left = set(range(1, len(xy)))
        while left:
            i = min(left, key=lambda j: far[j])
            total += far[i]
            left.discard(i)
            far = np.minimum(far, np.hypot(*(xy - xy[i]).T))
        want[k] = (len(xy) - 1, total)
    got = {r["sample_id"]: (r["edges"], r["total"]) for r in QUERIES["voronoi_tree_length"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_plain_topics_follow_the_languages(spark):
    from itertools import permutations

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["plsi_topics"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").groupBy("topic", "lang").count().collect()
    n = {(r["topic"], r["lang"]): r["count"] for r in rows}
    best = max(sum(n.get((t, x), 0) for t, x in enumerate(p)) for p in permutations(("de", "en", "es", "fr")))
    assert best >= 0.85 * sum(n.values())


def test_entry_without_the_llm_folder(tmp_path):
    """A copy of the repository without the llm folders and the pipeline imports and lists the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'gram' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
