"""Readers, writers, caches, grids and the stream on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import counts as C
from loomgraph.operators.running import number_rows
from loomgraph.plans import pipelines
from loomgraph.sources import io
from loomgraph.streaming.online import OnlineTopics


@pytest.fixture
def regions(tmp_path):
    head = ",".join(["", *schemas.REGION_COUNTS])
    for r, cells in (("reg1", (1, 2, 3)), ("reg2", (1, 2))):
        (tmp_path / f"{r}.D.csv").write_text(head + "\n" + "\n".join(f"\"('cell', {c})\",{c * 10},0,1,0,0,0,0,5" for c in cells))
        (tmp_path / f"{r}.coord.csv").write_text(",CELL_ID,X,Y\n" + "\n".join(f"{c - 1},{c},{c}.5,{2 * c}" for c in cells))
        (tmp_path / f"{r}.edge.csv").write_text(",src,tgt,distance\n0,1,2,4.0\n" + ("1,2,3,16.0\n" if 3 in cells else ""))
        (tmp_path / f"{r}.type.csv").write_text(",CELL_ID,CELL_TYPE,CELL_CLASS\n" + "\n".join(f"{c - 1},{c},Tumor {c},Tumor" for c in cells))
    (tmp_path / "meta.csv").write_text("region_id,primary_outcome,recurrence,length_of_disease_free_survival\nreg1,1,0,12.5\nreg2,,1,3.0\n")
    return str(tmp_path)


def test_region_files(spark, regions):
    assert {r["region_id"] for r in io.regions(spark, regions).collect()} == {"reg1", "reg2"}
    counts = io.read_region_counts(spark, regions)
    assert counts.groupBy("region_id").count().orderBy("region_id").collect()[0]["count"] == 9
    assert {r["n"] for r in counts.where("region_id = 'reg1' AND cell_id = 3").collect()} == {30, 1, 5}
    assert [tuple(r) for r in io.read_region_coords(spark, regions).where("cell_id = 2").orderBy("region_id").collect()] == [("reg1", 2, 2.5, 4.0), ("reg2", 2, 2.5, 4.0)]
    assert io.read_region_types(spark, regions).where("cell_type = 'Tumor 3'").count() == 1
    assert [r["region_id"] for r in io.read_region_meta(spark, f"{regions}/meta.csv").collect()] == ["reg1"]
    docs, coords, edges = pipelines.preprocess_regions(counts, io.read_region_coords(spark, regions), io.read_region_edges(spark, regions), least=20)
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {"reg1:2", "reg1:3", "reg2:2"}
    assert [(r["src"], r["tgt"]) for r in edges.collect()] == [("reg1:2", "reg1:3")] and 0.9 < edges.first()["weight"] <= 1
    assert coords.count() == 3


def test_baskets(spark, tmp_path):
    rows = [{"cuisine": c, "ingredients": [f"i{j}", "Salt", "sea salt", f"{c} mix"]} for c in ("it", "fr") for j in (1, 1, 2, 2, 1)]
    (tmp_path / "train.json").write_text(json.dumps(rows))
    (tmp_path / "map.json").write_text(json.dumps({"salt": ["sea salt", "Salt"]}))
    (tmp_path / "near.json").write_text(json.dumps({"it": ["fr"], "fr": ["it"]}))
    counts, edges = pipelines.preprocess_baskets(io.read_baskets(spark, f"{tmp_path}/train.json"), io.read_mapping(spark, f"{tmp_path}/map.json"), io.read_mapping(spark, f"{tmp_path}/near.json", "group", "other"), least=2, top=2)
    assert {r["term"] for r in counts.select("term").distinct().collect()} == {"salt", "i1", "i2", "it mix", "fr mix"}
    assert counts.where("term = 'salt'").agg(F.sum("n")).first()[0] == 20 and edges.count() > 0
    ids = {r["basket_id"]: r["tokens"] for r in io.read_baskets(spark, f"{tmp_path}/train.json").collect()}
    (tmp_path / "another.json").write_text(json.dumps(rows[:3]))
    both = {r["basket_id"]: r["tokens"] for r in io.read_baskets(spark, f"{tmp_path}/[at][nr]*.json").collect()}
    assert len(ids) == 10 and len(both) == 13 and all(both[k] == v for k, v in ids.items())


def test_grid_cache_and_sinks(spark, tmp_path):
    (tmp_path / "config.txt").write_text("task_id nsim N n K p\n1 2 30 60 2 12\n")
    grid = io.read_grid(spark, f"{tmp_path}/config.txt")
    assert tuple(grid.first()) == (1, 2, 30, 60, 2, 12)
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert io.cached(spark, f"{tmp_path}/cache", build, threshold=1).count() == io.cached(spark, f"{tmp_path}/cache", build, threshold=1).count() == 3
    io.cached(spark, f"{tmp_path}/cache", build, threshold=2)
    assert len(built) == 2
    io.write_factors(spark.createDataFrame([("plain", 3, 0, 0.5)], "method string, k int, topic int, a double"), f"{tmp_path}/factors")
    assert spark.read.parquet(f"{tmp_path}/factors").where("method = 'plain' AND k = 3").count() == 1
    io.write_csv(spark.range(2), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    out = pipelines.simulate_grid(spark, grid, 1, trials=1, methods=("plain",))
    assert {r["metric"] for r in out.collect()} == {"jump", "err", "l1_err", "acc", "time", "A_err", "A_l1_err"}
    assert [r["pos"] for r in number_rows(spark.range(50).selectExpr("id * 7 % 50 AS v"), "v").orderBy("v").collect()] == list(range(50))


def test_online_topics_over_a_stream(spark, tmp_path):
    rows = [(d, f"t{(d % 2) * 3 + j}", 5) for d in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, term string, n long")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    topics = OnlineTopics(C.vocabulary(df, 10), 2, total=40)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    topics.start(stream, f"{tmp_path}/check").awaitTermination()
    assert topics.step >= 1 and topics.model.topics.shape == (2, 6)


def test_command_line(spark, regions, tmp_path):
    from loomgraph.__main__ import main

    main(["regions", "--folder", regions, "--out", f"{tmp_path}/out", "--k", "2", "--methods", "plain", "--least", "1"])
    assert spark.read.parquet(f"{tmp_path}/out/w/plain").count() == 5
    main(["survival", "--folder", regions, "--meta", f"{regions}/meta.csv", "--out", f"{tmp_path}/surv", "--k", "2", "--methods", "plain", "--least", "1"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/surv/plain-2").columns[:3] == ["region_id", "Topic0", "Topic1"]
    main(["regions", "--folder", regions, "--out", f"{tmp_path}/two", "--k", "1", "2", "--methods", "plain", "--least", "1"])
    assert {r["k"] for r in spark.read.parquet(f"{tmp_path}/two/w/plain").collect()} == {1, 2}
    main(["post-process", "--folder", regions, "--meta", f"{regions}/meta.csv", "--out", f"{tmp_path}/post", "--k", "1", "2", "--methods", "plain", "lda", "--main", "plain", "--least", "1"])
    assert {(r["method"], r["k"]) for r in spark.read.parquet(f"{tmp_path}/post/w").select("method", "k").collect()} == {("plain", 1), ("plain", 2), ("lda", 1), ("lda", 2)}
    assert spark.read.option("header", True).csv(f"{tmp_path}/post/survival/lda-2").columns[:3] == ["region_id", "Topic0", "Topic1"]


def test_plans_push_down_and_prune(spark, sf):
    """Scans read only the columns asked for, filters reach them, and no plan has a Python row function."""
    from loomgraph.plans.catalog import QUERIES

    plan = QUERIES["dtm_pivot"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
    plan = QUERIES["shared_count_topk"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan and "WindowGroupLimit" in plan
    for name in ("simplex_projection", "row_normalize", "group_median_iqr", "argmax_topic"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_samples_are_pruned_and_analysed_together(spark, tmp_path):
    """A store of three samples: one sample reads one folder, a table of samples prunes when it runs, and each sample's
    metrics equal those of the sample alone."""
    import numpy as np
    from pyspark.sql import functions as F

    from loomgraph.__main__ import main
    from loomgraph.operators import graph, metrics
    from loomgraph.plans import pipelines
    from loomgraph.sources import samples

    rng = np.random.default_rng(2)
    rows = [(s, i, *map(float, rng.random(2) * (s + 1))) for s in range(3) for i in range(40)]
    coords = spark.createDataFrame(rows, "sample_id int, node long, x double, y double")
    counts = spark.createDataFrame([(s, i, f"t{j}", int(rng.integers(1, 9)) + (9 if j == i % 4 else 0)) for s, i, _, _ in rows for j in range(4)], "sample_id int, node long, term string, n long")
    edges = spark.createDataFrame([(s, i, int(j)) for s, i, _, _ in rows for j in rng.integers(0, 40, 2) if j != i], "sample_id int, src long, tgt long").distinct()
    path = str(tmp_path / "store")
    samples.write_samples(path, counts, coords, edges)
    assert sorted(r[0] for r in samples.sample_names(spark, path).collect()) == [0, 1, 2]
    one = samples.read_samples(spark, path, [1])
    assert all({f.split("sample_id=")[1].split("/")[0] for f in df.inputFiles()} == {"1"} or "sample_id#" in df._jdf.queryExecution().executedPlan().toString() for df in one)
    for df in one:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(sample_id" in plan or "PartitionFilters: [(sample_id" in plan
        assert {r[0] for r in df.select("sample_id").distinct().collect()} == {1}
    table = samples.read_samples(spark, path, spark.createDataFrame([(0,), (2,)], "sample_id int").where("sample_id >= 0"))
    assert [df.select("sample_id").distinct().count() for df in table] == [2, 2, 2]
    assert table[0].count() == 2 * 160

    c, xy, e = pipelines.preprocess_samples(*samples.read_samples(spark, path))
    w, found = pipelines.analyse_samples(c, xy, e, 2, ("plain",))
    got = {(r["sample_id"], r["metric"]): r["value"] for r in found.collect()}
    for s in range(3):
        own = w.where(F.col("sample_id") == s).select(F.col("doc_id").alias("node"), (F.array_position("w", F.array_max("w")) - 1).cast("int").alias("topic")).cache()
        mine = e.where(F.col("src").startswith(f"{s}:"))
        near = graph.nearest(xy.where(F.col("sample_id") == s), 1)
        want = {"moran": metrics.moran(own, mine).first()["moran"], "pas": metrics.pas(own, mine).first()["pas"], "chaos": metrics.chaos(own, near).first()["chaos"]}
        for k, v in want.items():
            assert (v is None and got[s, k] is None) or abs(got[s, k] - v) < 1e-9
    main(["samples", "--folder", path, "--sample", "0", "2", "--k", "2", "--methods", "plain", "--out", str(tmp_path / "out"), "--least", "1"])
    assert spark.read.parquet(str(tmp_path / "out/w/k=2")).select("sample_id").distinct().count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "out/metrics/k=2")).count() == 6
