"""Command line: python -m loomgraph {simulate,regions,baskets,samples,choose-k,survival,post-process} ... ; see --help of each."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.simplex import argmax
from loomgraph.plans import pipelines
from loomgraph.sources import io, samples


def regions_input(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts, coords, edges = io.read_region_counts(spark, a.folder), io.read_region_coords(spark, a.folder), io.read_region_edges(spark, a.folder)
    if a.meta:
        keep = io.read_region_meta(spark, a.meta).select("region_id")
        counts, coords, edges = (x.join(keep, "region_id", "left_semi") for x in (counts, coords, edges))
    return pipelines.preprocess_regions(counts, coords, edges, a.least, a.phi)


def write_methods(counts: DataFrame, edges: DataFrame, k: int, methods: list[str], out: str) -> None:
    for m in methods:
        w, topics, vocab, seconds = pipelines.fit_method(m, counts, edges, k)
        io.write_factors(w.withColumns({"method": F.lit(m), "k": F.lit(k)}), f"{out}/w/{m}")
        terms = {r["term_id"]: r["term"] for r in vocab.collect()}
        rows = [(m, k, t, terms[j], float(topics[t, j])) for t in range(k) for j in range(topics.shape[1])]
        io.write_factors(w.sparkSession.createDataFrame(rows, "method string, k int, topic int, term string, a double"), f"{out}/a/{m}")
        print(f"{m}: {seconds:.1f} s")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("simulate", "regions", "baskets", "samples", "choose-k", "survival", "post-process"):
        s = sub.add_parser(name)
        s.add_argument("--out", required=True)
        if name == "simulate":
            s.add_argument("--grid", required=True)
            s.add_argument("--task-id", type=int, required=True)
            s.add_argument("--trials", type=int)
            s.add_argument("--seed", type=int, default=50)
            s.add_argument("--topicscore", action="store_true")
            continue
        s.add_argument("--k", type=int, nargs="+", default=[3])
        s.add_argument("--methods", nargs="+", default=["plain", "graph", "lda"], choices=pipelines.METHODS)
        s.add_argument("--least", type=int, default=10)
        if name == "baskets":
            for x in ("--recipes", "--mapping", "--neighbours"):
                s.add_argument(x, required=True)
        else:
            s.add_argument("--folder", required=True)
            s.add_argument("--meta", required=name in ("survival", "post-process"))
            s.add_argument("--main", default="graph", choices=pipelines.METHODS)
            s.add_argument("--phi", type=float, default=0.1)
            s.add_argument("--folds", type=int, default=5)
            if name == "samples":
                s.add_argument("--sample", nargs="*", help="samples to read; all by default")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if a.command == "simulate":
        methods = ("plain", "graph", "lda", "spatial_lda", *(("topicscore",) if a.topicscore else ()))
        io.write_csv(pipelines.simulate_grid(spark, io.read_grid(spark, a.grid), a.task_id, a.seed, a.trials, methods=methods), a.out)
    elif a.command == "baskets":
        counts, edges = pipelines.preprocess_baskets(io.read_baskets(spark, a.recipes), io.read_mapping(spark, a.mapping), io.read_mapping(spark, a.neighbours, "group", "other"), least=a.least)
        for k in a.k:
            write_methods(counts, edges, k, a.methods, a.out)
    elif a.command == "samples":
        counts, coords, edges = pipelines.preprocess_samples(*samples.read_samples(spark, a.folder, a.sample or None), a.phi, a.least)
        for k in a.k:
            w, found = pipelines.analyse_samples(counts, coords, edges, k, tuple(a.methods))
            w.withColumn("k", F.lit(k)).write.mode("overwrite").partitionBy("method", "sample_id").parquet(f"{a.out}/w/k={k}")
            io.write_csv(found.withColumn("k", F.lit(k)), f"{a.out}/metrics/k={k}")
    else:
        counts, _, edges = regions_input(spark, a)
        units = counts.select("doc_id", "region_id").distinct()
        counts = counts.select("doc_id", "term", "n")
        if a.command == "regions":
            for k in a.k:
                write_methods(counts, edges, k, a.methods, a.out)
        elif a.command == "choose-k":
            for m in a.methods:
                io.write_csv(pipelines.choose_k(counts, edges, units, a.k, a.folds, m), f"{a.out}/{m}")
        elif a.command == "post-process":
            w, topics, paths = pipelines.align_models(counts, edges, a.k, tuple(a.methods), a.main)
            io.write_factors(w, f"{a.out}/w")
            io.write_factors(topics, f"{a.out}/a")
            io.write_csv(paths, f"{a.out}/paths")
            meta = io.read_region_meta(spark, a.meta)
            heaviest = w.join(units, "doc_id").select("method", "k", "region_id", argmax(F.col("w")).alias("topic"))
            for k in sorted(set(a.k)):
                for m in a.methods:
                    own = heaviest.where((F.col("method") == m) & (F.col("k") == k)).select("region_id", "topic")
                    io.write_csv(pipelines.survival_table(own, meta, k), f"{a.out}/survival/{m}-{k}")
        else:
            meta = io.read_region_meta(spark, a.meta)
            for k in a.k:
                for m in a.methods:
                    w = pipelines.fit_method(m, counts, edges, k)[0]
                    topics = w.join(units, "doc_id").select("region_id", argmax(F.col("w")).alias("topic"))
                    io.write_csv(pipelines.survival_table(topics, meta, k), f"{a.out}/{m}-{k}")


if __name__ == "__main__":
    main()
