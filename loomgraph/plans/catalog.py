"""All queries of the engine over the test tables, and the DuckDB SQL that checks them.

The tables stand in for the engine's inputs: tokens of `documents`, suppliers x brands and users x event types as
count matrices, the first two components of `embeddings` as coordinates with `label` as topic, customers' orders as
outcomes. Every float is rounded to six digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import linalg
from loomgraph.functions.simplex import argmax, clr, ilr, ilr_basis, project
from loomgraph.operators import align, features, graph, metrics, survival
from loomgraph.operators import counts as C
from loomgraph.operators.running import number_rows
from loomgraph.plans import pipelines
from loomgraph.plans.model import GraphTopics
from loomgraph.shared import materialise, release, shared_dir
from loomgraph.sources import io, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EVENTS = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    """Registers a function as the query of its name, with the SQL that checks it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# the inputs


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, term, n): suppliers x brands."""
    line = t(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("doc_id"))
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("term"))
    return line.join(part, "l_partkey").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def user_events(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("term")).agg(F.count("*").alias("n"))


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by document. Texts are dealt by id before they are cut, so that their many tokens are counted where they are."""
    return C.term_counts(t(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"), C.tokens(F.col("text")), "doc_id")


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").alias("topic"))


def knn_edges(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    return graph.undirected(graph.nearest(points(spark, sf), k).select("src", "tgt"))


BRANDS = "brands AS (SELECT l_suppkey AS doc_id, p_brand AS term, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
BRANDS_X = BRANDS + ", bx AS (SELECT doc_id, term, n, n / sum(n) OVER (PARTITION BY doc_id) AS x FROM brands)"
USERS = "users AS (SELECT user_id AS doc_id, event_type AS term, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL)"
TOKENS = "words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS term FROM documents), tokens AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS n FROM words WHERE length(term) >= 2 GROUP BY ALL)"
POINTS = "pts AS (SELECT vec_id AS node, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS topic FROM embeddings)"
PAIRS = POINTS + ", pairs AS (SELECT a.node AS src, b.node AS tgt, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS distance FROM pts a JOIN pts b ON a.node <> b.node), ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, tgt) AS rank FROM pairs)"
KNN = PAIRS + ", knn AS (SELECT * FROM ranked WHERE rank <= 5), und AS (SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt FROM knn)"
NN1 = PAIRS + ", nn1 AS (SELECT * FROM ranked WHERE rank = 1), und AS (SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt FROM nn1), mirrored AS (SELECT src, tgt FROM und UNION ALL SELECT tgt, src FROM und)"


# counts


@query(f"WITH {TOKENS} SELECT * FROM tokens")
def dtm_counts(spark, sf):
    return doc_tokens(spark, sf)


@query(f"WITH {BRANDS_X} SELECT doc_id, term, n, round(x, 6) AS x FROM bx")
def row_normalize(spark, sf):
    return C.normalise(brands(spark, sf)).select("doc_id", "term", "n", r6("x").alias("x"))


@query(f"WITH {USERS} SELECT round(avg(s), 6) AS mean_length, CAST(max(s) AS BIGINT) AS max_length, CAST(count(*) AS BIGINT) AS docs FROM (SELECT sum(n) AS s FROM users GROUP BY doc_id)")
def mean_doc_length(spark, sf):
    return C.mean_length(user_events(spark, sf)).withColumn("mean_length", r6("mean_length"))


@query(f"WITH {TOKENS} SELECT doc_id, term, n FROM tokens WHERE doc_id IN (SELECT doc_id FROM tokens GROUP BY doc_id HAVING sum(n) >= 10)")
def min_count_filter(spark, sf):
    return C.filter_docs(doc_tokens(spark, sf), 10)


@query(f"""WITH {TOKENS}, a AS (SELECT * FROM tokens WHERE term IN (SELECT term FROM tokens GROUP BY term HAVING sum(n) >= 10)),
b AS (SELECT * FROM a WHERE doc_id IN (SELECT doc_id FROM a GROUP BY doc_id HAVING sum(n) >= 10))
SELECT doc_id, term, n FROM b WHERE term IN (SELECT term FROM b GROUP BY term HAVING sum(n) >= 10)""")
def vocab_filter(spark, sf):
    return C.filter_both(doc_tokens(spark, sf))


@query(f"""WITH {TOKENS}, s AS (SELECT doc_id, sum(n) AS total FROM tokens GROUP BY doc_id), z AS (SELECT count(*) AS docs, max(total) AS longest FROM s),
p AS (SELECT count(DISTINCT term) AS p FROM tokens)
SELECT term, round(sum(n / total) / docs, 6) AS mean_use FROM tokens JOIN s USING (doc_id), z, p GROUP BY term, docs, longest, p
HAVING sum(n / total) / docs > 0.02 * sqrt(ln(greatest(docs, p)) / (docs * CAST(longest AS DOUBLE)))""")
def usage_threshold(spark, sf):
    return C.usage(doc_tokens(spark, sf), 0.02).select("term", r6("mean_use").alias("mean_use"))


@query("SELECT user_id AS doc_id, " + ", ".join(f"CAST(count(*) FILTER (event_type = '{e}') AS BIGINT) AS \"{e}\"" for e in EVENTS) + " FROM events GROUP BY user_id")
def dtm_pivot(spark, sf):
    return C.wide(user_events(spark, sf), list(EVENTS), "doc_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def balanced_sample(spark, sf):
    return C.balanced(t(spark, sf, "documents").select("doc_id", "source"), "source", 20, "doc_id")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents)
SELECT doc_id, CASE w WHEN 'thee' THEN 'the' WHEN 'der' THEN 'the' WHEN 'die' THEN 'the' WHEN 'und' THEN 'and' ELSE w END AS term, CAST(count(*) AS BIGINT) AS n
FROM w WHERE w IN ('the', 'thee', 'der', 'die', 'und', 'and', 'of') GROUP BY ALL""")
def token_canonical_map(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in (("thee", "the"), ("der", "the"), ("die", "the"), ("und", "and")) for x in kv])
    own = F.filter(F.split(F.lower("text"), " "), lambda w: w.isin("the", "thee", "der", "die", "und", "and", "of"))
    return C.term_counts(t(spark, sf, "documents"), C.canonical(own, m), "doc_id")


@query(f"WITH {KNN} SELECT src, tgt FROM und WHERE src IN (SELECT node FROM pts WHERE topic < 5) AND tgt IN (SELECT node FROM pts WHERE topic < 5)")
def regions_semi_join(spark, sf):
    return C.semi_edges(knn_edges(spark, sf), points(spark, sf).where("topic < 5").select("node"))


@query("""WITH c AS (SELECT c_nationkey AS region_id, c_custkey AS cell_id, c_mktsegment AS kind FROM customer), o AS (SELECT o_custkey AS cell_id, count(*) AS n FROM orders GROUP BY 1)
SELECT region_id, kind, CAST(count(*) AS BIGINT) AS cells, CAST(sum(n) AS BIGINT) AS counts FROM c JOIN o USING (cell_id) GROUP BY ALL""")
def regions_join(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("region_id"), F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("kind"))
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell_id")).agg(F.count("*").alias("n"))
    return c.join(o, "cell_id").groupBy("region_id", "kind").agg(F.count("*").alias("cells"), F.sum("n").alias("counts"))


@query("SELECT DISTINCT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'HOUSEHOLD' THEN 'HOUSE' ELSE c_mktsegment END AS kind FROM customer")
def value_replace(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_mktsegment").alias("kind")).replace({"AUTOMOBILE": "AUTO", "HOUSEHOLD": "HOUSE"}, subset="kind").distinct()


@query("""WITH g AS (SELECT DISTINCT 10 * x AS len, 100 * (y + 1) AS n, k AS "K", p FROM (SELECT DISTINCT l_linenumber AS x FROM lineitem), (SELECT DISTINCT r_regionkey AS y FROM region), (VALUES (2), (3)) n3(k), (VALUES (20), (30)) n4(p))
SELECT CAST(row_number() OVER (ORDER BY len, n, "K", p) AS BIGINT) AS task_id, CAST(50 AS BIGINT) AS nsim, CAST(len AS BIGINT) AS length, CAST(n AS BIGINT) AS n, CAST("K" AS BIGINT) AS "K", CAST(p AS BIGINT) AS p FROM g""")
def config_grid(spark, sf):
    """Lengths by the line numbers, sizes by the regions that the tables hold."""
    lines = sorted(r[0] for r in t(spark, sf, "lineitem").select("l_linenumber").distinct().collect())  # a few numbers
    regions = sorted(r[0] for r in t(spark, sf, "region").select("r_regionkey").distinct().collect())
    sets = [{"length": [10 * x for x in lines], "n": [100 * (y + 1) for y in regions], "K": [2, 3], "p": [20, 30]}, {"length": [10 * lines[0]], "n": [100], "K": [3], "p": [20]}]
    return io.parameter_grid(spark, sets)


# topics and metrics


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding[1:5], 1) AS i, unnest(embedding[1:5]) AS v FROM embeddings)
SELECT vec_id AS node, CAST(min(i) - 1 AS INTEGER) AS topic FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM e) WHERE v = m GROUP BY vec_id""")
def argmax_topic(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), argmax(F.slice("embedding", 1, 5)).alias("topic"))


@query("""WITH a AS (SELECT vec_id, label % 5 AS g, list_position(embedding[1:5], list_max(embedding[1:5])) - 1 AS topic FROM embeddings)
SELECT round(avg(CASE WHEN g = topic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a""")
def topic_accuracy(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.agg(r6(metrics.accuracy(F.col("label") % 5, argmax(F.slice("embedding", 1, 5)))).alias("accuracy"))


FACTORS = "t AS (SELECT vec_id, generate_subscripts(embedding[1:4], 1) AS k, CAST(unnest(embedding[1:4]) AS DOUBLE) AS a FROM embeddings), e AS (SELECT vec_id, generate_subscripts(embedding[5:8], 1) AS k, CAST(unnest(embedding[5:8]) AS DOUBLE) AS b FROM embeddings)"


def _factors(spark, sf):
    rows = t(spark, sf, "embeddings")
    cut = lambda at: rows.select("vec_id", F.posexplode(F.slice("embedding", at, 4)).alias("k", "w")).withColumn("w", F.col("w").cast("double"))
    return metrics.factor_errors(cut(1), cut(5), "vec_id", "k")


@query(f"WITH {FACTORS} SELECT round(sqrt(sum(pow(a - b, 2))), 6) AS frobenius FROM t JOIN e USING (vec_id, k)")
def frobenius_error(spark, sf):
    return _factors(spark, sf).select(r6("frobenius").alias("frobenius"))


@query(f"WITH {FACTORS} SELECT round(sum(abs(a - b)), 6) AS l1 FROM t JOIN e USING (vec_id, k)")
def l1_error(spark, sf):
    return _factors(spark, sf).select(r6("l1").alias("l1"))


@query("SELECT source, " + ", ".join(f"round(avg(CASE WHEN lang = '{x}' THEN 1.0 ELSE 0.0 END), 6) AS \"Topic{x}\"" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def topic_share_pivot(spark, sf):
    s = metrics.shares(t(spark, sf, "documents"), "source", "lang", ["de", "en", "es", "fr"])
    return s.select("source", *[r6(c).alias(c) for c in s.columns[1:]])


@query("SELECT o_orderpriority, o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round((quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / 2, 6) AS half_iqr FROM orders GROUP BY ALL")
def group_median_iqr(spark, sf):
    q = metrics.quartiles(t(spark, sf, "orders"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    return q.select("o_orderpriority", "o_orderstatus", r6("median").alias("median"), r6("half_iqr").alias("half_iqr"))


@query("SELECT p_type, metric, round(avg(value), 6) AS value FROM (SELECT p_type, 'size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_type, 'price', p_retailprice FROM part) GROUP BY ALL")
def unpivot_errors(spark, sf):
    p = t(spark, sf, "part").select("p_type", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_type", ["size", "price"], "metric", "value").groupBy("p_type", "metric").agg(r6(F.avg("value")).alias("value"))


LABEL_MEANS = "e AS (SELECT label AS topic, generate_subscripts(embedding, 1) AS term, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT topic, term, avg(v) AS a FROM e GROUP BY ALL)"


def _label_means(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("label").alias("topic"), F.posexplode("embedding").alias("term", "v"))
    return e.groupBy("topic", (F.col("term") + 1).alias("term")).agg(F.avg(F.col("v").cast("double")).alias("a"))


@query(f"WITH {LABEL_MEANS}, n AS (SELECT topic, sqrt(sum(a * a)) AS norm FROM m GROUP BY topic) SELECT x.topic AS topic_a, y.topic AS topic_b, round(sum(x.a * y.a) / (n1.norm * n2.norm), 6) AS cosine FROM m x JOIN m y USING (term) JOIN n n1 ON n1.topic = x.topic JOIN n n2 ON n2.topic = y.topic GROUP BY x.topic, y.topic, n1.norm, n2.norm")
def cosine_matrix(spark, sf):
    m = _label_means(spark, sf)
    return metrics.cosines(m, m).select("topic_a", "topic_b", r6("cosine").alias("cosine"))


@query(f"WITH {LABEL_MEANS} SELECT topic, CAST(term AS INTEGER) AS term, round((a - avg(a) OVER w) / stddev_pop(a) OVER w, 6) AS z FROM m WINDOW w AS (PARTITION BY term)")
def zscore_topics(spark, sf):
    return metrics.zscores(_label_means(spark, sf)).select("topic", F.col("term").cast("int").alias("term"), r6("z").alias("z"))


@query(f"WITH {TOKENS}, g AS (SELECT lang AS topic, term, sum(n) AS a FROM tokens JOIN documents USING (doc_id) GROUP BY ALL) SELECT topic, CAST(rank AS INTEGER) AS rank, term, CAST(a AS BIGINT) AS a FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY a DESC, term) AS rank FROM g) WHERE rank <= 10")
def top_words(spark, sf):
    langs = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic")).hint("shuffle_hash")  # beside the counts of its ids, unsorted
    g = doc_tokens(spark, sf).join(langs, "doc_id").groupBy("topic", "term").agg(F.sum("n").alias("a"))
    return metrics.top_words(g)


# graphs


BOX = "box AS (SELECT min(x) AS x0, min(y) AS y0, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS side FROM pts), unit AS (SELECT node, (x - x0) / side AS x, (y - y0) / side AS y FROM pts, box)"


@query(f"WITH {POINTS}, {BOX} SELECT node, round(x, 6) AS x, round(y, 6) AS y FROM unit")
def coord_normalize(spark, sf):
    return graph.unit_square(points(spark, sf)).select("node", r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {KNN}, {BOX} SELECT src, tgt, round(exp(-0.1 * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS weight FROM und JOIN unit a ON a.node = src JOIN unit b ON b.node = tgt")
def edge_exp_weight(spark, sf):
    return graph.exp_weights(knn_edges(spark, sf), graph.unit_square(points(spark, sf))).select("src", "tgt", r6("weight").alias("weight"))


@query(f"WITH {KNN} SELECT src, tgt, round(sum(w), 6) AS weight FROM (SELECT src, tgt, exp(-0.1 * pow(distance, 2)) / 2 AS w FROM knn UNION ALL SELECT tgt, src, exp(-0.1 * pow(distance, 2)) / 2 FROM knn) GROUP BY src, tgt")
def knn_rbf_graph(spark, sf):
    return graph.rbf_graph(points(spark, sf)).select("src", "tgt", r6("weight").alias("weight"))


@query(f"WITH {PAIRS} SELECT src, tgt, round(distance, 6) AS distance FROM ranked WHERE rank = 1")
def nn1_graph(spark, sf):
    return graph.nearest(points(spark, sf), 1).select("src", "tgt", r6("distance").alias("distance"))


@query(f"""WITH {POINTS} SELECT a.node AS anchor, CAST(count(*) AS BIGINT) AS neighbours, CAST(count(*) FILTER (b.topic = 0) AS BIGINT) AS cluster0, CAST(count(*) FILTER (b.topic = 1) AS BIGINT) AS cluster1, CAST(count(*) FILTER (b.x > 0.05) AS BIGINT) AS above, round(avg(b.y), 6) AS mean_y
FROM pts a JOIN pts b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.03 * 0.03 WHERE a.topic = 3 GROUP BY a.node""")
def radius_features(spark, sf):
    p = points(spark, sf)
    f = [F.count("*").alias("neighbours"), F.sum((F.col("topic") == 0).cast("long")).alias("cluster0"), F.sum((F.col("topic") == 1).cast("long")).alias("cluster1"), F.sum((F.col("x") > 0.05).cast("long")).alias("above"), r6(F.avg("y")).alias("mean_y")]
    return graph.neighbourhood(p.where("topic = 3").select("node", "x", "y"), p, 0.03, f)


@query("""WITH p AS (SELECT vec_id AS node, label AS sample, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT a.sample, a.node AS anchor, CAST(count(*) AS BIGINT) AS neighbours, round(avg(b.z), 6) AS mean_z FROM p a JOIN p b ON a.sample = b.sample AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.08 * 0.08 GROUP BY ALL""")
def radius_features_3d(spark, sf):
    e = F.col("embedding")
    p = t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("sample"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    f = [F.count("*").alias("neighbours"), r6(F.avg("z")).alias("mean_z")]
    return graph.neighbourhood(p.select("node", "sample", "x", "y", "z"), p, 0.08, f, ("x", "y", "z"), ("sample",))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS token FROM lineitem), n AS (SELECT count(*) AS n FROM part),
c AS (SELECT a.node AS src, b.node AS tgt, count(*) AS shared FROM i a JOIN i b USING (token) WHERE a.node <> b.node GROUP BY ALL)
SELECT src, tgt, CAST(shared AS BIGINT) AS shared, CAST(rank AS INTEGER) AS rank, round(shared / (n - shared), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY shared DESC, tgt) AS rank FROM c), n WHERE rank <= 5""")
def shared_count_topk(spark, sf):
    items = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").cast("string").alias("token"))
    return graph.shared_counts(items, t(spark, sf, "part").count()).select("src", "tgt", "shared", "rank", r6("similarity").alias("similarity"))


@query(f"WITH RECURSIVE {NN1}, reach(node, other) AS (SELECT node, node FROM pts UNION SELECT reach.node, mirrored.tgt FROM reach JOIN mirrored ON mirrored.src = reach.other) SELECT node, min(other) AS root FROM reach GROUP BY node")
def connected_components(spark, sf):
    p = points(spark, sf)
    return graph.component_of(graph.undirected(graph.nearest(p, 1).select("src", "tgt")), p)


BFS = f"{NN1}, reach(node, other) AS (SELECT node, node FROM pts UNION SELECT reach.node, mirrored.tgt FROM reach JOIN mirrored ON mirrored.src = reach.other), root AS (SELECT node, min(other) AS root FROM reach GROUP BY node), walk(node, root, hop) AS (SELECT node, root, 0 FROM root WHERE node = root UNION SELECT mirrored.tgt, walk.root, walk.hop + 1 FROM walk JOIN mirrored ON mirrored.src = walk.node WHERE walk.hop < 80), hops AS (SELECT node, root, min(hop) AS hop FROM walk GROUP BY ALL)"


@query(f"WITH RECURSIVE {BFS} SELECT node, root, CAST(hop AS INTEGER) AS hop, CAST(hop % 5 AS INTEGER) AS fold FROM hops")
def bfs_folds(spark, sf):
    p = points(spark, sf)
    return graph.tree_folds(graph.undirected(graph.nearest(p, 1).select("src", "tgt")), p)


@query(f"WITH RECURSIVE {BFS} SELECT CAST(hop AS INTEGER) AS hop, CAST(hop % 2 AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS nodes FROM hops GROUP BY ALL")
def hop_distance(spark, sf):
    p = points(spark, sf)
    h = graph.hops(graph.undirected(graph.nearest(p, 1).select("src", "tgt")), p)
    return h.groupBy("hop", (F.col("hop") % 2).alias("fold")).agg(F.count("*").alias("nodes"))


@query(f"""WITH {KNN}, f AS (SELECT node, node % 5 AS fold FROM pts), m AS (SELECT src, tgt FROM und UNION ALL SELECT tgt, src FROM und),
o AS (SELECT m.src, m.tgt, a.fold FROM m JOIN f a ON a.node = m.src JOIN f b ON b.node = m.tgt WHERE a.fold <> b.fold), c AS (SELECT src, count(*) AS n FROM o GROUP BY src),
v AS (SELECT vec_id AS node, generate_subscripts(embedding[1:3], 1) - 1 AS term, CAST(unnest(embedding[1:3]) AS DOUBLE) AS x FROM embeddings)
SELECT o.src AS node, o.fold, CAST(term AS INTEGER) AS term, round(sum(x) / n, 6) AS x FROM o JOIN c USING (src) JOIN v ON v.node = o.tgt GROUP BY o.src, o.fold, term, n""")
def fold_interpolate(spark, sf):
    p = points(spark, sf)
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.posexplode(F.slice("embedding", 1, 3)).alias("term", "x")).withColumn("x", F.col("x").cast("double"))
    return graph.interpolated(v, knn_edges(spark, sf), p.select("node", (F.col("node") % 5).alias("fold"))).select("node", "fold", "term", r6("x").alias("x"))


@query(f"WITH {KNN}, u AS (SELECT und.*, exp(-0.1 * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS w FROM und JOIN pts a ON a.node = src JOIN pts b ON b.node = tgt) SELECT round(sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * sqrt(w)) / (SELECT count(*) FROM embeddings), 6) AS jump FROM u JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = tgt")
def edge_jump(spark, sf):
    e = graph.exp_weights(knn_edges(spark, sf), points(spark, sf))
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    return graph.jump(e, v).select(r6("jump").alias("jump"))


@query(f"WITH {NN1} SELECT CAST(row_number() OVER (ORDER BY src, tgt) - 1 AS BIGINT) AS edge_id, src, tgt, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS difference FROM und JOIN pts a ON a.node = src JOIN pts b ON b.node = tgt")
def difference_matrix(spark, sf):
    p = points(spark, sf)
    e = graph.with_ends(graph.undirected(graph.nearest(p, 1).select("src", "tgt")), p, "x", "y")
    return number_rows(e, "src", "tgt", name="edge_id").select("edge_id", "src", "tgt", r6(F.sqrt(graph.squared_distance())).alias("difference"))


@query()
def voronoi_tree_length(spark, sf):
    p = points(spark, sf).select(F.col("topic").alias("sample_id"), "node", "x", "y")
    return graph.voronoi_graph(p).groupBy("sample_id").agg(F.count("*").alias("edges"), r6(F.sum("distance")).alias("total"))


# smoothness


WEIGHTED = KNN + ", w AS (SELECT src, tgt, exp(-0.1 * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS weight, a.topic AS ta, b.topic AS tb FROM und JOIN pts a ON a.node = src JOIN pts b ON b.node = tgt), mu AS (SELECT avg(topic) AS m, count(*) AS n FROM pts), ss AS (SELECT sum(pow(topic - m, 2)) AS s FROM pts, mu)"


@query(f"WITH {WEIGHTED} SELECT round(n * sum(weight * (ta - m) * (tb - m)) / (s * sum(weight)), 6) AS moran, CAST(count(*) AS BIGINT) AS edges FROM w, mu, ss GROUP BY n, s")
def moran_global(spark, sf):
    p = points(spark, sf)
    return metrics.moran(p, graph.exp_weights(knn_edges(spark, sf), p)).select(r6("moran").alias("moran"), "edges")


@query(f"WITH {WEIGHTED}, v AS (SELECT src AS node, weight * (ta - m) * (tb - m) AS v FROM w, mu UNION ALL SELECT tgt, weight * (ta - m) * (tb - m) FROM w, mu) SELECT node, round(n * sum(v) / (2 * s), 6) AS moran FROM v, mu, ss GROUP BY node, n, s")
def moran_local(spark, sf):
    p = points(spark, sf)
    return metrics.moran_local(p, graph.exp_weights(knn_edges(spark, sf), p)).select("node", r6("moran").alias("moran"))


@query(f"WITH {WEIGHTED}, d AS (SELECT src, tgt, CASE WHEN ta <> tb THEN 1.0 ELSE 0.0 END AS d FROM w), a AS (SELECT src AS node, avg(d) AS r FROM d GROUP BY src), b AS (SELECT tgt AS node, avg(d) AS r FROM d GROUP BY tgt) SELECT round(1 - avg(CASE WHEN coalesce(a.r, 0) + coalesce(b.r, 0) >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS pas FROM a FULL JOIN b USING (node)")
def pas(spark, sf):
    p = points(spark, sf)
    return metrics.pas(p.withColumn("topic", F.col("topic")), knn_edges(spark, sf)).select(r6("pas").alias("pas"))


@query(f"WITH {PAIRS} SELECT round(1 - sum(CASE WHEN a.topic = b.topic THEN distance ELSE 0 END) / (SELECT count(*) FROM pts), 6) AS chaos FROM ranked JOIN pts a ON a.node = src JOIN pts b ON b.node = tgt WHERE rank = 1")
def chaos(spark, sf):
    p = points(spark, sf)
    return metrics.chaos(p, graph.nearest(p, 1)).select(r6("chaos").alias("chaos"))


@query(f"WITH {WEIGHTED}, d AS (SELECT src AS node, CASE WHEN ta <> tb THEN 1.0 ELSE 0.0 END AS d FROM w UNION ALL SELECT tgt, CASE WHEN ta <> tb THEN 1.0 ELSE 0.0 END FROM w) SELECT node, round(avg(d), 6) AS rate FROM d GROUP BY node")
def neighbour_mismatch(spark, sf):
    return metrics.mismatch(points(spark, sf), knn_edges(spark, sf)).select("node", r6("rate").alias("rate"))


# linear algebra


@query(f"WITH {BRANDS_X} SELECT a.term AS t1, b.term AS t2, round(sum(a.x * b.x), 6) AS v FROM bx a JOIN bx b USING (doc_id) WHERE a.term <= b.term GROUP BY ALL")
def gram(spark, sf):
    return linalg.gram_long(C.normalise(brands(spark, sf))).select("t1", "t2", r6("v").alias("v"))


@query(f"WITH {BRANDS_X}, nn AS (SELECT avg(s) AS m FROM (SELECT sum(n) AS s FROM brands GROUP BY doc_id)), cs AS (SELECT term, sum(x) AS c FROM bx GROUP BY term) SELECT a.term AS t1, b.term AS t2, round(sum(a.x * b.x) - max(CASE WHEN a.term = b.term THEN c / m ELSE 0 END), 6) AS v FROM bx a JOIN bx b USING (doc_id) JOIN cs ON cs.term = a.term, nn WHERE a.term <= b.term GROUP BY ALL")
def init_covariance(spark, sf):
    counts = brands(spark, sf)
    vocab = C.vocabulary(counts, 1000).persist()
    names = [r["term"] for r in vocab.orderBy("term_id").collect()]
    g, s, _ = linalg.gram(linalg.rows(C.normalise(counts), vocab), len(names))
    m = C.mean_length(counts).first()["mean_length"]
    g = g - np.diag(s / m)
    rows = [(min(names[i], names[j]), max(names[i], names[j]), float(g[i, j])) for i in range(len(names)) for j in range(i, len(names))]
    return spark.createDataFrame(rows, "t1 string, t2 string, v double").withColumn("v", r6("v"))


@query(f"WITH {BRANDS_X} SELECT term, round(sum(x * CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS v0, round(sum(x * CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END), 6) AS v1, round(sum(x * CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END), 6) AS v2 FROM bx GROUP BY term")
def xtu(spark, sf):
    counts = brands(spark, sf)
    vocab = C.vocabulary(counts, 1000).persist()
    names = [r["term"] for r in vocab.orderBy("term_id").collect()]
    u = counts.select("doc_id").distinct().select("doc_id", F.array(*[(F.col("doc_id") % 3 == i).cast("double") for i in range(3)]).alias("u"))
    m = linalg.cross(linalg.rows(C.normalise(counts), vocab), u, len(names), 3)
    return spark.createDataFrame([(names[i], *map(float, m[i])) for i in range(len(names))], "term string, v0 double, v1 double, v2 double").select("term", *[r6(f"v{i}").alias(f"v{i}") for i in range(3)])


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding[1:5], 1) AS i, 3 * CAST(unnest(embedding[1:5]) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT *, row_number() OVER w AS r, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY v DESC)),
th AS (SELECT vec_id, arg_max((c - 1) / r, r) AS theta FROM s WHERE v > (c - 1) / r GROUP BY vec_id)
SELECT vec_id AS node, CAST(i - 1 AS INTEGER) AS topic, round(greatest(v - theta, 0), 6) AS w FROM e JOIN th USING (vec_id)""")
def simplex_projection(spark, sf):
    v = F.transform(F.slice("embedding", 1, 5), lambda x: 3 * x.cast("double"))
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.posexplode(project(v)).alias("topic", "w")).withColumn("w", r6("w"))


_B = ilr_basis(3).tolist()


@query(f"WITH {BRANDS}, s AS (SELECT doc_id, sum(n) FILTER (term < 'Brand#2') AS a, sum(n) FILTER (term >= 'Brand#2' AND term < 'Brand#4') AS b, sum(n) FILTER (term >= 'Brand#4') AS c FROM brands GROUP BY doc_id), l AS (SELECT doc_id, ln(a / (a + b + c)) AS a, ln(b / (a + b + c)) AS b, ln(c / (a + b + c)) AS c FROM s) SELECT doc_id, round(a - (a + b + c) / 3, 6) AS clr1, round({_B[0][0]!r} * a + {_B[1][0]!r} * b, 6) AS ilr1, round({_B[0][1]!r} * a + {_B[1][1]!r} * b + {_B[2][1]!r} * c, 6) AS ilr2 FROM l")
def ilr_clr(spark, sf):
    b = brands(spark, sf)
    part = lambda c: F.sum(F.when(c, F.col("n")))
    s = b.groupBy("doc_id").agg(F.array(part(F.col("term") < "Brand#2"), part((F.col("term") >= "Brand#2") & (F.col("term") < "Brand#4")), part(F.col("term") >= "Brand#4")).alias("n"))
    w = s.withColumn("w", F.transform("n", lambda x: x / (F.col("n")[0] + F.col("n")[1] + F.col("n")[2])))
    return w.select("doc_id", r6(clr(F.col("w"))[0]).alias("clr1"), r6(ilr(F.col("w"), 3)[0]).alias("ilr1"), r6(ilr(F.col("w"), 3)[1]).alias("ilr2"))


@query(f"WITH {KNN}, p AS (SELECT sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS rough FROM und JOIN pts a ON a.node = src JOIN pts b ON b.node = tgt), g AS (SELECT 0 AS i, 1e-6 AS lam UNION ALL SELECT range + 1, 1e-4 * pow(1.2, range) FROM range(29)) SELECT CAST(i AS INTEGER) AS i, round(lam, 6) AS lam, round(lam * rough, 6) AS penalty FROM g, p")
def lambda_grid(spark, sf):
    """The penalty that each strength of the search puts on the raw coordinates along the neighbour graph."""
    e = graph.with_ends(knn_edges(spark, sf), points(spark, sf), "x", "y").agg(F.sum(F.sqrt(graph.squared_distance())).alias("rough"))
    grid = spark.createDataFrame(list(enumerate(GraphTopics(2).lambdas())), "i int, lam double")
    return grid.crossJoin(e).select("i", r6("lam").alias("lam"), r6(F.col("lam") * F.col("rough")).alias("penalty"))  # one row on the right


# outcomes


@query("""WITH s AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id)), r AS (SELECT label, avg(pos) OVER (PARTITION BY score) AS mid FROM (SELECT *, row_number() OVER (ORDER BY score) AS pos FROM s))
SELECT round((sum(mid) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc, CAST(count(*) FILTER (label = 1) AS BIGINT) AS positives, CAST(count(*) FILTER (label = 0) AS BIGINT) AS negatives FROM r""")
def auc_ranksum(spark, sf):
    s = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    return survival.auc(s).select(r6("auc").alias("auc"), "positives", "negatives")


@query("""WITH s AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id)), tot AS (SELECT sum(label) AS p, sum(1 - label) AS q FROM s),
pts AS (SELECT sum(sum(label)) OVER w / max(p) AS sens, 1 - sum(sum(1 - label)) OVER w / max(q) AS spec FROM s, tot GROUP BY score WINDOW w AS (ORDER BY score DESC))
SELECT round(i / 25, 6) AS sensitivity, round(max(spec), 6) AS specificity FROM range(26) g(i) JOIN pts ON floor(sens * 25 + 1e-9) >= i GROUP BY i""")
def roc_curve(spark, sf):
    s = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    return survival.roc(s).select(r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


OUTCOMES = "cust AS (SELECT o_custkey, date_diff('day', DATE '1992-01-01', CAST(min(o_orderdate) AS DATE)) // 30 AS time, CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS event, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey), s AS (SELECT c_mktsegment AS grp, CAST(time AS BIGINT) AS time, event, spent FROM cust JOIN customer ON c_custkey = o_custkey)"


def outcomes(spark, sf):
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.floor(F.datediff(F.min("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 30).cast("long").alias("time"), F.max((F.col("o_orderstatus") == "F").cast("long")).alias("event"), F.sum("o_totalprice").alias("spent"))
    return o.join(t(spark, sf, "customer"), "c_custkey").select(F.col("c_mktsegment").alias("grp"), "c_custkey", "time", "event", "spent")


@query(f"""WITH {OUTCOMES}, a AS (SELECT grp, time, sum(event) AS d, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS risk FROM a)
SELECT grp, time, CAST(risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(exp(sum(CASE WHEN d = risk THEN -745 ELSE ln(1 - d / risk) END) OVER (PARTITION BY grp ORDER BY time)), 6) AS survival FROM r WHERE d > 0""")
def km_curve(spark, sf):
    return survival.kaplan_meier(outcomes(spark, sf), "time", "event", "grp").select("grp", "time", "at_risk", "events", r6("survival").alias("survival"))


@query("SELECT source AS region_id, " + ", ".join(f"round(avg(CASE WHEN lang = '{x}' THEN 1.0 ELSE 0.0 END), 6) AS \"Topic{i}\"" for i, x in enumerate(("de", "en", "es", "fr"))) + ", CAST(max(quality) AS INTEGER) AS primary_outcome FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING max(quality) IS NOT NULL")
def survival_join(spark, sf):
    docs, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    number = F.create_map(*[F.lit(x) for i, v in enumerate(("de", "en", "es", "fr")) for x in (v, i)])
    topics = docs.select(F.col("source").alias("region_id"), number[F.col("lang")].alias("topic"))
    meta = docs.join(labels, "doc_id").groupBy(F.col("source").alias("region_id")).agg(F.max("quality").alias("primary_outcome")).where("primary_outcome IS NOT NULL")
    s = pipelines.survival_table(topics, meta, 4)
    return s.select("region_id", *[r6(f"Topic{i}").alias(f"Topic{i}") for i in range(4)], "primary_outcome")


@query(f"WITH {OUTCOMES} SELECT grp, CASE WHEN spent <= 1000000 THEN 'low' ELSE 'high' END AS half, CAST(count(*) AS BIGINT) AS n, CAST(sum(event) AS BIGINT) AS events FROM s GROUP BY ALL")
def dichotomise(spark, sf):
    return survival.dichotomised(outcomes(spark, sf), "spent", 1_000_000.0, "half").groupBy("grp", "half").agg(F.count("*").alias("n"), F.sum("event").alias("events"))


@query(f"""WITH {OUTCOMES}, z AS (SELECT count(*) AS n FROM s), c AS (SELECT spent AS cut, count(*) AS here FROM s GROUP BY spent), f AS (SELECT cut FROM (SELECT cut, sum(here) OVER (ORDER BY cut) AS low FROM c), z WHERE low >= 0.1 * n AND n - low >= 0.1 * n),
r AS (SELECT cut, time, sum(event) AS d, sum(CASE WHEN spent <= cut THEN event ELSE 0 END) AS d1, count(*) AS c, sum(CASE WHEN spent <= cut THEN 1 ELSE 0 END) AS c1 FROM f, s GROUP BY cut, time),
k AS (SELECT cut, d, d1, CAST(sum(c) OVER w AS DOUBLE) AS n, CAST(sum(c1) OVER w AS DOUBLE) AS n1 FROM r WINDOW w AS (PARTITION BY cut ORDER BY time DESC)),
x AS (SELECT cut, sum(d1 - d * n1 / n) AS o, sum(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM k WHERE d > 0 GROUP BY cut)
SELECT round(cut, 2) AS cut, round(o * o / v, 6) AS statistic FROM x WHERE v > 1e-9 ORDER BY round(o * o / v, 9) DESC, cut LIMIT 1""")
def logrank_cut(spark, sf):
    return survival.logrank_cutpoint(outcomes(spark, sf), "spent").select(F.round("cut", 2).alias("cut"), r6("statistic").alias("statistic"))


def _newton(steps: int, start: str, step: str) -> str:
    """CTEs n0..n{steps}: each round of Newton's method as a query of the one before."""
    return f"n0 AS ({start})" + "".join(f", n{i + 1} AS ({step.replace('PREVIOUS', f'n{i}')})" for i in range(steps))


COX_STEP = """SELECT max(b) + sum(e1 - d * s1 / s0) / sum(d * (s2 / s0 - s1 * s1 / (s0 * s0))) AS b, sum(d * (s2 / s0 - s1 * s1 / (s0 * s0))) AS h FROM (
SELECT max(b) AS b, sum(event) AS d, sum(event * x) AS e1, sum(sum(exp(b * x))) OVER w AS s0, sum(sum(exp(b * x) * x)) OVER w AS s1, sum(sum(exp(b * x) * x * x)) OVER w AS s2 FROM a, PREVIOUS GROUP BY time WINDOW w AS (ORDER BY time DESC))"""


@query(f"""WITH {OUTCOMES}, l AS (SELECT time, event, ln(spent) AS x FROM s), m AS (SELECT avg(x) AS mean, stddev_pop(x) AS size FROM l), a AS (SELECT time, event, (x - mean) / size AS x FROM l, m),
{_newton(9, "SELECT CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS h", COX_STEP)}
SELECT 'log_spent' AS name, round(b / size, 6) AS value, round(1 / sqrt(h) / size, 6) AS error FROM n9, m""")
def cox_spending(spark, sf):
    """Coefficient of the logarithm of what customers spent on the month of their first order, and its standard error."""
    rows = outcomes(spark, sf).withColumn("log_spent", F.log("spent"))
    m = survival.cox_model(rows, ["log_spent"], ridge=0.0)
    return m.select("name", r6("value").alias("value"), r6("error").alias("error"))


LOGISTIC_STEP = """SELECT b0 + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS b0, b1 + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) AS b1 FROM (
SELECT max(b0) AS b0, max(b1) AS b1, sum(y - p) - 1e-6 * max(b0) AS g0, sum((y - p) * x) - 1e-6 * max(b1) AS g1, sum(p * (1 - p)) + 1e-6 AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 1e-6 AS h11
FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM a, PREVIOUS))"""


@query(f"""WITH a AS (SELECT ln(n_chars + 1) AS x, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id)),
{_newton(12, "SELECT CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1", LOGISTIC_STEP)}
SELECT 'intercept' AS name, round(b0, 6) AS value FROM n12 UNION ALL SELECT 'length', round(b1, 6) FROM n12""")
def logistic_shares(spark, sf):
    x = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select(F.log(F.col("n_chars") + 1).alias("length"), F.col("quality").alias("label"))
    b = survival.logistic(x, ["length"])
    return spark.createDataFrame([("intercept", float(b[0])), ("length", float(b[1]))], "name string, value double").withColumn("value", r6("value"))


# models


def _model_tokens(spark, sf, size: int | None = None) -> DataFrame:
    """Counts of the documents with ten tokens or more; size: of the commonest terms only, for methods that hold topics x terms densely."""
    tokens = materialise(doc_tokens(spark, sf), "tokens")
    own = tokens if size is None else tokens.join(F.broadcast(C.vocabulary(tokens, size).select("term")), "term", "left_semi")  # `size` rows
    kept = materialise(C.filter_docs(own, 10), "counts")
    release(tokens)
    return kept


@query()
def plsi_topics(spark, sf):
    """The flagship: documents' topics by the plain model, over all terms."""
    m = GraphTopics(4).fit(_model_tokens(spark, sf), keep=False)
    return m.topics().select("doc_id", "topic", r6("weight").alias("weight"))


def _located(spark, sf, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts and a neighbour graph of the documents that share an id with an embedding."""
    p = points(spark, sf)
    counts = _model_tokens(spark, sf, size).join(p.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    nodes = p.join(counts.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    return counts, graph.undirected(graph.rbf_graph(nodes))


@query()
def graph_topics(spark, sf):
    counts, edges = _located(spark, sf)
    m = GraphTopics(4, "graph").fit(counts, edges)
    return m.topics().select("doc_id", "topic", r6("weight").alias("weight"))


@query()
def lambda_cv(spark, sf):
    counts, edges = _located(spark, sf)
    g = GraphTopics(3, "graph", grid=8, step=2.5, rounds=1)
    m = g.fit(counts, edges)
    return spark.createDataFrame([(e["round"], i, lam, float(e["totals"][i])) for e in m.errors for i, lam in enumerate(g.lambdas())], "round int, i int, lam double, err double").select("round", "i", r6("lam").alias("lam"), r6("err").alias("err"))


@query()
def lda_topics(spark, sf):
    w, _, _, _ = pipelines.fit_method("lda", _model_tokens(spark, sf, 200), None, 4, rounds=8)
    return w.select("doc_id", argmax(F.col("w")).alias("topic"), r6(F.array_max("w")).alias("weight"))


@query()
def spatial_lda_topics(spark, sf):
    counts, edges = _located(spark, sf, 200)
    w, _, _, _ = pipelines.fit_method("spatial_lda", counts, edges, 3, rounds=2, lda_rounds=3)
    return w.select("doc_id", argmax(F.col("w")).alias("topic"), r6(F.array_max("w")).alias("weight"))


@query()
def topicscore_topics(spark, sf):
    w, _, _, _ = pipelines.fit_method("topicscore", _model_tokens(spark, sf, 200), None, 4)
    return w.select("doc_id", argmax(F.col("w")).alias("topic"), r6(F.array_max("w")).alias("weight"))


@query()
def method_comparison(spark, sf):
    counts, edges = _located(spark, sf, 200)
    return pipelines.compare(counts, edges, 3, points(spark, sf), ("plain", "lda"), lda={"rounds": 5}).where("metric <> 'seconds'").withColumn("value", r6("value"))


@query()
def fold_stability(spark, sf):
    counts = _model_tokens(spark, sf, 100)
    units = t(spark, sf, "documents").select("doc_id", F.col("source").alias("region_id"))
    none = spark.createDataFrame([], "src long, tgt long, weight double")
    return pipelines.choose_k(counts, none, units, [2, 3], folds=3)


@query()
def simulate_recovery(spark, sf):
    """A simulated corpus of the size of suppliers x brands: as many documents and terms, of the mean length."""
    b = brands(spark, sf)
    size = b.agg(F.countDistinct("doc_id").alias("n"), F.countDistinct("term").alias("p")).first()
    length = int(C.mean_length(b).first()["mean_length"])
    return pipelines.simulate_trial(spark, N=length, n=size["n"], K=3, p=size["p"], seed=1, methods=("plain", "graph", "lda", "topicscore"), graph={"grid": 6, "step": 3.0, "rounds": 2}, lda={"rounds": 5}).where("metric <> 'time'").withColumn("value", r6("value"))


@query(f"WITH {BRANDS_X} SELECT CAST(count(DISTINCT term) AS INTEGER) AS terms, round(sum(x * x), 6) AS energy FROM bx")
def svd_energy(spark, sf):
    """All squared singular values of suppliers x brands, found without the matrix of terms x terms: their sum is that of all squares."""
    b = brands(spark, sf)
    vocab, p = C.all_terms(b)
    _, values = linalg.leading(materialise(linalg.rows(C.normalise(b), vocab), "rows"), p, p)
    return spark.createDataFrame([(p, float(values.sum()))], "terms int, energy double").withColumn("energy", r6("energy"))


METHOD_SUMS = " UNION ALL ".join(f"SELECT '{m}' AS method, documents, CAST(documents AS DOUBLE) AS weights, CAST(4 AS DOUBLE) AS topics FROM d" for m in ("plain", "graph", "lda", "spatial_lda", "topicscore"))


@query(f"WITH {BRANDS}, d AS (SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM brands) {METHOD_SUMS}")
def method_invariants(spark, sf):
    """Of each method's factors: the documents it gives weights to, and the sums of all weights and of all topics, which are shares."""
    b = materialise(brands(spark, sf), "brands")
    items = b.select(F.col("doc_id").alias("node"), F.col("term").alias("token"))
    edges = materialise(graph.undirected(graph.shared_counts(items, 25).select("src", "tgt")).withColumn("weight", F.lit(1.0)), "edges")
    options = {"graph": {"lam": 0.01, "rounds": 1}, "lda": {"rounds": 2}, "spatial_lda": {"rounds": 1, "lda_rounds": 2}}
    outs = []
    for m in pipelines.METHODS:
        w, a, _, _ = pipelines.fit_method(m, b, edges, 4, **options.get(m, {}))
        own = w.select(F.aggregate("w", F.lit(0.0), lambda s, v: s + v).alias("s"))
        outs.append(own.agg(F.lit(m).alias("method"), F.count("*").alias("documents"), r6(F.sum("s")).alias("weights"), F.lit(round(float(a.sum()), 6)).alias("topics")))
    return reduce(DataFrame.unionByName, outs)


CELLS = "cell AS (SELECT node, topic % 3 AS sample_id, x, y FROM pts), box AS (SELECT sample_id, min(x) AS x0, min(y) AS y0, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS side FROM cell GROUP BY sample_id), unit AS (SELECT sample_id, node, (x - x0) / side AS x, (y - y0) / side AS y FROM cell JOIN box USING (sample_id))"


def _samples(spark, sf):
    """Three samples of embeddings in a store, of which two are read back."""
    p = points(spark, sf).withColumn("sample_id", F.col("topic") % 3)
    of = p.select("node", "sample_id")
    ends = graph.with_ends(knn_edges(spark, sf), of, "sample_id").where("sample_id_src = sample_id_tgt").select(F.col("sample_id_src").alias("sample_id"), "src", "tgt")
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.posexplode(F.slice("embedding", 3, 8)).alias("i", "v"))
    counts = e.join(of, "node").select("sample_id", "node", F.concat(F.lit("t"), "i").alias("term"), F.floor(F.abs("v") * 100).cast("long").alias("n")).where("n > 0")
    path = f"{shared_dir(spark)}/sample-store-{uuid.uuid4().hex}"
    samples.write_samples(path, counts, p, ends)
    return samples.read_samples(spark, path, spark.createDataFrame([(0,), (2,)], "sample_id int"))


@query(f"WITH {KNN}, {CELLS} SELECT concat(u.sample_id, ':', src) AS src, concat(u.sample_id, ':', tgt) AS tgt, round(exp(-0.1 * (pow(u.x - v.x, 2) + pow(u.y - v.y, 2))), 6) AS weight FROM und JOIN unit u ON u.node = src JOIN unit v ON v.node = tgt WHERE u.sample_id = v.sample_id AND u.sample_id <> 1")
def sample_edges(spark, sf):
    """Edges of two of three samples, each normalised to its own unit square, ends in the order of their names."""
    _, _, edges = pipelines.preprocess_samples(*_samples(spark, sf))
    swap = F.substring_index("src", ":", -1).cast("long") > F.substring_index("tgt", ":", -1).cast("long")
    return edges.select(F.when(swap, F.col("tgt")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("tgt")).alias("tgt"), r6("weight").alias("weight"))


@query()
def topic_alignment(spark, sf):
    """Where each label's mean vector of the even rows finds itself among those of the odd rows."""
    e = t(spark, sf, "embeddings").select("label", (F.col("vec_id") % 2).alias("half"), F.posexplode("embedding").alias("i", "v")).groupBy("half", "label", "i").agg(F.avg("v").alias("a")).toPandas()
    a, b = (e[e["half"] == h].pivot(index="label", columns="i", values="a").to_numpy() for h in (0, 1))
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(align.mapping(a, b, signed=True).argmax(1))], "label int, matched int")


# smaller operators


@query("WITH f AS (SELECT DISTINCT doc_id % 4 AS fold FROM documents) SELECT CAST(a.fold AS BIGINT) AS a, CAST(b.fold AS BIGINT) AS b FROM f a JOIN f b ON a.fold < b.fold")
def fold_pairs(spark, sf):
    f = t(spark, sf, "documents").select((F.col("doc_id") % 4).alias("fold")).distinct()
    return f.select(F.col("fold").alias("a")).join(f.select(F.col("fold").alias("b")), F.col("a") < F.col("b"))


@query(f"WITH {NN1} SELECT src, tgt FROM mirrored")
def mirrored_edges(spark, sf):
    return graph.both_ways(graph.undirected(graph.nearest(points(spark, sf), 1).select("src", "tgt")))


@query(f"WITH {TOKENS} SELECT term, CAST(row_number() OVER (ORDER BY sum(n) DESC, term) - 1 AS INTEGER) AS term_id FROM tokens GROUP BY term QUALIFY row_number() OVER (ORDER BY sum(n) DESC, term) <= 200")
def vocabulary_top(spark, sf):
    return C.vocabulary(doc_tokens(spark, sf), 200)


@query("SELECT DISTINCT p_type AS term FROM part WHERE p_type NOT IN (SELECT p_type FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_suppkey = 1)")
def unmapped_terms(spark, sf):
    """Part types that the first supplier never delivered."""
    held = t(spark, sf, "lineitem").where("l_suppkey = 1").select(F.col("l_partkey").alias("p_partkey")).join(t(spark, sf, "part"), "p_partkey").select(F.col("p_type").alias("term"))
    return t(spark, sf, "part").select(F.col("p_type").alias("term")).distinct().join(held, "term", "left_anti")


@query("""WITH n AS (SELECT o_custkey AS cell_id, count(*) AS total FROM orders GROUP BY 1 HAVING count(*) >= 12)
SELECT c_nationkey AS region_id, o_orderpriority AS term, CAST(count(*) AS BIGINT) AS n FROM orders JOIN n ON cell_id = o_custkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def region_min_count(spark, sf):
    o = t(spark, sf, "orders").join(t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region_id")), "o_custkey")
    counts = o.groupBy("region_id", F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("term")).agg(F.count("*").alias("n"))
    xy = counts.select("region_id", "cell_id").distinct().withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    kept, _, _ = C.prune_regions(counts, xy, xy.select("region_id", F.col("cell_id").alias("src"), F.col("cell_id").alias("tgt")), 12)
    return kept.groupBy("region_id", "term").agg(F.sum("n").alias("n"))


@query("""WITH p AS (SELECT vec_id AS node, label % 2 AS sample_id, label = 3 AS marked, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS m FROM embeddings)
SELECT a.sample_id, a.node AS anchor, CAST(sum(CASE WHEN b.m > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS m, CAST(count(*) AS BIGINT) AS neighbours FROM p a JOIN p b ON a.sample_id = b.sample_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.06 * 0.06 WHERE a.marked GROUP BY ALL""")
def marked_cell_features(spark, sf):
    e = F.col("embedding")
    p = t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), (F.col("label") % 2).alias("sample_id"), (F.col("label") == 3).alias("marked"), *[e[i].cast("double").alias(c) for i, c in enumerate("xym")])
    return features.featurise(p, "marked", [*features.marker_counts(["m"], 0.05), *features.neighbour_count()], 0.06)


@query("""WITH p AS (SELECT vec_id AS node, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), q AS (SELECT quantile_cont(a, 0.05) AS a0, quantile_cont(a, 0.97) AS a1, quantile_cont(b, 0.05) AS b0, quantile_cont(b, 0.97) AS b1 FROM p),
c AS (SELECT node, least(1, greatest(0, (a - a0) / (a1 - a0))) AS a, least(1, greatest(0, (b - b0) / (b1 - b0))) AS b FROM p, q)
SELECT node, round(a, 6) AS a, round(b, 6) AS b, round(pow((pow(a, 5) + pow(b * 0.5, 5)) / 2, 0.2), 6) AS red FROM c""")
def false_colour(spark, sf):
    e = F.col("embedding")
    p = t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), e[0].cast("double").alias("a"), e[1].cast("double").alias("b"))
    c = features.blended(features.clipped_channels(p, ["a", "b"]), {"a": (1.0, 0.0, 0.0), "b": (0.5, 0.5, 0.0)})
    return c.select("node", r6("a").alias("a"), r6("b").alias("b"), r6("red").alias("red"))


@query("SELECT o_orderpriority AS method, CAST(o_custkey % 7 AS BIGINT) AS point, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY ALL")
def grid_means(spark, sf):
    return t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 7).alias("point")).agg(r6(F.avg("o_totalprice")).alias("mean"))


@query()
def graph_factor_topics(spark, sf):
    """(topic, term, a): topics of the plain model taken from its factors alone."""
    m = GraphTopics(3).fit(_model_tokens(spark, sf, 50))
    m.a = m.factor_topics()
    return m.terms().withColumn("a", r6("a"))


@query(f"""WITH RECURSIVE {WEIGHTED}, e AS (SELECT src, tgt, weight, row_number() OVER (ORDER BY weight, src, tgt) AS k FROM w), m AS (SELECT k, src, tgt FROM e UNION ALL SELECT k, tgt, src FROM e),
reach(k, node) AS (SELECT k, src FROM e UNION SELECT reach.k, m.tgt FROM reach JOIN m ON m.src = reach.node AND m.k < reach.k)
SELECT src, tgt, round(weight, 6) AS weight FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.k = e.k AND reach.node = e.tgt)""")
def spanning_forest(spark, sf):
    e = graph.exp_weights(knn_edges(spark, sf), points(spark, sf))
    return graph.spanning_forest(e).select("src", "tgt", r6("weight").alias("weight"))


@query("SELECT vec_id AS node, CAST((row_number() OVER (ORDER BY md5('1/' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings")
def random_folds(spark, sf):
    return graph.random_folds(points(spark, sf).select("node"), 5)


@query()
def outcome_auc(spark, sf):
    """(repeat, auc) of logistic models of an event on group shares' log-ratio coordinates."""
    b = brands(spark, sf).groupBy("doc_id").pivot("term", ["Brand#11", "Brand#12", "Brand#13"]).agg(F.sum("n")).na.fill(1)
    z = survival.ilr_columns(b.withColumn("label", (F.col("doc_id") % 2).cast("int")), ["`Brand#11`", "`Brand#12`", "`Brand#13`"])
    return survival.repeated_auc(z, ["z1", "z2"], "label", "doc_id", 2).withColumn("auc", r6("auc"))
