"""Errors, agreement, spatial smoothness and summaries. Topics: (node, topic); factors: (doc, topic, w) in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import both_ways, with_ends


def factor_errors(truth: DataFrame, estimate: DataFrame, *keys: str, value: str = "w") -> DataFrame:
    """One row: Frobenius and L1 error; entries that either side lacks count as zero."""
    t, e = truth.select(*keys, F.col(value).alias("_t")), estimate.select(*keys, F.col(value).alias("_e"))
    d = F.coalesce("_t", F.lit(0.0)) - F.coalesce("_e", F.lit(0.0))
    return t.join(e, list(keys), "full").agg(F.sqrt(F.sum(d * d)).alias("frobenius"), F.sum(F.abs(d)).alias("l1"))


def accuracy(a: Column, b: Column) -> Column:
    return F.avg((a == b).cast("double"))


def cosines(a: DataFrame, b: DataFrame, term: str = "term") -> DataFrame:
    """(topic_a, topic_b, cosine) of all pairs of topics; a and b: (topic, term, a). As many pairs as topics squared."""
    na, nb = (df.groupBy("topic").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm")) for df in (a, b))
    dots = a.select(F.col("topic").alias("topic_a"), term, F.col("a").alias("va")).join(b.select(F.col("topic").alias("topic_b"), term, F.col("a").alias("vb")), term)
    dots = dots.groupBy("topic_a", "topic_b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    norms = na.select(F.col("topic").alias("topic_a"), F.col("norm").alias("x")).crossJoin(nb.select(F.col("topic").alias("topic_b"), F.col("norm").alias("y")))  # topics, not documents
    return norms.join(dots, ["topic_a", "topic_b"], "left").select("topic_a", "topic_b", F.coalesce(F.col("dot") / (F.col("x") * F.col("y")), F.lit(0.0)).alias("cosine"))


def _centred(topics: DataFrame) -> DataFrame:
    mean = topics.agg(F.avg("topic").alias("m"))  # one row
    return topics.crossJoin(F.broadcast(mean)).select("node", (F.col("topic") - F.col("m")).alias("z"))


def moran_local(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, moran): n * sum of w z z over the node's edges / (2 * sum of z^2); nodes without edges vanish."""
    z = _centred(topics)
    total = z.agg(F.sum(F.col("z") * F.col("z")).alias("s"), F.count("*").alias("n"))
    e = with_ends(edges, z, "z").withColumn("v", F.col("weight") * F.col("z_src") * F.col("z_tgt"))
    own = e.select(F.explode(F.array("src", "tgt")).alias("node"), "v").groupBy("node").agg(F.sum("v").alias("v"))
    return own.crossJoin(F.broadcast(total)).select("node", F.when(F.col("s") > 0, F.col("n") * F.col("v") / (2 * F.col("s"))).alias("moran"))


def moran(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: Moran's I of the topic index over the edges, each once; null where all topics are equal."""
    z = _centred(topics)
    total = z.agg(F.sum(F.col("z") * F.col("z")).alias("s"), F.count("*").alias("n"))
    e = with_ends(edges, z, "z").agg(F.sum(F.col("weight") * F.col("z_src") * F.col("z_tgt")).alias("v"), F.sum("weight").alias("w"), F.count("*").alias("edges"))
    return e.crossJoin(total).select(F.when((F.col("s") > 0) & (F.col("w") > 0), F.col("n") * F.col("v") / (F.col("s") * F.col("w"))).alias("moran"), "edges")


def pas(topics: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """One row: 1 - the share of nodes with an edge whose mismatch rates as src and as tgt sum to at least `least`."""
    e = with_ends(edges, topics, "topic").withColumn("d", (F.col("topic_src") != F.col("topic_tgt")).cast("double"))
    rates = [e.groupBy(F.col(end).alias("node")).agg(F.avg("d").alias(end)) for end in ("src", "tgt")]
    both = rates[0].join(rates[1], "node", "full").select((F.coalesce("src", F.lit(0.0)) + F.coalesce("tgt", F.lit(0.0))).alias("r"))
    return both.agg((1 - F.avg((F.col("r") >= least).cast("double"))).alias("pas"))


def chaos(topics: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row: 1 - the sum of nearest-neighbour distances between nodes of one topic, by the number of nodes.

    nearest: (src, tgt, distance) with one row for each node.
    """
    same = with_ends(nearest, topics, "topic").where("topic_src = topic_tgt").agg(F.coalesce(F.sum("distance"), F.lit(0.0)).alias("s"))
    return same.crossJoin(topics.agg(F.count("*").alias("n"))).select((1 - F.col("s") / F.col("n")).alias("chaos"))

def by_sample(topics: DataFrame, edges: DataFrame, nearest: DataFrame) -> DataFrame:
    """(sample_id, metric, value): Moran's I, PAS and CHAOS of every sample at once, as moran(), pas() and chaos() of one give them.

    topics: (sample_id, node, topic); edges: (sample_id, src, tgt, weight), each once; nearest: (sample_id, src, tgt, distance).
    """
    size = topics.groupBy("sample_id").agg(F.avg("topic").alias("m"), F.count("*").alias("n"), F.sum(F.col("topic").cast("double") * F.col("topic")).alias("s2"))
    size = size.select("sample_id", "m", "n", (F.col("s2") - F.col("n") * F.col("m") * F.col("m")).alias("s"))
    e = with_ends(edges, topics, "topic").join(size.select("sample_id", "m"), "sample_id")
    cross = F.sum(F.col("weight") * (F.col("topic_src") - F.col("m")) * (F.col("topic_tgt") - F.col("m")))
    pull = e.groupBy("sample_id").agg(cross.alias("v"), F.sum("weight").alias("w"))
    differ = (F.col("topic_src") != F.col("topic_tgt")).cast("double")
    rates = [e.groupBy("sample_id", F.col(end).alias("node")).agg(F.avg(differ).alias(end)) for end in ("src", "tgt")]
    both = rates[0].join(rates[1], ["sample_id", "node"], "full").select("sample_id", (F.coalesce("src", F.lit(0.0)) + F.coalesce("tgt", F.lit(0.0))).alias("r"))
    calm = both.groupBy("sample_id").agg((1 - F.avg((F.col("r") >= 0.6).cast("double"))).alias("pas"))
    same = with_ends(nearest, topics, "topic").where("topic_src = topic_tgt").groupBy("sample_id").agg(F.sum("distance").alias("d"))
    wide = size.join(pull, "sample_id", "left").join(calm, "sample_id", "left").join(same, "sample_id", "left").select(
        "sample_id",
        F.when((F.col("s") > 1e-9) & (F.col("w") > 0), F.col("n") * F.col("v") / (F.col("s") * F.col("w"))).alias("moran"),
        "pas",
        (1 - F.coalesce("d", F.lit(0.0)) / F.col("n")).alias("chaos"),
    )
    return wide.unpivot("sample_id", ["moran", "pas", "chaos"], "metric", "value")


def mismatch(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rate): share of a node's neighbours with another topic."""
    e = with_ends(both_ways(edges.select("src", "tgt")), topics, "topic")
    return e.groupBy(F.col("src").alias("node")).agg(F.avg((F.col("topic_src") != F.col("topic_tgt")).cast("double")).alias("rate"))


def quartiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, median, half_iqr) by linear interpolation."""
    p = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    return p.select(*keys, F.col("p")[1].alias("median"), ((F.col("p")[2] - F.col("p")[0]) / 2).alias("half_iqr"))


def shares(df: DataFrame, region: str, topic: str, topics: list) -> DataFrame:
    """(region, Topic0..): the share of each topic among a region's rows, zeros filled in."""
    total = df.groupBy(region).agg(F.count("*").alias("total"))
    wide = df.groupBy(region).pivot(topic, topics).count().join(total, region)
    return wide.select(region, *[(F.coalesce(F.col(f"`{t}`"), F.lit(0)) / F.col("total")).alias(f"Topic{t}") for t in topics])


def zscores(a: DataFrame) -> DataFrame:
    """(topic, term, z): each term centred and scaled over the topics; a constant term gives zero."""
    w = Window.partitionBy("term")
    sd = F.stddev_pop("a").over(w)
    return a.select("topic", "term", F.when(sd > 0, (F.col("a") - F.avg("a").over(w)) / sd).otherwise(0.0).alias("z"))


def top_words(a: DataFrame, k: int = 10) -> DataFrame:
    """(topic, rank, term, a): each topic's heaviest terms, ties by term."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("a"), "term"))
    return a.withColumn("rank", rank).where(F.col("rank") <= k).select("topic", "rank", "term", "a")
