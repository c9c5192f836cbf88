"""From texts, baskets and joins to document x term counts: all in long form, (doc, term, n), zeros left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.running import number_rows
from loomgraph.schemas import require
from loomgraph.shared import materialise, release

#: Terms up to which a vocabulary is numbered by one task, and broadcast.
FEW_TERMS = 1 << 14
#: Terms of which a filter broadcasts the names, so that most rows stay where they are.
COMMON_TERMS = 1 << 17


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters of at least `least` characters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: F.length(t) >= least)


def term_counts(docs: DataFrame, terms: Column, *keys: str) -> DataFrame:
    """(keys, term, n) of an array column."""
    return docs.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def canonical(tokens_: Column, mapping: Column) -> Column:
    """Each token, or its canonical form where the map has one."""
    return F.transform(tokens_, lambda t: F.coalesce(mapping[t], t))


def fold_case(counts: DataFrame) -> DataFrame:
    """Counts with terms lower-cased, so that a vocabulary in any case meets its tokens."""
    return counts.withColumn("term", F.lower("term")).groupBy(*[c for c in counts.columns if c != "n"]).agg(F.sum("n").alias("n"))


def normalise(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """x = n / the document's total; documents without counts vanish."""
    require(counts, doc, "n")
    totals = counts.groupBy(doc).agg(F.sum("n").alias("total")).where("total > 0")
    return counts.join(totals, doc).withColumn("x", F.col("n") / F.col("total")).drop("total")


def mean_length(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    return counts.groupBy(doc).agg(F.sum("n").alias("total")).agg(F.avg("total").alias("mean_length"), F.max("total").cast("long").alias("max_length"), F.count("*").alias("docs"))


def filter_docs(counts: DataFrame, least: int = 10, doc: str = "doc_id") -> DataFrame:
    """Counts of the documents with at least `least` counts."""
    # the short documents, which are mostly few, go, so the counts need not move
    short = counts.groupBy(doc).agg(F.sum("n").alias("total")).where(~F.coalesce(F.col("total") >= least, F.lit(False))).select(doc)
    return counts.where(F.col(doc).isNotNull()).join(materialise(short, "docs-short"), doc, "left_anti")


def filter_terms(counts: DataFrame, least: int = 10, few: int = COMMON_TERMS) -> DataFrame:
    """Counts of the terms with at least `least` counts. The `few` commonest, which make up most rows, are broadcast; the rows of others move."""
    keep = counts.groupBy("term").agg(F.sum("n").alias("total")).where((F.col("total") >= least) & F.col("term").isNotNull())
    keep = materialise(keep, "terms-kept")
    if keep.count() <= few:
        return counts.join(F.broadcast(keep.select("term")), "term", "left_semi")
    head = F.broadcast(materialise(keep.orderBy(F.desc("total"), "term").limit(few).select("term"), "terms-common"))
    return counts.join(head, "term", "left_semi").unionByName(counts.join(head, "term", "left_anti").join(keep.select("term"), "term", "left_semi"))


def filter_both(counts: DataFrame, least_doc: int = 10, least_term: int = 10, doc: str = "doc_id") -> DataFrame:
    """Terms, then documents, then terms again: what a term still has after documents have gone counts."""
    counts = materialise(counts, "counts")  # read by each of the filters
    return filter_terms(filter_docs(filter_terms(counts, least_term), least_doc, doc), least_term)


def usage(counts: DataFrame, alpha: float = 1.0, doc: str = "doc_id") -> DataFrame:
    """Terms whose mean frequency, zeros included, exceeds alpha * sqrt(ln(max(n, p)) / (n * longest document))."""
    own = Window.partitionBy(doc).orderBy("term")
    total = F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = counts.select(doc, "term", "n", total.alias("total"), F.row_number().over(own).alias("place"))
    # one pass over the counts: documents are counted at their first term, the longest is that of some term
    share = F.when(F.col(doc).isNotNull() & (F.col("total") > 0), F.col("n") / F.col("total"))
    each = x.groupBy("term").agg(F.sum(share).alias("s"), F.sum((F.col("place") == 1).cast("long")).alias("first"), F.max("total").alias("total"))
    each = materialise(each, "usage")
    size = each.agg(F.sum("first").alias("docs"), F.max("total").alias("longest"), F.count("term").alias("p"))
    least = size.select("docs", (F.lit(alpha) * F.sqrt(F.log(F.greatest("docs", "p")) / (F.col("docs") * F.col("longest")))).alias("least"))  # one row
    means = each.where("s IS NOT NULL").crossJoin(F.broadcast(least))
    return means.select("term", (F.col("s") / F.col("docs")).alias("mean_use"), "least").where("mean_use > least").select("term", "mean_use")


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """(term, term_id): the `size` commonest terms, ties by term, numbered from 0. Its size is a parameter, so it may be broadcast."""
    top = counts.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(size)
    return top.select("term", (F.row_number().over(Window.orderBy(F.desc("total"), "term")) - 1).alias("term_id"))


def all_terms(counts: DataFrame) -> tuple[DataFrame, int]:
    """(term, term_id) of all terms, the commonest first, ties by term, as a written table, and how many there are; any number."""
    totals = materialise(counts.groupBy("term").agg(F.sum("n").alias("total")), "terms")
    n = totals.count()
    if n <= FEW_TERMS:
        return materialise(vocabulary(totals.withColumnRenamed("total", "n"), n), "vocabulary"), n
    numbered = number_rows(totals.withColumn("_order", -F.col("total")), "_order", "term", name="term_id")
    vocab = materialise(numbered.select("term", F.col("term_id").cast("int").alias("term_id")), "vocabulary")
    release(totals)
    return vocab, n


def whole_vocabulary(counts: DataFrame, most: int) -> DataFrame:
    """(term, term_id) of all terms, as a written table; an error where there are more than `most`, as no term is left out unasked."""
    vocab = materialise(vocabulary(counts, most + 1), "vocabulary")
    if vocab.count() > most:
        raise ValueError(f"more than {most} terms: cut the vocabulary first, or raise the bound")
    return vocab


def wide(counts: DataFrame, terms: list[str], *keys: str) -> DataFrame:
    """One column for each of the given terms, zeros filled in."""
    return counts.groupBy(*keys).pivot("term", terms).agg(F.sum("n")).na.fill(0, terms)


def balanced(docs: DataFrame, group: str, cap: int, *order: str | Column) -> DataFrame:
    """At most `cap` rows of each group, the first in the given order; the limit is the sampling operator's own."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return docs.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def semi_edges(edges: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    """Edges both of whose ends are among the nodes; keys: what identifies a node besides `node`."""
    for end in ("src", "tgt"):
        edges = edges.join(nodes.select(*keys, F.col("node").alias(end)), [*keys, end], "left_semi")
    return edges


def prune_regions(counts: DataFrame, coords: DataFrame, edges: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells with at least `least` counts in all regions at once; ids stay (region_id, cell_id), so regions never collide."""
    key = ["region_id", "cell_id"]
    nodes = counts.groupBy(*key).agg(F.sum("n").alias("total")).where(F.col("total") >= least).select(*key)
    kept = semi_edges(edges, nodes.select("region_id", F.col("cell_id").alias("node")), "region_id")
    return counts.join(nodes, key, "left_semi"), coords.join(nodes, key, "left_semi"), kept
