"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, packing, pii, quality, simhash
from loomgraph.llm.common import free_names, materialise, table
from loomgraph.llm.queries import tokenizer_path


def _kept(docs: DataFrame, judged: Column, test: str) -> DataFrame:
    """The rows whose struct `judged` passes the test on its field; every column keeps its values."""
    (name,) = free_names(docs, "judged")
    return docs.withColumn(name, judged).where(f"`{name}`.{test}").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier, fitted on `labels`, predicts as class 1."""
    return _kept(docs, quality.scored(quality.train(docs, table(spark, sf_dir, "labels"))), "predicted = 1")


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the classifier, fitted on their own `lang`, does not reject."""
    return _kept(docs, langid.predicted(langid.train(docs)), "rejected = false")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows without an id stay; of rows that share the smallest id of a group see simhash.keep_one().
    """
    return simhash.keep_one(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("simhash", near_dedup),
    ("pii", pii_redaction),
    ("packing", best_fit_packing),
]

#: SQL cannot express the fitted models, XXH64 or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
