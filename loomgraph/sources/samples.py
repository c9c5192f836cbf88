"""Many samples in one place: tables partitioned by sample, of which readers open only the folders asked for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schemas import require

#: The tables of a sample store and their columns besides sample_id.
TABLES = {"counts": ("node", "term", "n"), "coords": ("node", "x", "y"), "edges": ("src", "tgt")}


def write_samples(path: str, counts: DataFrame, coords: DataFrame, edges: DataFrame) -> None:
    """(sample_id, node, term, n), (sample_id, node, x, y) and (sample_id, src, tgt), a folder for each sample in each table.

    Only the folders of the samples in the tables are replaced. Rows are dealt by sample and a hash of the node, so that a
    large sample is written by several tasks.
    """
    for name, df in (("counts", counts), ("coords", coords), ("edges", edges)):
        first = TABLES[name][0]
        require(df, "sample_id", *TABLES[name])
        spread = df.select("sample_id", *TABLES[name]).repartition("sample_id", F.pmod(F.xxhash64(first), F.lit(8)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(f"{path}/{name}")


def sample_names(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a store, from its partitions alone."""
    return spark.read.parquet(f"{path}/coords").select("sample_id").distinct()


def read_samples(spark: SparkSession, path: str, wanted: Iterable | DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """counts, coords and edges of the samples wanted: values, or a table with sample_id; None: all.

    Values prune the folders when the plan is made, a table does when it runs (dynamic partition pruning).
    """
    outs = []
    for name in TABLES:
        df = spark.read.parquet(f"{path}/{name}")
        if isinstance(wanted, DataFrame):
            df = df.join(F.broadcast(wanted.select("sample_id").distinct()), "sample_id")  # names of samples: few beside their rows
        elif wanted is not None:
            df = df.where(F.col("sample_id").isin(list(wanted)))
        outs.append(df.select("sample_id", *TABLES[name]))
    return outs[0], outs[1], outs[2]
