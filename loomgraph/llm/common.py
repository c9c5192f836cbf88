"""What the operators of this subpackage share: folds, result columns, and the tables of loomgraph.shared."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.shared import materialise, release, shared_dir

__all__ = ["first_by_hash", "free_names", "give_back", "in_fold", "matching", "materialise", "release", "shared_dir", "table", "with_result"]

#: Rows of keys up to which a table of keys is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key as text leaves the remainder; a null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def with_result(df: DataFrame, **columns: Column) -> DataFrame:
    """df with result columns last; an input column of the same name gives way to the result."""
    lower = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower], *[v.alias(k) for k, v in columns.items()])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def first_by_hash(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The first n rows of each group, in the order of a hash of the key, then the key; a null group or key takes no part.

    Counts by the hash's leading bits tell where a group's n-th row lies, so only few rows more than that are ranked.
    """
    bin_, cut, nth = free_names(df, "bin", "cut", "nth")
    held = df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).withColumn(bin_, F.shiftright(F.xxhash64(key), 50))
    upto = F.sum("count").over(Window.partitionBy(group).orderBy(bin_))
    cuts = materialise(held.groupBy(group, bin_).count().withColumn("upto", upto).groupBy(group).agg(F.coalesce(F.min(F.when(F.col("upto") >= n, F.col(bin_))), F.max(bin_)).alias(cut)), "cuts")
    near = held.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts, group).where(F.col(bin_) <= F.col(cut))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    return near.withColumn(nth, rank).where(F.col(nth) <= n).select(*df.columns)


def give_back() -> None:
    """Hands memory that this process has freed back to the machine: Python workers outlive the tasks, and stages, that filled them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere freed pages go back by themselves or stay
    if trim is not None:
        trim(0)


def matching(df: DataFrame, keys: DataFrame, by: str, how: str) -> DataFrame:
    """df joined (left_semi or left_anti) with a table of keys, which is broadcast if it is counted and found small."""
    keys = materialise(keys, "keys")
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, by, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
