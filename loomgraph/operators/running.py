"""Running totals over a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.shared import materialise


def running(df: DataFrame, order: list[str], values: list[str], descending: bool = False) -> DataFrame:
    """df with before_{value}: the sum of each value over the rows that come earlier in the order.

    Rows are dealt into ranges; a range's own sums run in its task, and the ranges' totals, one row each, are added up on
    the driver. The order has to be total.
    """
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    ranged = materialise(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]).orderBy("_part").collect()
    kinds = {v: ranged.schema[v].dataType.simpleString() for v in values}
    offsets, so_far = [], {v: 0.0 if kinds[v] == "double" else 0 for v in values}
    for r in totals:
        offsets.append((r["_part"], *[so_far[v] for v in values]))
        so_far = {v: so_far[v] + (r[v] or 0) for v in values}
    w = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    start = df.sparkSession.createDataFrame(offsets, ", ".join(["_part int", *[f"_o_{v} {kinds[v]}" for v in values]]))
    out = ranged.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values}).join(F.broadcast(start), "_part")
    return out.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_o_{v}") for v in values}).drop("_part", *[f"_o_{v}" for v in values])


def number_rows(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Dense numbers from 0 in a total order."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), list(order), ["_one"]).withColumnRenamed("before__one", name).drop("_one")
