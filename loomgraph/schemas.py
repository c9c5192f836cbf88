"""Schemas of the tables that readers return and operators expect; keys are ids, never positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The columns of region count files.
REGION_COUNTS = ("CD4 T cell", "CD8 T cell", "B cell", "Macrophage", "Granulocyte", "Blood vessel", "Stroma", "Other")
COORD_CSV = T.StructType([T.StructField("_c0", T.LongType()), T.StructField("CELL_ID", T.LongType()), T.StructField("X", T.DoubleType()), T.StructField("Y", T.DoubleType())])
EDGE_CSV = T.StructType([T.StructField("_c0", T.LongType()), T.StructField("src", T.LongType()), T.StructField("tgt", T.LongType()), T.StructField("distance", T.DoubleType())])
TYPE_CSV = T.StructType([T.StructField("_c0", T.LongType()), T.StructField("CELL_ID", T.LongType()), T.StructField("CELL_TYPE", T.StringType()), T.StructField("CELL_CLASS", T.StringType())])
COUNT_CSV = T.StructType([T.StructField("_c0", T.StringType()), *[T.StructField(c, T.LongType()) for c in REGION_COUNTS]])
#: The mean document length, N in parameter files, is called length: column names do not differ by case alone.
GRID = T.StructType([T.StructField(c, T.LongType()) for c in ("task_id", "nsim", "length", "n", "K", "p")])
META = T.StructType([T.StructField("region_id", T.StringType()), T.StructField("primary_outcome", T.IntegerType()), T.StructField("recurrence", T.IntegerType()), T.StructField("length_of_disease_free_survival", T.DoubleType())])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns {lacking} are missing from {df.columns}")
    return df
