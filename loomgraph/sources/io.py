"""Readers and writers: one distributed scan for all files of a kind, partition columns instead of file loops."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import schemas
from loomgraph.shared import materialise


def stem(kind: str) -> Column:
    """Region id of the file a row was read from: {region_id}.{kind}.csv."""
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{kind}\.csv$", 1)


def cell_key(column: Column) -> Column:
    """The id in a key that was written as a pair, ('cell', 15)."""
    return F.regexp_extract(column, r",\s*(\d+)\s*\)", 1).cast("long")


def _csv(spark: SparkSession, folder: str, kind: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/*.{kind}.csv").withColumn("region_id", stem(kind))


def read_region_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(region_id, cell_id, term, n) of all regions, in long form; zero counts are left out."""
    wide = _csv(spark, folder, "D", schemas.COUNT_CSV).withColumn("cell_id", cell_key(F.col("_c0")))
    return wide.unpivot(["region_id", "cell_id"], [f"`{c}`" for c in schemas.REGION_COUNTS], "term", "n").where("n > 0")


def read_region_coords(spark: SparkSession, folder: str) -> DataFrame:
    return _csv(spark, folder, "coord", schemas.COORD_CSV).select("region_id", F.col("CELL_ID").alias("cell_id"), F.col("X").alias("x"), F.col("Y").alias("y"))


def read_region_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Endpoints are cell ids. The files' distances mix units and are left out; weights come from coordinates."""
    return _csv(spark, folder, "edge", schemas.EDGE_CSV).select("region_id", "src", "tgt")


def read_region_types(spark: SparkSession, folder: str) -> DataFrame:
    return _csv(spark, folder, "type", schemas.TYPE_CSV).select("region_id", F.col("CELL_ID").alias("cell_id"), F.col("CELL_TYPE").alias("cell_type"), F.col("CELL_CLASS").alias("cell_class"))


def read_region_meta(spark: SparkSession, path: str) -> DataFrame:
    """Regions with an outcome."""
    return spark.read.schema(schemas.META).option("header", True).csv(path).where("primary_outcome IS NOT NULL")


def regions(spark: SparkSession, folder: str, kind: str = "coord") -> DataFrame:
    """Distinct region ids among the files of a kind; file names only, no rows."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.{kind}.csv").select(F.regexp_extract("path", rf"([^/]*)\.{kind}\.csv$", 1).alias("region_id"))
    return files.distinct()


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(basket_id, group, tokens) from JSON arrays of records with `cuisine` and `ingredients`.

    A basket's id is a hash of its file's name and its place in it, so it does not change with other files or partitions.
    """
    rows = spark.read.schema("cuisine string, ingredients array<string>").option("multiLine", True).json(path)
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), "cuisine", "ingredients")
    rows = materialise(rows, "baskets-read")  # a file is read by one task, in order
    first = rows.groupBy("file").agg(F.min("at").alias("first"))
    return rows.join(first, "file").select(F.xxhash64("file", F.col("at") - F.col("first")).alias("basket_id"), F.col("cuisine").alias("group"), F.col("ingredients").alias("tokens"))


def read_mapping(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value) from a JSON object of name -> list of names."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias(key, "values")).select(key, F.explode("values").alias(value))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GRID).option("header", True).option("sep", " ").csv(path)


def parameter_grid(spark: SparkSession, sets: Iterable[dict[str, Iterable[int]]], names: tuple[str, ...] = ("length", "n", "K", "p"), nsim: int = 50) -> DataFrame:
    """Cartesian products of parameter sets, without repeats, numbered in order from 1. As small as its parameters."""
    rows = dict.fromkeys(x for s in sets for x in product(*[list(s[c]) for c in names]))
    return spark.createDataFrame([(i + 1, nsim, *r) for i, r in enumerate(rows)], ", ".join(f"{c} long" for c in ("task_id", "nsim", *names)))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """The table built with these parameters, from `path` if it was written there before. The parameters are part of its name."""
    import hashlib
    import json

    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    where = f"{path.rstrip('/')}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def write_factors(df: DataFrame, path: str, by: tuple[str, ...] = ("method", "k")) -> None:
    """Aligned factors, one folder for each method and K, so that readers prune instead of trusting file order.

    Only the folders of the methods and K in df are replaced; others at the path stay.
    """
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*by).csv(path)
