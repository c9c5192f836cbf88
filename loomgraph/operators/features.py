"""Neighbourhood features of marked cells, and the arithmetic behind false-colour pictures of markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import neighbourhood


def cluster_counts(clusters: list, column: str = "cluster") -> list[Column]:
    """Neighbours of each given cluster."""
    return [F.sum((F.col(column) == c).cast("long")).alias(f"cluster_{c}") for c in clusters]


def marker_counts(markers: list[str], least: float = 0.5) -> list[Column]:
    """Neighbours whose marker exceeds `least`."""
    return [F.sum((F.col(m) > least).cast("long")).alias(m) for m in markers]


def marker_means(markers: list[str]) -> list[Column]:
    return [F.avg(m).alias(m) for m in markers]


def neighbour_count() -> list[Column]:
    return [F.count("*").alias("neighbours")]


def featurise(cells: DataFrame, anchor: str, features: list[Column], radius: float = 100.0, axes: tuple[str, ...] = ("x", "y"), sample: str = "sample_id") -> DataFrame:
    """(sample, anchor, features) of the cells whose boolean column `anchor` holds, from all cells of their sample within
    the radius, in two or three dimensions; rows without any feature vanish, missing ones are zero."""
    own = cells.where(F.col(anchor)).select(sample, "node", *axes)
    out = neighbourhood(own, cells, radius, features, axes, (sample,))
    names = out.columns[2:]
    return out.dropna("all", subset=names).na.fill(0, names)


def clipped_channels(cells: DataFrame, markers: list[str], low: float = 0.05, high: float = 0.97) -> DataFrame:
    """Markers less their low percentile, by their high percentile, clipped to 0..1; percentiles over all cells."""
    cut = cells.agg(*[F.percentile(m, F.array(F.lit(low), F.lit(high))).alias(m) for m in markers]).first()  # one row
    scaled = {m: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(m) - cut[m][0]) / (max(cut[m][1] - cut[m][0], 1e-12)))) for m in markers}
    return cells.withColumns(scaled)


def blended(channels: DataFrame, colours: dict[str, tuple[float, float, float]], power: float = 5.0) -> DataFrame:
    """red, green and blue: the power mean over the markers of their value times their colour."""
    n = len(colours)
    rgb = {name: F.pow(sum((F.pow(F.col(m) * F.lit(float(c[i])), power) for m, c in colours.items()), F.lit(0.0)) / n, 1 / power) for i, name in enumerate(("red", "green", "blue"))}
    return channels.withColumns(rgb)
