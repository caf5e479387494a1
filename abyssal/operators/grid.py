"""Regular longitude/latitude grids: points, pixel nodes, filling a full grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere


def counts(spacing: float) -> tuple[int, int]:
    if spacing <= 0:
        raise ValueError("the spacing must be positive")
    return int(math.floor(360.0 / spacing)) + 1, int(math.floor(180.0 / spacing)) + 1


def grid_points(spark: SparkSession, spacing: float) -> DataFrame:
    """Rows (i_lon, i_lat, lon, lat) from -180/-90 in steps of ``spacing``, both ends included where it divides."""
    n_lon, n_lat = counts(spacing)
    return _grid(spark, n_lon, n_lat).select("i_lon", "i_lat", (-180.0 + F.col("i_lon") * spacing).alias("lon"), (-90.0 + F.col("i_lat") * spacing).alias("lat"))


def stretched_grid_points(spark: SparkSession, spacing: float) -> DataFrame:
    """As many points as ``grid_points``, spread evenly to end at +180/+90 always."""
    n_lon, n_lat = counts(spacing)
    lon = -180.0 + F.col("i_lon") * 360.0 / (n_lon - 1)
    lat = -90.0 + F.col("i_lat") * 180.0 / (n_lat - 1)
    return _grid(spark, n_lon, n_lat).select("i_lon", "i_lat", lon.alias("lon"), lat.alias("lat"))


def _grid(spark: SparkSession, n_lon: int, n_lat: int) -> DataFrame:
    return spark.range(n_lon * n_lat).select((F.col("id") % n_lon).cast("int").alias("i_lon"), F.expr(f"id div {n_lon}").cast("int").alias("i_lat"))


def pixel_nodes(spark: SparkSession, depth: int) -> DataFrame:
    """Centres (node_id, i_lon, i_lat, lon, lat) of the 4 * 2^depth by 2 * 2^depth pixels."""
    n_lon, spacing = 4 << depth, 90.0 / (1 << depth)
    grid = _grid(spark, n_lon, 2 << depth)
    return grid.select((F.col("i_lat") * n_lon + F.col("i_lon")).alias("node_id"), "i_lon", "i_lat", (-180.0 + (F.col("i_lon") + 0.5) * spacing).alias("lon"), (-90.0 + (F.col("i_lat") + 0.5) * spacing).alias("lat"))


def pixel_at(v: Column, depth: int) -> Column:
    """Number of the pixel that a unit vector lies in."""
    n_lon, n_lat, size = 4 << depth, 2 << depth, 90.0 / (1 << depth)
    row = F.least(F.lit(n_lat - 1), F.greatest(F.lit(0), F.floor((sphere.lat_of(v) + 90.0) / size)))
    return (row * n_lon + F.pmod(F.floor((sphere.lon_of(v) + 180.0) / size), F.lit(n_lon))).cast("int")


def pixel_vector(node: Column, depth: int) -> Column:
    """Unit vector of a pixel's centre."""
    n_lon, size = 4 << depth, 90.0 / (1 << depth)
    return sphere.from_lon_lat(-180.0 + (node % n_lon + 0.5) * size, -90.0 + (F.floor(node / n_lon) + 0.5) * size)


def node_index(value: Column, low: float, spacing: float) -> Column:
    """Index of the grid line nearest to a coordinate."""
    return F.round((value - low) / spacing).cast("int")


def filled(spark: SparkSession, points: DataFrame, spacing: float, value: str = "z") -> DataFrame:
    """Every node of the grid with the value of the point on it, NaN where there is none."""
    return grid_points(spark, spacing).join(points.select("i_lon", "i_lat", value), ["i_lon", "i_lat"], "left").withColumn(value, F.coalesce(value, F.lit(float("nan"))))


def filled_pixels(spark: SparkSession, points: DataFrame, depth: int, value: str = "z") -> DataFrame:
    """As ``filled`` over pixel centres, for points keyed by node_id."""
    return pixel_nodes(spark, depth).join(points.select("node_id", value), "node_id", "left").withColumn(value, F.coalesce(value, F.lit(float("nan"))))
