"""Sampling rasters kept as tables (i_lon, i_lat, z), one row a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import CubicModel, clamp, predict

NODE = ["i_lon", "i_lat"]


def sampled(points: DataFrame, raster: DataFrame, name: str) -> DataFrame:
    """Points on nodes with the raster's value there as ``name``; nodes without a number go."""
    return points.join(raster.select(*NODE, F.col("z").alias(name)), NODE).where(~F.isnan(name) & F.col(name).isNotNull())


def ages_and_distances(points: DataFrame, ages: DataFrame, distances: DataFrame, max_age: float | None, max_distance: float | None) -> DataFrame:
    """Both rasters at points; rows without either go before the values are clamped, so that a gap doesn't become the clamp."""
    both = sampled(sampled(points, ages, "age"), distances, "distance")
    return both.withColumns({"age": clamp(F.col("age"), max_age), "distance": clamp(F.col("distance"), max_distance)})


def predicted(points: DataFrame, ages: DataFrame, distances: DataFrame, model: CubicModel, name: str) -> DataFrame:
    rows = ages_and_distances(points, ages, distances, model.max_age, model.max_distance)
    return rows.withColumn(name, predict(F.col("age"), F.col("distance"), model))


def nodes(raster: DataFrame, no_data: float | None = None) -> DataFrame:
    """Nodes that hold a number, and not the one that stands for no data."""
    kept = raster.where(F.col("z").isNotNull() & ~F.isnan("z"))
    return kept if no_data is None else kept.where(F.col("z") != no_data)


def masked(fine: DataFrame, raster: DataFrame) -> DataFrame:
    """Fine points whose node in ``raster`` holds a number."""
    return fine.join(nodes(raster).select(*NODE), NODE, "left_semi")


def aligned(base: DataFrame, **rasters: DataFrame) -> DataFrame:
    """The base raster's nodes with the values of others beside, null where they have none."""
    for name, raster in rasters.items():
        base = base.join(raster.select(*NODE, F.col("z").alias(name)), NODE, "left")
    return base


def bilinear(points: DataFrame, raster: DataFrame, spacing: float, key: str, periodic: bool = False, least: float = 1.0) -> DataFrame:
    """Rows (key, z): the four nodes around each point of (key, lon, lat), weighted by nearness. Nodes and ``periodic`` as in ``bicubic``."""
    return _interpolated(points, raster, spacing, key, range(2), lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t)), periodic, least)


def bicubic(points: DataFrame, raster: DataFrame, spacing: float, key: str, periodic: bool = False, least: float = 1.0) -> DataFrame:
    """As ``bilinear`` over sixteen nodes with the cubic convolution kernel (a = -1/2), which gives a node's value at the node.

    With ``periodic`` the raster covers the sphere: columns go on over the date line (the columns at -180 and 180 are one place), and
    beyond a pole come the rows of the opposite meridian, so points next to either have all their nodes. Otherwise nodes
    beyond the edge are missing. Where nodes are missing the others share their weight as long as they have at least
    ``least`` of it (1: none may be missing), else the value is null.
    """

    def kernel(t):
        t = F.abs(t)
        return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(F.lit(0.0))

    return _interpolated(points, raster, spacing, key, range(-1, 3), kernel, periodic, least)


def _interpolated(points: DataFrame, raster: DataFrame, spacing: float, key: str, near: range, kernel, periodic: bool, least: float) -> DataFrame:
    x, y = (F.col("lon") + 180.0) / spacing, (F.col("lat") + 90.0) / spacing
    corner = points.select(key, x.alias("x"), y.alias("y"), F.floor(x).cast("int").alias("cx"), F.floor(y).cast("int").alias("cy"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in near for j in near)))
    stencil = corner.select("*", steps.alias("d")).select(key, "x", "y", (F.col("cx") + F.col("d.dx")).alias("i_lon"), (F.col("cy") + F.col("d.dy")).alias("i_lat"))
    rows = stencil.withColumn("w", kernel(F.col("x") - F.col("i_lon")) * kernel(F.col("y") - F.col("i_lat"))).where("w <> 0")
    if periodic:
        n_lon, n_lat = round(360.0 / spacing), round(180.0 / spacing)
        if abs(n_lon * spacing - 360.0) > 1e-9 or n_lon % 2:
            raise ValueError("the spacing of a periodic raster divides 360 degrees an even number of times")
        beyond = (F.col("i_lat") < 0) | (F.col("i_lat") > n_lat)
        row = F.when(F.col("i_lat") < 0, -F.col("i_lat")).when(F.col("i_lat") > n_lat, 2 * n_lat - F.col("i_lat")).otherwise(F.col("i_lat"))
        rows = rows.withColumns({"i_lon": F.pmod(F.col("i_lon") + F.when(beyond, n_lon // 2).otherwise(0), F.lit(n_lon)), "i_lat": row})
        raster = raster.where(F.col("i_lon") < n_lon)
    found, w = F.col("z").isNotNull() & ~F.isnan("z"), F.col("w")
    some = F.sum(F.when(found, w * F.col("z")).otherwise(0.0))
    met = rows.join(raster, NODE, "left").groupBy(key).agg(F.sum(F.when(found, 0).otherwise(1)).alias("gaps"), some.alias("some"), F.sum(F.when(found, w).otherwise(0.0)).alias("weight"))
    share = F.when((F.col("weight") >= least) & (F.col("weight") > 0), F.col("some") / F.when(F.col("weight") > 0, F.col("weight")))
    return met.select(key, F.when(F.col("gaps") == 0, F.col("some")).otherwise(share if least < 1 else F.lit(None).cast("double")).alias("z"))
