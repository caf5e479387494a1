"""Grids made of results: points on or between nodes, and the products of a proximity run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import counts, grid_points, node_index
from .spatial_join import by_sectors, upscaled


def on_nodes(points: DataFrame, spacing: float, slack: float = 1e-6) -> DataFrame:
    """Points with the indices of their nearest node and whether they lie on it."""
    i, j = node_index(F.col("lon"), -180.0, spacing), node_index(F.col("lat"), -90.0, spacing)
    off = F.greatest(F.abs(F.col("lon") + 180.0 - i * spacing), F.abs(F.col("lat") + 90.0 - j * spacing))
    return points.withColumns({"i_lon": i, "i_lat": j, "on_node": off <= slack})


def gridded(points: DataFrame, spacing: float, by: tuple[str, ...] = (), least: int = 2, on: bool | None = None) -> DataFrame:
    """Rows (i_lon, i_lat, z) of the nodes that get a value, for each of columns ``by``.

    If all ``points`` (point_id, lon, lat, z) lie on nodes, a node has their mean; otherwise the nearest point of each
    quarter within 1.5 spacings counts, where ``least`` quarters have one. ``on`` states which case holds; None looks.
    Values that are null or no number don't count.
    """
    points = points.where(F.col("z").isNotNull() & ~F.isnan("z"))
    placed = on_nodes(points, spacing)
    if on is None:
        on = placed.where(~F.col("on_node")).isEmpty()
    if on:
        return placed.groupBy(*by, "i_lon", "i_lat").agg(F.avg("z").alias("z"))
    n = counts(spacing)[1]
    targets = grid_points(points.sparkSession, spacing).select((F.col("i_lon").cast("long") * n + F.col("i_lat")).alias("node_id"), "lon", "lat")
    found = by_sectors(targets, points, 1.5 * spacing, 4, least, by)
    return found.select(*by, F.expr(f"node_id div {n}").cast("int").alias("i_lon"), (F.col("node_id") % n).cast("int").alias("i_lat"), "z")


def proximity_products(observed: DataFrame, statistics: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (product, time, point_id, lon, lat, z) of a proximity run.

    ``distance`` is at each time t of ``observed`` (t, point_id, lon, lat, dist_km), where the point was then; ``mean``
    and ``std`` are at each paleo_time of ``statistics``, where ``points`` (paleo_time, point_id, lon, lat) has the point.
    """
    out = observed.select(F.lit("distance").alias("product"), F.col("t").alias("time"), "point_id", "lon", "lat", F.col("dist_km").alias("z"))
    at = statistics.join(points.select("paleo_time", "point_id", "lon", "lat"), ["paleo_time", "point_id"])
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("product"), F.col(f"{n}_km").alias("z")) for n in ("mean", "std"))))
    return out.unionByName(at.select("paleo_time", "point_id", "lon", "lat", both.alias("m")).select("m.product", F.col("paleo_time").alias("time"), "point_id", "lon", "lat", "m.z"))


def upscaled_products(products: DataFrame, weights: DataFrame, fine: DataFrame) -> DataFrame:
    """The products on finer points (fine_id, lon, lat) by ``weights`` of ``upscale_weights``, whose sources are point_ids."""
    values = products.withColumnRenamed("point_id", "src_id")
    return upscaled(weights, values, ("product", "time")).join(fine, "fine_id").select("product", "time", F.col("fine_id").alias("point_id"), "lon", "lat", "z")
