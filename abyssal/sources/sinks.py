"""Outputs: xyz text, grids by time, the training table, formatted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import filled
from ..operators.products import gridded
from . import netcdf


def words(*columns: str) -> Column:
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))


def write_xyz(rows: DataFrame, path: str, *columns: str) -> None:
    """Space-separated lines of the columns, all by default."""
    rows.select(words(*(columns or rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_grid(points: DataFrame, path: str, spacing: float, value: str = "z") -> None:
    """The full grid with NaN where there is no point."""
    filled(points.sparkSession, points, spacing, value).write.mode("overwrite").parquet(path)


def write_by_time(rows: DataFrame, path: str, time: str, *columns: str) -> None:
    """One folder of text a time; a time without rows has none."""
    rows.select(F.format_string("%.2f", time).alias(time), words(*columns).alias("value")).write.mode("overwrite").partitionBy(time).text(path)


def write_metrics(stats: DataFrame, path: str, metrics: list[str]) -> None:
    """One Parquet folder a time and metric, from wide rows."""
    long = stats.select("paleo_time", "point_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("z")) for m in metrics))).alias("m"))
    long.select("paleo_time", "point_id", "m.metric", "m.z").write.mode("overwrite").partitionBy("paleo_time", "metric").parquet(path)


def write_predictions(points: DataFrame, path: str, spacing: float, text: bool, value: str = "z") -> None:
    write_xyz(points, path, "lon", "lat", value) if text else write_grid(points, path, spacing, value)


def write_raster(points: DataFrame, folder: str, name: str, spacing: float, least: int = 2) -> None:
    """A netCDF file of the grid, from points (point_id, lon, lat, z) on or between its nodes."""
    netcdf.save(netcdf.grid_files(gridded(points, spacing, least=least).withColumn("name", F.lit(name)), spacing, "name"), folder)


def write_average_rate(points: DataFrame, folder: str, spacing: float | None = None) -> None:
    """The points as text always, and as a netCDF grid (every node with a point in reach) too if a spacing is given."""
    write_xyz(points, f"{folder}/xyz", "lon", "lat", "z")
    if spacing:
        write_raster(points, folder, "rate.nc", spacing, least=1)


def write_products(products: DataFrame, folder: str, spacing: float | None, xyz: bool = True) -> None:
    """Rows (product, time, point_id, lon, lat, z) as text by product and time, and as a netCDF grid each if a spacing is given."""
    if xyz:
        rows = products.select("product", F.format_string("%.2f", F.col("time").cast("double")).alias("time"), words("lon", "lat", "z").alias("value"))
        rows.write.mode("overwrite").partitionBy("product", "time").text(f"{folder}/xyz")
    if spacing:
        # Positions of earlier times lie between nodes, others may lie on them.
        for at_nodes, which in ((False, F.col("product") == "distance"), (None, F.col("product") != "distance")):
            nodes = gridded(products.where(which), spacing, ("product", "time"), on=at_nodes)
            named = nodes.withColumn("name", F.format_string("%s_%.2f.nc", "product", F.col("time").cast("double")))
            netcdf.save(netcdf.grid_files(named, spacing, "name"), f"{folder}/grid")


def write_training(rows: DataFrame, path: str, sep: str = " ") -> None:
    """The training table with NaN for missing numbers; the tab form reads back with ``sep`` a tab."""
    rows.write.mode("overwrite").csv(path, sep=sep, nullValue="NaN")


def coverage_json(rows: DataFrame, time: str, half_width: float, values: list[str]) -> DataFrame:
    """A JSON feature a row: point, valid time around ``time``, named scalars."""
    body = F.struct(
        F.struct(F.col("lon"), F.col("lat")).alias("point"),
        F.struct((F.col(time) + half_width).alias("begin"), (F.col(time) - half_width).alias("end")).alias("valid"),
        F.struct(*values).alias("scalars"),
    )
    return rows.select(F.to_json(body).alias("value"))


def table_lines(rows: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Formatted lines in the order of the first column."""
    return rows.orderBy(columns[0]).select(F.format_string(pattern, *columns).alias("value"))
