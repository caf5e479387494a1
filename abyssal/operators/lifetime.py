"""Statistics of ocean points over their lifetimes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from .spatial_join import distance_to_lines


def observation_times(points: DataFrame, step: int, most: int | None) -> DataFrame:
    """A row (.., t) for each time a point of (paleo_time, birth_time) is seen: first at the multiple of
    ``step`` at or after paleo_time, whatever its birth, then each step up to its birth and ``most``."""
    first = F.ceil(F.col("paleo_time") / step)
    end = F.col("birth_time") if most is None else F.least(F.col("birth_time"), F.lit(float(most)))
    last = F.greatest(first, F.floor(end / step))
    rows = points.withColumn("_first", first)
    if most is not None:
        rows = rows.where(F.col("_first") * step <= most)
    return rows.withColumn("_k", F.explode(F.sequence(F.col("_first"), last))).withColumn("t", (F.col("_k") * step).cast("double")).drop("_first", "_k")


def lifetime_statistics(observed: DataFrame, max_mean: float | None = None) -> DataFrame:
    """By (paleo_time, point_id): count, mean of dist_km (clamped) and its population deviation (not clamped)."""
    return observed.groupBy("paleo_time", "point_id").agg(F.count("*").alias("n"), clamp(F.avg("dist_km"), max_mean).alias("mean_km"), F.stddev_pop("dist_km").alias("std_km"))


def proximity(points: DataFrame, positions, margins: DataFrame, step: int, most: int | None, threshold: float | None = None, max_mean: float | None = None, ignore_far: bool = False) -> DataFrame:
    """Lifetime mean and deviation of the distance to margins.

    ``points`` has paleo_time, point_id, birth_time, plate, lon, lat; ``positions`` moves rows with a
    time ``t`` to (lon, lat) at that time and drops those that no plate carries; a point that is
    dropped once stays out at all older times. ``margins`` has arcs (t, a, b) as they lay at each time.
    A point farther than ``threshold`` radians from all margins counts with half the
    circumference, or not at all with ``ignore_far``.
    """
    seen = observation_times(points, step, most).withColumn("_seen", F.row_number().over(Window.partitionBy("paleo_time", "point_id").orderBy("t")))
    moved = positions(seen).withColumn("_still", F.row_number().over(Window.partitionBy("paleo_time", "point_id").orderBy("t"))).where("_seen = _still")
    asked = moved.select(F.struct("paleo_time", "point_id", "t").alias("query_id"), "t", "lon", "lat")
    found = distance_to_lines(asked, margins, threshold, by=("t",), beyond=None if ignore_far else math.pi)
    return lifetime_statistics(found.select("query_id.*", "dist_km").where("dist_km IS NOT NULL"), max_mean)
