"""Where points lie at each time as the plates that hold them carry them back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.scalar import MEAN_RADIUS_KM
from ..storage import shared_dir, stored
from . import graph, polygons
from .kinematics import of_types, stage, turned, valid_at


def carried(points: DataFrame, plates: DataFrame, anchored: DataFrame, step: int, last: int, depth: int = 4, inside: str = "smaller") -> DataFrame:
    """Rows (paleo_time, point_id, birth_time, t, plate, lon, lat): each point at each time it is seen, with the plate that holds it there.

    ``points`` has paleo_time, point_id, birth_time, lon, lat. A point enters, unmoved, at the first multiple of ``step`` not before its
    paleo time, if that is not after ``last``. At each time it is on the plate polygon that holds it (``plates``: t, plate, xyz as they lie at that time; of several
    the smallest plate), and goes one step back with the turn that plate makes (``anchored``: time, plate, q). It stops for
    good where no polygon holds it (plate is null in its last row), where its plate has no turn, and before the
    step that would pass its birth; its first row stands whatever its birth.

    Each step is one look-up of points in polygons by pixel and one of turns, written before the next; steps end when no point is left and none is to come.
    """
    spark, folder = points.sparkSession, f"{shared_dir(points.sparkSession)}/abyssal-histories-{uuid.uuid4().hex}"
    entering = stored(points.select("paleo_time", "point_id", "birth_time", F.ceil(F.col("paleo_time") / step).cast("int").alias("first"), "lon", "lat"), "entering")
    starts = sorted(r["first"] for r in entering.where(F.col("first") * step <= last).select("first").distinct().collect())  # one row a grid of ages
    index = polygons.cells(plates.select("t", "plate", "xyz"), depth, ("t",), "plate", inside)
    turns = stored(anchored.select(F.col("time").alias("t"), "plate", "q").join(anchored.select((F.col("time") - step).alias("t"), "plate", F.col("q").alias("before")), ["t", "plate"]).select("t", "plate", stage(F.col("before"), F.col("q")).alias("turn")), "turns")
    shape = "paleo_time double, point_id bigint, birth_time double, t double, plate int, lon double, lat double"
    written, k, moved = bool(starts), (starts or [0])[0], None
    while starts or moved is not None:
        now = entering.where(F.col("first") == k).drop("first") if k in starts else None
        now = moved if now is None else now if moved is None else moved.unionByName(now)
        starts = [x for x in starts if x > k]
        if now is not None:
            t = float(k * step)
            held = polygons.located(now, index.where(F.col("t") == t).drop("t"), depth).withColumns({"t": F.lit(t), "plate": F.array_min("polygons").cast("int")}).drop("polygons")
            held.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in shape.split(", "))).write.option("compression", "zstd").parquet(f"{folder}/step={k}")
            here = spark.read.schema(shape).parquet(f"{folder}/step={k}")
            goes = here.where((F.col("t") + step <= F.col("birth_time")) & F.col("plate").isNotNull()).join(turns.where(F.col("t") == t).drop("t"), "plate") if t + step <= last else None
            moved = None
            if goes is not None and goes.limit(1).count():
                there = sphere.evaluated(goes, v=turned(F.col("turn"), sphere.from_lon_lat(F.col("lon"), F.col("lat"))))
                moved = there.select("paleo_time", "point_id", "birth_time", sphere.lon_of(F.col("v")).alias("lon"), sphere.lat_of(F.col("v")).alias("lat"))
        k += 1
    return spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(folder) if written else spark.createDataFrame([], shape)


def obstacles_at(continents: DataFrame, sections: DataFrame, anchored: DataFrame, times: list[float], types: list[str]) -> DataFrame:
    """Rows (time, role, kind, xyz) of obstacles: continents (plate, kind, xyz, begin_time, end_time) moved to each time they exist at, and
    resolved boundary sections (time, feature_type, xyz) of ``types`` as lines; no type means no section."""
    rot = anchored.select(F.col("time").alias("t"), "plate", "q")
    there = valid_at(continents, times).join(rot, ["t", "plate"])
    moved = there.select(F.col("t").alias("time"), F.lit("obstacle").alias("role"), "kind", F.transform("xyz", lambda v: turned(F.col("q"), v)).alias("xyz"))
    if not types:
        return moved
    lines = of_types(sections, types).where(F.col("time").isin([float(t) for t in times]))
    return moved.unionByName(lines.select("time", F.lit("obstacle").alias("role"), F.lit("polyline").alias("kind"), "xyz"))


def distances_around(histories: DataFrame, sources: DataFrame, obstacles: DataFrame, depth: int, threshold: float | None = None) -> DataFrame:
    """Rows (paleo_time, point_id, t, dist_km): for each row of ``carried``, the way to the nearest source at that time around the obstacles.

    ``sources`` and ``obstacles`` have time, role, kind, xyz. All times are relaxed together; each time's
    grid is computed once for all points seen then, and leaves the work when its own distances are settled. Where nothing is
    reached, or within ``threshold`` radians, the distance counts as half the circumference.
    """
    seen = histories.select(F.struct("paleo_time", "point_id").alias("query_id"), F.col("t").alias("time"), "lon", "lat")
    times = seen.select("time").distinct()
    both = sources.unionByName(obstacles).join(times, "time", "left_semi")
    nodes = stored(graph.node_distances(both, depth, math.pi if threshold is None else threshold), "node-distances")
    found = graph.path_distances(seen, nodes, depth)
    every = seen.select("query_id", "time").join(found, ["query_id", "time"], "left")
    return every.select("query_id.*", F.col("time").alias("t"), (F.coalesce("dist_rad", F.lit(math.pi)) * MEAN_RADIUS_KM).alias("dist_km"))
