"""Polygons on the sphere, of any size: area, orientation, filled pixels, and the polygons that hold a point.

A polygon is a ring of vertices (array of unit vectors, the last joined to the first). Its edges are
rows; nothing asks a point of all of a polygon's vertices. A ring alone does not say
which side is inside: it is the smaller one, or with ``inside="left"`` the one to the left of the ring's
way, which may be larger than a hemisphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from ..storage import stored
from .grid import pixel_at, pixel_nodes, pixel_vector
from .spatial_join import distance_to_lines, sphere_pairs, tessellated


def edges(polygons: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows (*key, edge, a, b) of the edges of rings (*key, xyz); those without length go."""
    ring = F.zip_with("xyz", F.concat(F.slice("xyz", 2, F.greatest(F.lit(0), F.size("xyz") - 1)), F.slice("xyz", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return polygons.where(F.size("xyz") > 0).select(*key, F.posexplode(ring).alias("edge", "e")).select(*key, "edge", "e.a", "e.b").where("a <> b")


def facts(sides: DataFrame, key: tuple[str, ...], inside: str = "smaller") -> DataFrame:
    """Rows (*key, area, clockwise, north_inside) from ``edges``: the area inside in steradians, whether the ring goes round the
    smaller side clockwise, and whether the north pole is inside.

    The area left of the ring is the sum of the signed triangles of the north pole with each edge; the turns of
    longitude tell which side the pole is on.
    """
    if inside not in ("smaller", "left"):
        raise ValueError("inside is 'smaller' or 'left'")
    a, b = F.col("a"), F.col("b")
    excess = 2 * F.atan2(a["x"] * b["y"] - a["y"] * b["x"], 1 + a["z"] + b["z"] + sphere.dot(a, b))
    turn = F.atan2(a["x"] * b["y"] - a["y"] * b["x"], a["x"] * b["x"] + a["y"] * b["y"])
    sums = sides.groupBy(*key).agg(F.sum(excess).alias("s"), F.round(F.sum(turn) / (2 * math.pi)).alias("turns"))
    left = F.when(F.col("s") > 0, F.col("s")).otherwise(4 * math.pi + F.col("s"))
    north_left = F.when(F.col("turns") == 0, F.col("s") < 0).otherwise(F.col("turns") > 0)
    small = F.lit(True) if inside == "left" else left <= 2 * math.pi
    return sums.select(*key, F.when(small, left).otherwise(4 * math.pi - left).alias("area"), (left > 2 * math.pi).alias("clockwise"), (north_left == small).alias("north_inside"))


def _index(lon: Column, size: float) -> Column:
    """The first column whose middle meridian is not west of ``lon``."""
    return F.ceil((lon + 180.0) / size - 0.5).cast("int")


def filled(sides: DataFrame, known: DataFrame, depth: int, key: tuple[str, ...]) -> DataFrame:
    """Rows (*key, cell) of the pixels whose centre is inside, from ``edges`` and ``facts``.

    Each column's middle meridian is a scan line from the north pole: edges are dealt to the meridians that they cross,
    and a centre is inside by the parity of the crossings north of it.
    """
    n_lon, n_lat, size = 4 << depth, 2 << depth, 90.0 / (1 << depth)
    rows = sphere.evaluated(sides, lon_a=sphere.lon_of(F.col("a")), lon_b=sphere.lon_of(F.col("b")), n=sphere.cross(F.col("a"), F.col("b")))
    shift = F.when(F.col("lon_b") - F.col("lon_a") > 180, -n_lon).when(F.col("lon_b") - F.col("lon_a") < -180, n_lon).otherwise(0)
    rows = rows.withColumns({"ka": _index(F.col("lon_a"), size), "kb": _index(F.col("lon_b"), size) + shift})
    first, end = F.least("ka", "kb"), F.greatest("ka", "kb")
    rows = rows.where(first < end).select(*key, "n", F.explode(F.sequence(first, end - 1)).alias("k"))
    lon = F.radians(-180.0 + (F.pmod("k", F.lit(n_lon)) + 0.5) * size)
    across, n = F.col("n")["x"] * F.cos(lon) + F.col("n")["y"] * F.sin(lon), F.col("n")
    lat = F.degrees(F.atan2(-across * F.signum(n["z"]), F.abs(n["z"])))
    cuts = rows.select(*key, F.pmod("k", F.lit(n_lon)).cast("int").alias("col"), lat.alias("lat"))
    whole = known.where("north_inside").select(*key, F.explode(F.sequence(F.lit(0), F.lit(n_lon - 1))).alias("col"), F.lit(None).cast("double").alias("lat"))
    lines = cuts.unionByName(whole).groupBy(*key, "col").agg(F.collect_list("lat").alias("lats")).join(known.select(*key, "north_inside"), list(key))
    odd = lambda r: F.size(F.filter("lats", lambda x: x > -90.0 + (r + 0.5) * size)) % 2 == 1
    inside = F.filter(F.sequence(F.lit(0), F.lit(n_lat - 1)), lambda r: odd(r) != F.col("north_inside"))
    return lines.select(*key, "col", F.explode(inside).alias("row")).select(*key, (F.col("row") * n_lon + F.col("col")).cast("int").alias("cell"))


def pixels_inside(polygons: DataFrame, depth: int, key: tuple[str, ...], inside: str = "smaller") -> DataFrame:
    """Rows (*key, cell): the pixels whose centre is inside polygons (*key, xyz)."""
    sides = edges(polygons, key)
    return filled(sides, facts(sides, key, inside), depth, key)


def cells(polygons: DataFrame, depth: int, by: tuple[str, ...] = (), polygon: str = "polygon_id", inside: str = "smaller") -> DataFrame:
    """An index of polygons (*by, polygon, xyz) for ``located``: rows (*by, cell, held), one a pixel that a polygon reaches.

    ``held`` has for each polygon whether the pixel's centre is inside and the edges that may lie between the centre
    and a point of the pixel; pixels deep inside have none. Written to the shared folder.
    """
    key, size = (*by, polygon), math.radians(90.0 / (1 << depth))
    sides = stored(edges(polygons.select(*key, "xyz"), key), "polygon-edges")
    full = filled(sides, facts(sides, key, inside), depth, key).select(*key, "cell", F.lit(True).alias("centre"), F.lit(None).cast(sides.select(F.struct("edge", "a", "b")).schema[0].dataType).alias("side"))
    pieces = tessellated(sides, size / 2).select(*key, "edge", "a", "b", sphere.lon_of(F.col("mid")).alias("lon2"), sphere.lat_of(F.col("mid")).alias("lat2"))
    spark = polygons.sparkSession
    middles = pixel_nodes(spark, depth).select(F.col("node_id").alias("cell"), "lon", "lat")
    half = size * math.sqrt(0.5) * (1 + 1e-6)
    near = sphere_pairs(middles, pieces, half + size / 4)
    border = near.select(*key, "cell", F.lit(False).alias("centre"), F.struct("edge", "a", "b").alias("side"))
    each = full.unionByName(border).groupBy(*key, "cell").agg(F.max("centre").alias("centre"), F.collect_set("side").alias("sides"))
    held = F.struct(F.col(polygon).alias("polygon"), "centre", F.transform("sides", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias("sides"))
    return stored(each.groupBy(*by, "cell").agg(F.collect_list(held).alias("held")), "polygon-cells")


def crosses(p: Column, q: Column, a: Column, b: Column) -> Column:
    """Whether the short arc p-q crosses the arc a-b; an arc's second end belongs to the next one of a ring."""
    n, m = sphere.cross(p, q), sphere.cross(a, b)
    to_a, to_b, of_p, of_q = (x >= 0 for x in (sphere.dot(n, a), sphere.dot(n, b), sphere.dot(m, p), sphere.dot(m, q)))
    return (to_a != to_b) & (of_p != of_q) & (to_b == of_p)


def located(points: DataFrame, index: DataFrame, depth: int, by: tuple[str, ...] = (), name: str = "polygons") -> DataFrame:
    """Points (*by, lon, lat, others) with the sorted array of the polygons of ``cells`` (same depth and ``by``) that hold them; empty if none does.

    One equi-join on the pixel: a point meets the few edges in its own pixel, however large or detailed the
    polygons are, and a pixel with most of the points is split like any other hot key.
    """
    at = sphere.evaluated(points, _p=sphere.from_lon_lat(F.col("lon"), F.col("lat")))
    at = sphere.evaluated(at, _cell=pixel_at(F.col("_p"), depth)).withColumn("_c", pixel_vector(F.col("_cell"), depth))
    met = at.join(index.select(*by, F.col("cell").alias("_cell"), F.col("held").alias("_held")), [*by, "_cell"], "left")
    odd = lambda h: F.size(F.filter(h["sides"], lambda s: crosses(F.col("_c"), F.col("_p"), s["a"], s["b"]))) % 2 == 1
    inside = F.transform(F.filter("_held", lambda h: h["centre"] != odd(h)), lambda h: h["polygon"])
    none = F.slice(F.transform("_held", lambda h: h["polygon"]), 1, 0)
    empty = F.coalesce(none, F.array().cast(index.select(F.transform("held", lambda h: h["polygon"])).schema[0].dataType))
    return met.withColumn(name, F.coalesce(F.array_sort(inside), empty)).select(*points.columns, name)


def distance_to_polygons(points: DataFrame, rings: DataFrame, depth: int, solid: bool, polygon: str = "polygon_id", threshold: float | None = None, inside: str = "smaller") -> DataFrame:
    """Rows (query_id, dist_km): distance of points (query_id, lon, lat) to the nearest of ``rings`` (polygon, xyz), to its outline or, if ``solid``,
    0 for points inside one. Beyond ``threshold`` radians as in ``distance_to_lines``."""
    out = distance_to_lines(points, edges(rings, (polygon,)), threshold)
    if not solid:
        return out
    held = located(points.select("query_id", "lon", "lat"), cells(rings, depth, polygon=polygon, inside=inside), depth).where(F.size("polygons") > 0)
    return out.join(held.select("query_id", F.lit(0.0).alias("_in")), "query_id", "left").select("query_id", F.coalesce("_in", "dist_km").alias("dist_km"))
