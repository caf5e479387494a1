"""Geometry on the unit sphere as column expressions; vectors are structs (x, y, z), angles radians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def from_lon_lat(lon: Column, lat: Column) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    return vector(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))


def lat_of(v: Column) -> Column:
    return F.degrees(F.atan2(v["z"], F.hypot(v["x"], v["y"])))


def lon_of(v: Column) -> Column:
    return F.degrees(F.atan2(v["y"], v["x"]))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, k: Column) -> Column:
    return vector(a["x"] * k, a["y"] * k, a["z"] * k)


def unit(a: Column) -> Column:
    n = norm(a)
    return scaled(a, F.lit(1.0) / F.when(n != 0, n))


def plus(a: Column, b: Column) -> Column:
    return vector(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def angle(a: Column, b: Column) -> Column:
    """Angle between two vectors, accurate for small and large ones alike."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance by the haversine formula."""
    h = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def between(a: Column, b: Column, part: Column) -> Column:
    """Point on the shorter arc from a to b at ``part`` of its length."""
    w = angle(a, b)
    s = F.when(F.sin(w) != 0, F.sin(w))
    u, v = F.sin((1 - part) * w) / s, F.sin(part * w) / s
    return F.when(w == 0, a).otherwise(plus(scaled(a, u), scaled(b, v)))


def arc_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point to the shorter arc from a to b."""
    n = unit(cross(a, b))
    beside = (dot(cross(n, a), p) >= 0) & (dot(cross(b, n), p) >= 0)
    to_ends = F.least(angle(p, a), angle(p, b))
    return F.when(norm(cross(a, b)) == 0, to_ends).when(beside, F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p, n)))))).otherwise(to_ends)


def azimuth(at: Column, direction: Column) -> Column:
    """Clockwise angle from north, in [0, 2 pi), of a tangent direction at a point."""
    east = unit(vector(-at["y"], at["x"], F.lit(0.0)))
    north = cross(at, east)
    a = F.atan2(dot(direction, east), dot(direction, north))
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def rotated(v: Column, pole: Column, by: Column) -> Column:
    """Rotation of a vector about a unit pole (Rodrigues)."""
    c, s = F.cos(by), F.sin(by)
    return plus(plus(scaled(v, c), scaled(cross(pole, v), s)), scaled(pole, dot(pole, v) * (1 - c)))


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out here and once: exploding one struct keeps the optimiser from
    writing a long expression out again wherever the next step refers to it."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(c for c in df.columns if c not in columns), one.alias("_e")).select("*", "_e.*").drop("_e")
