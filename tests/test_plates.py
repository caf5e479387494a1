"""Polygons of any size, points carried by plates, ways around obstacles, and searches that go far."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal.functions import scalar, sphere
from abyssal.operators import graph, grid, histories, kinematics, polygons, raster, spatial_join

XYZ = "xyz array<struct<x: double, y: double, z: double>>"


def ring(lon, lat):
    a, b = np.radians(np.array(lat, dtype=float)), np.radians(np.array(lon, dtype=float))
    return [tuple(map(float, v)) for v in np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)]


ROUND = np.arange(0, 360, 10.0)
SHAPES = {
    1: (10 + 12 * np.cos(np.radians(ROUND)), 20 + 9 * np.sin(np.radians(ROUND))),  # anticlockwise
    2: (ROUND - 180, 60 + 8 * np.sin(np.radians(5 * ROUND))),  # around the north pole
    3: ([170, -170, -170, 170], [-20, -20, 30, 30]),  # over the date line
    4: (ROUND - 180, -50 + 5 * np.cos(np.radians(3 * ROUND))),  # around the south pole, eastward
    5: ((10 + 12 * np.cos(np.radians(ROUND)))[::-1], (20 + 9 * np.sin(np.radians(ROUND)))[::-1]),  # clockwise
    6: (ROUND - 180, np.full(36, -20.0)),  # a cap above a hemisphere to its left
}


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([(k, ring(*v)) for k, v in SHAPES.items()], f"polygon_id int, {XYZ}")


def test_areas_and_orientation(shapes):
    sides = polygons.edges(shapes, ("polygon_id",))
    small, left = ({r["polygon_id"]: r for r in polygons.facts(sides, ("polygon_id",), m).collect()} for m in ("smaller", "left"))
    assert small[1]["area"] == pytest.approx(small[5]["area"]) == pytest.approx(left[1]["area"]) and not small[1]["clockwise"] and small[5]["clockwise"]
    assert left[5]["area"] == pytest.approx(4 * math.pi - small[5]["area"]) and left[6]["area"] > 2 * math.pi > small[6]["area"]
    assert [small[k]["north_inside"] for k in range(1, 7)] == [False, True, False, False, False, False] and left[6]["north_inside"] and left[5]["north_inside"]
    assert small[3]["area"] == pytest.approx(math.radians(20) * (math.sin(math.radians(30)) + math.sin(math.radians(20))), rel=0.02)


@pytest.mark.parametrize("depth", [1, 4])
def test_points_in_polygons_at_any_depth(spark, shapes, depth):
    rng = np.random.default_rng(3)
    z, lon = rng.uniform(-1, 1, 1500), rng.uniform(-180, 180, 1500)
    lat = np.degrees(np.arcsin(z))
    crowd = [(2000 + i, 10.0 + i / 1000, 20.0) for i in range(1500)]  # nine in ten of a kind in one pixel
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))] + crowd + [(9000, 180.0, 0.0), (9001, -180.0, 0.0), (9002, 0.0, 90.0), (9003, 0.0, -90.0)]
    given = spark.createDataFrame(points, "id int, lon double, lat double")
    got = {r["id"]: r["polygons"] for r in polygons.located(given, polygons.cells(shapes, depth), depth).collect()}
    assert len(got) == len(points)

    def held(k, lon, lat):
        v, p = np.array(ring(*SHAPES[k])), np.array(ring([lon], [lat])[0])
        w = np.roll(v, -1, axis=0)
        turn = np.arctan2(np.cross(v, w) @ p, (v * w).sum(1) - (v @ p) * (w @ p)).sum()
        return abs(turn) > math.pi and v.mean(0) @ p > 0

    for i, x, y in points:
        assert got[i] == [k for k in SHAPES if held(k, x, y)], (i, x, y)
    none = polygons.located(given.limit(3), polygons.cells(shapes.limit(0), depth), depth).collect()
    assert all(r["polygons"] == [] for r in none)


def test_left_side_may_exceed_a_hemisphere(spark, shapes):
    points = spark.createDataFrame([(1, 0.0, 50.0), (2, 0.0, -60.0)], "id int, lon double, lat double")
    got = {r["id"]: r["polygons"] for r in polygons.located(points, polygons.cells(shapes.where("polygon_id = 6"), 3, inside="left"), 3).collect()}
    assert got == {1: [6], 2: []}


def test_points_stop_where_no_plate_holds_them(spark):
    """One plate turns by ten degrees a step about the pole and carries what it holds; what leaves it stops for good."""
    box = lambda lon: ring([lon - 17, lon + 17, lon + 17, lon - 17], [-15, -15, 15, 15])
    plates = spark.createDataFrame([(float(t), 100, box(0 if t < 2 else 100)) for t in range(5)], f"t double, plate int, {XYZ}")
    turn = lambda t: (math.cos(math.radians(5 * t)), 0.0, 0.0, math.sin(math.radians(5 * t)))
    turns = spark.createDataFrame([(float(t), 100, turn(t)) for t in range(6)], "time double, plate int, q struct<w: double, x: double, y: double, z: double>")
    points = [(0.0, 1, 9.0, 0.0, 0.0), (0.0, 2, 1.0, 0.0, 0.0), (0.0, 3, 0.5, 0.0, 0.0), (0.0, 4, 9.0, 50.0, 0.0), (1.5, 5, 9.0, 95.0, 0.0), (9.0, 6, 9.0, 0.0, 0.0), (0.0, 7, -3.0, 1.0, 1.0)]
    given = spark.createDataFrame(points, "paleo_time double, point_id long, birth_time double, lon double, lat double")
    rows = histories.carried(given, plates, turns, 1, 4, depth=3).orderBy("point_id", "t").collect()
    got = {}
    for r in rows:
        got.setdefault(r["point_id"], []).append((r["t"], r["plate"], round(r["lon"], 6)))
    assert got == {
        1: [(0, 100, 0), (1, 100, 10), (2, None, 20)], 2: [(0, 100, 0), (1, 100, 10)], 3: [(0, 100, 0)], 4: [(0, None, 50)],
        5: [(2, 100, 95), (3, 100, 105), (4, 100, 115)], 7: [(0, 100, 1)],
    }
    assert histories.carried(given.limit(0), plates, turns, 1, 4).count() == 0


def test_one_id_at_two_times(spark):
    """A query at two times finds at each what lies there then."""
    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "query_id long, time double, lon double, lat double")
    n = spark.createDataFrame([(7, 0.0, 1.0, 0.0, 10.0), (8, 1.0, 2.0, 0.0, 20.0)], "node_id long, time double, lon double, lat double, z double")
    assert {(r["time"], r["z"]) for r in spatial_join.query_raster(q, n, 0.2, by=("time",)).collect()} == {(0.0, 10.0), (1.0, 20.0)}
    assert {(r["time"], r["z"]) for r in spatial_join.query_raster(q, n, 0.2, 0.1, ("time",)).collect()} == {(0.0, 10.0), (1.0, 20.0)}
    at = lambda lon, lat: sphere.from_lon_lat(F.lit(lon), F.lit(lat))
    lines = spark.range(1).select(F.lit(0.0).alias("time"), at(1.0, -5.0).alias("a"), at(1.0, 5.0).alias("b")).union(spark.range(1).select(F.lit(1.0), at(40.0, -5.0), at(40.0, 5.0)))
    for threshold in (None, 1.0):
        got = {r["time"]: r["dist_km"] for r in spatial_join.distance_to_lines(q, lines, threshold, by=("time",)).collect()}
        assert got == {0.0: pytest.approx(111.195, abs=0.01), 1.0: pytest.approx(4447.8, abs=0.5)}


def test_far_searches_meet_few_pieces(spark):
    """Points on one side and lines on the other: the pairs that are compared are few, and the nearest is among them."""
    rng = np.random.default_rng(5)
    lines = [(float(x), float(y)) for x, y in zip(rng.uniform(150, 179, 300), rng.uniform(-30, 30, 300))]
    items = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "item long, lon2 double, lat2 double").withColumn("c", sphere.from_lon_lat(F.col("lon2"), F.col("lat2"))).withColumn("r", F.lit(0.0))
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-10, 10, 200), rng.uniform(-10, 10, 200)))]
    asked = spark.createDataFrame(points, "query_id long, lon double, lat double").withColumn("p", sphere.from_lon_lat(F.col("lon"), F.col("lat"))).withColumn("own", F.lit(0.0))
    pairs = spatial_join.nearest_candidates(asked, items).select("query_id", "item").collect()
    assert len(pairs) < 200 * 300 / 4
    found = {}
    for r in pairs:
        found.setdefault(r["query_id"], set()).add(r["item"])
    v, w = np.array(ring(*zip(*lines))), np.array(ring(*list(zip(*points))[1:]))
    assert all(int((v @ p).argmax()) in found[i] for i, p in enumerate(w))


def test_a_point_at_two_times_has_two_places(spark):
    shapes = [(t, "source", "point", ring([0.0], [0.0])) for t in (0.0, 1.0)]
    nodes = graph.node_distances(spark.createDataFrame(shapes, f"time double, role string, kind string, {XYZ}"), 3)
    points = spark.createDataFrame([(1, 0.0, 10.0, 0.0), (1, 1.0, 60.0, 0.0)], "query_id long, time double, lon double, lat double")
    got = {r["time"]: r["dist_rad"] for r in graph.path_distances(points, nodes, 3).collect()}
    assert got[0.0] == pytest.approx(math.radians(10), abs=0.1) and got[1.0] == pytest.approx(math.radians(60), abs=0.15)


def test_interpolation_over_date_line_and_poles(spark):
    """A raster of ones is one everywhere, and a smooth one goes on over the seam."""
    whole = grid.grid_points(spark, 15.0)
    ones = whole.select("i_lon", "i_lat", F.lit(1.0).alias("z"))
    points = [(1, 177.0, 0.0), (2, 179.5, 40.0), (3, -179.5, 40.0), (4, 10.0, 89.9), (5, -100.0, -89.9), (6, 180.0, 90.0), (7, -180.0, -90.0)]
    given = spark.createDataFrame(points, "k long, lon double, lat double")
    for f in (raster.bilinear, raster.bicubic):
        assert {r["z"] for r in f(given, ones, 15.0, "k", periodic=True).select(F.round("z", 9).alias("z")).collect()} == {1.0}
    smooth = whole.select("i_lon", "i_lat", F.cos(F.radians("lon")).alias("z") * F.cos(F.radians("lat")))
    smooth = smooth.toDF("i_lon", "i_lat", "z")
    got = {r["k"]: r["z"] for r in raster.bicubic(given, smooth, 15.0, "k", periodic=True).collect()}
    assert all(got[k] == pytest.approx(math.cos(math.radians(x)) * math.cos(math.radians(y)), abs=0.01) for k, x, y in points)
    gap = ones.where("NOT (i_lon = 0 AND i_lat = 6)")
    near = spark.createDataFrame([(1, -172.0, 3.0)], "k long, lon double, lat double")
    assert raster.bicubic(near, gap, 15.0, "k", periodic=True).first()["z"] is None
    assert raster.bicubic(near, gap, 15.0, "k", periodic=True, least=0.5).first()["z"] == pytest.approx(1.0)
    assert raster.bicubic(near, gap, 15.0, "k", periodic=True, least=0.95).first()["z"] is None


def test_equal_lines_count_once_where_they_lie(spark):
    """Equal lines on one plate count once; on a plate that moves otherwise they are apart, and parts of lines are lines of their own."""
    line, long = ring([0, 10], [0, 0]), ring([0, 10, 20], [0, 0, 0])
    turns = spark.createDataFrame([(0.0, p, (1.0, 0.0, 0.0, 0.0)) for p in (1, 2)] + [(5.0, 1, (1.0, 0.0, 0.0, 0.0)), (5.0, 2, (math.cos(0.3), 0.0, math.sin(0.3), 0.0))], "time double, plate int, q struct<w: double, x: double, y: double, z: double>")
    rows = [("polyline", 1, None, None, line), ("polyline", 1, None, None, line), ("polyline", 2, None, 3.0, line), ("polyline", 1, None, None, long), ("point", 1, None, None, line[:1]), ("polygon", 2, 3.0, None, ring([0, 90, 90], [0, 0, 90])), ("polyline", 3, None, None, line)]
    given = spark.createDataFrame(rows, f"kind string, plate int, begin_time double, end_time double, {XYZ}")
    degree = math.radians(1) * scalar.MEAN_RADIUS_KM
    for dedupe, want in ((True, {0.0: 10 + 20 + 270, 5.0: 10 + 10 + 20}), (False, {0.0: 20 + 20 + 270, 5.0: 20 + 10 + 20})):
        got = {r["t"]: r["length_km"] for r in kinematics.margin_lengths_at(given, turns, [0.0, 5.0], dedupe).collect()}
        assert got == {t: pytest.approx(x * degree) for t, x in want.items()}
