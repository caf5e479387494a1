"""Searches whose work must not grow with the square of their input, and rows that are given more than once."""

import math
import random

from pyspark.sql import functions as F

from abyssal.functions import sphere
from abyssal.operators import kinematics, spatial_join

ARCS = "time double, lon double, lat double, conv_cm_yr double, conv_obliq_deg double, arc_len_deg double, subducting_plate int, overriding_plate int"


def _dist(a, b):
    (lon, lat), (lon2, lat2) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((lat2 - lat) / 2) ** 2 + math.cos(lat) * math.cos(lat2) * math.sin((lon2 - lon) / 2) ** 2
    return 2 * math.asin(min(1.0, math.sqrt(h)))


def test_equal_lines_of_two_ids_count_twice_with_their_id(spark):
    line = [{"x": 1.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 1.0, "z": 0.0}]
    rows = [(1, "polyline", 100, None, None, line), (1, "polyline", 100, None, None, line), (2, "polyline", 100, None, None, line)]
    features = spark.createDataFrame(rows, "geom_id long, kind string, plate int, begin_time double, end_time double, xyz array<struct<x: double, y: double, z: double>>")
    still = spark.createDataFrame([(0.0, 100, {"w": 1.0, "x": 0.0, "y": 0.0, "z": 0.0})], "time double, plate int, q struct<w: double, x: double, y: double, z: double>")
    quarter = math.pi / 2 * 6371.0
    all_one = kinematics.margin_lengths_at(features, still, [0.0]).first()["length_km"]
    by_id = kinematics.margin_lengths_at(features, still, [0.0], same=("geom_id",)).first()["length_km"]
    assert abs(all_one - quarter) < 10 and abs(by_id - 2 * all_one) < 1e-6


def test_a_trench_arc_given_twice_counts_once(spark):
    arcs = spark.createDataFrame([(0.0, 1.0, 2.0, 5.0, 10.0, 1.0, 200, 100)] * 2 + [(0.0, 1.0, 2.0, 5.0, 10.0, 1.0, 300, 100)], ARCS)
    nodes = spark.createDataFrame([(1, 1.0, 2.5, 70.0)], "node_id long, lon double, lat double, z double")
    assert sorted(r["subducting_plate"] for r in kinematics.thickness_at_arcs(arcs, nodes).collect()) == [200, 300]


def test_a_query_meets_few_of_many_items_that_lie_close_together(spark):
    rng = random.Random(1)
    at = lambda n: [(i, 10 + rng.random(), 20 + rng.random()) for i in range(n)]
    vector = sphere.from_lon_lat(F.col("lon"), F.col("lat"))
    items = spark.createDataFrame(at(4000), "item long, lon double, lat double").select("item", vector.alias("c"), F.lit(0.0).alias("r"))
    asked = spark.createDataFrame(at(100), "query_id long, lon double, lat double").select("query_id", vector.alias("p"), F.lit(0.0).alias("own"))
    assert spatial_join.nearest_candidates(asked, items).count() < 100 * 200


def test_nearest_near_and_counted_nodes_are_those_of_brute_force(spark):
    rng = random.Random(2)
    nodes = [(i, float(rng.randrange(-180, 180, 6)), float(rng.randrange(-90, 91, 6))) for i in range(300)] + [(900, 0.5, 89.9), (901, -179.9, 0.0)]
    asked = [(i, float(rng.randrange(-180, 181, 3)), float(rng.randrange(-90, 91, 3))) for i in range(120)] + [(500, 0.0, 0.0), (501, 0.0, 0.0), (502, None, 0.0)]
    q = spark.createDataFrame(asked, "query_id long, lon double, lat double")
    n = spark.createDataFrame(nodes, "node_id long, lon2 double, lat2 double")
    found = {r["query_id"]: (r["node_id"], r["dist"]) for r in spatial_join.nearest(q, n, 0.2).collect()}
    near, counts = spatial_join.near_places(q, n, 0.3, 0.05).collect(), {(r["lon"], r["lat"]): r["n_within"] for r in spatial_join.counts_within(q, n, 0.5).collect()}
    assert len(found) == len(asked) and found[502] == (None, None)
    for i, lon, lat in asked[:-1]:
        dists = sorted((_dist((lon, lat), (x, y)), k) for k, x, y in nodes)
        best = dists[0][0]
        assert found[i][0] is None if best > 0.2 else abs(found[i][1] - best) < 1e-9
        ours = sorted(r["node_id"] for r in near if (r["lon"], r["lat"]) == (lon, lat))
        assert ours == sorted(k for d, k in dists if d <= 0.3 and d <= best + 0.05)
        assert counts.get((lon, lat), 0) == sum(d <= 0.5 for d, _ in dists)
