"""Closed forms and brute force for what SQL cannot say."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal.functions import scalar, sphere
from abyssal.operators import calibrate, graph, grid, kinematics, lifetime, raster, spatial_join, stats
from abyssal.sources import netcdf, sinks, text
from tests import pixel_graph


def one(df):
    return df.first()[0]


def test_decompaction_starts_at_zero(spark):
    assert one(spark.range(1).select(scalar.decompacted(F.lit(0.0)))) == 0
    assert one(spark.range(1).select(scalar.average_rate(F.lit(100.0), F.lit(0.2)))) == pytest.approx(one(spark.range(1).select(scalar.decompacted(F.lit(100.0)))))


def test_cubic_at_the_mean_is_its_constant(spark):
    got = one(spark.range(1).select(scalar.predict(F.lit(scalar.RATE.mean_age), F.lit(scalar.RATE.mean_distance), scalar.RATE)))
    assert got == pytest.approx(math.exp(scalar.RATE.coefficients[0]))


def test_rivers_far_or_at_zero(spark):
    d = F.array(F.lit(0.5), F.lit(2000.0), F.lit(float("nan")))
    assert one(spark.range(1).select(scalar.weighted_inverse_sum(d, [3.0, 1.0, 1.0]))) == pytest.approx(6.0)
    assert one(spark.range(1).select(scalar.inverse_or_zero(F.lit(0.0)))) == math.inf


def test_gap_does_not_become_the_clamp(spark):
    points = grid.grid_points(spark, 90.0)
    ages = points.select("i_lon", "i_lat", F.when(F.col("i_lon") == 0, float("nan")).otherwise(500.0).alias("z"))
    got = raster.ages_and_distances(points, ages, ages, 100.0, 3000.0).select("age").distinct().collect()
    assert [r[0] for r in got] == [100.0]


def test_grid_forms_differ_where_spacing_does_not_divide(spark):
    assert grid.grid_points(spark, 7.0).agg(F.max("lon")).first()[0] == 177.0
    assert grid.stretched_grid_points(spark, 7.0).agg(F.max("lon")).first()[0] == 180.0
    with pytest.raises(ValueError):
        grid.counts(0)


def test_lifetime_times_match_a_replay(spark):
    cases = [(0.0, 0.4), (0.0, 5.0), (2.5, 9.0), (50.0, 60.0), (3.0, 100.0)]
    rows = spark.createDataFrame([(p, float(i), b) for i, (p, b) in enumerate(cases)], "paleo_time double, point_id double, birth_time double")
    got = {}
    for r in lifetime.observation_times(rows, 2, 20).collect():
        got.setdefault(int(r["point_id"]), []).append(r["t"])
    for i, (paleo, birth) in enumerate(cases):
        t, want = math.ceil(paleo / 2) * 2.0, []
        while t <= 20:
            want.append(t)
            t += 2
            if t > birth:
                break
        assert sorted(got.get(i, [])) == want


def test_sphere_join_over_pole_and_date_line(spark):
    rng = np.random.default_rng(1)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60)))] + [(60, 179.9, 0.0), (61, 10.0, 89.9)]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60)))] + [(60, -179.9, 0.1), (61, -170.0, 89.8)]
    got = {(r[0], r[1]) for r in spatial_join.sphere_pairs(spark.createDataFrame(a, "q long, lon double, lat double"), spark.createDataFrame(b, "n long, lon2 double, lat2 double"), 0.3).select("q", "n").collect()}

    def v(lon, lat):
        lon, lat = math.radians(lon), math.radians(lat)
        return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])

    want = {(i, j) for i, x, y in a for j, p, q in b if math.acos(max(-1, min(1, v(x, y) @ v(p, q)))) <= 0.3}
    assert got == want and (60, 60) in got and (61, 61) in got


def test_upscaling_weights_add_up(spark):
    coarse = grid.grid_points(spark, 30.0).select((F.col("i_lon") * 100 + F.col("i_lat")).alias("src_id"), "lon", "lat")
    fine = grid.grid_points(spark, 20.0).select((F.col("i_lon") * 100 + F.col("i_lat")).alias("fine_id"), "lon", "lat")
    w = spatial_join.upscale_weights(coarse, fine, 30.0).groupBy("fine_id").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    assert all(abs(r["s"] - 1) < 1e-12 and r["n"] <= 6 for r in w.collect())


def test_uniform_raster_smooths_to_itself(spark):
    nodes = grid.grid_points(spark, 30.0).select(F.expr("i_lon * 100 + i_lat").cast("long").alias("node_id"), "lon", "lat", F.lit(4.0).alias("z"))
    q = spark.createDataFrame([(1, 10.0, 10.0), (2, 179.0, -89.0)], "query_id long, lon double, lat double")
    assert {round(r["z"], 9) for r in spatial_join.query_raster(q, nodes, 0.5, 1.0).collect()} == {4.0}


def test_interpolation_at_nodes_gives_the_node(spark):
    points = spark.createDataFrame([(1, 30.0, 15.0)], "k long, lon double, lat double")
    r = grid.grid_points(spark, 15.0).select("i_lon", "i_lat", (F.col("i_lon") * 3.0 + F.col("i_lat") * F.col("i_lat")).alias("z"))
    for f in (raster.bilinear, raster.bicubic):
        assert f(points, r, 15.0, "k").first()["z"] == pytest.approx(14 * 3 + 49)


def test_path_without_obstacles_is_near_great_circle(spark):
    g = pixel_graph.PixelGraph(4, [], [])
    source = pixel_graph._vectors(np.array([10.0]), np.array([5.0]))
    d = g.distances(source)
    true = np.arccos(np.clip(g.xyz @ source[0], -1, 1))
    assert np.isfinite(d).all() and (d >= true - 1e-9).all() and (d[true > 0.5] <= 1.1 * true[true > 0.5] + 0.1).all()


def test_obstacles_close_nodes_and_lengthen_ways(spark):
    wall = [pixel_graph._vectors(np.array([20.0, 30.0, 30.0, 20.0]), np.array([-40.0, -40.0, 40.0, 40.0]))]
    source = pixel_graph._vectors(np.array([0.0]), np.array([0.0]))
    free, blocked = pixel_graph.PixelGraph(4, [], []), pixel_graph.PixelGraph(4, wall, [])
    at = int(np.argmax(free.xyz @ pixel_graph._vectors(np.array([50.0]), np.array([0.0]))[0]))
    assert not blocked.outside.all() and blocked.distances(source)[at] > free.distances(source)[at] + 0.2


def test_edges_match_the_graph(spark):
    g = pixel_graph.PixelGraph(2, [], [])
    want = {(i, int(m)) for e, _ in g.edges for i, m in enumerate(e) if m >= 0}
    assert {(r["src"], r["dst"]) for r in graph.neighbour_edges(spark, 2).collect()} == want


def test_distance_to_a_meridian(spark):
    lines = spark.range(1).select(sphere.from_lon_lat(F.lit(0.0), F.lit(-60.0)).alias("a"), sphere.from_lon_lat(F.lit(0.0), F.lit(60.0)).alias("b"))
    points = spark.createDataFrame([(1, 10.0, 0.0), (2, 90.0, 0.0), (3, 0.0, 80.0)], "query_id long, lon double, lat double")
    got = {r["query_id"]: r["dist_km"] / scalar.MEAN_RADIUS_KM for r in spatial_join.distance_to_lines(points, lines).collect()}
    assert got[1] == pytest.approx(math.radians(10)) and got[2] == pytest.approx(math.pi / 2) and got[3] == pytest.approx(math.radians(20))


def test_stage_velocity_about_the_pole(spark):
    rows = spark.createDataFrame([(7, 0, 0.0, 90.0, 0.0, 0.0), (7, 0, 10.0, 90.0, 0.0, 10.0), (8, 7, 0.0, 90.0, 0.0, 0.0), (8, 7, 10.0, 90.0, 0.0, 20.0), (9, 5, 0.0, 90.0, 0.0, 0.0)], "moving_plate int, fixed_plate int, time double, pole_lat double, pole_lon double, angle double")
    at = kinematics.to_anchor(kinematics.rotations_at(rows, kinematics.times(spark, 0.0, 10.0, 1.0)))
    assert {r[0] for r in at.select("plate").distinct().collect()} == {7, 8}
    both = at.where("time = 4").join(at.where("time = 5").select("plate", F.col("q").alias("before")), "plate")
    v = kinematics.stage_velocity(kinematics.stage(F.col("q"), F.col("before")), sphere.from_lon_lat(F.lit(0.0), F.lit(0.0)), 1.0)
    got = {r["plate"]: (r["s"], r["e"]) for r in both.select("plate", sphere.norm(v).alias("s"), v["y"].alias("e")).collect()}
    for plate, degrees in ((7, 1.0), (8, 3.0)):  # eastward in age means westward in time
        assert got[plate][0] == pytest.approx(math.radians(degrees) * scalar.MEAN_RADIUS_KM * 0.1) and got[plate][1] < 0


def test_lasso_agrees_with_coordinate_descent(spark):
    rng = np.random.default_rng(2)
    a, d = rng.uniform(0, 180, 400), rng.uniform(0, 3000, 400)
    y = np.exp(1 + 0.01 * a - 0.0004 * d + rng.normal(0, 0.1, 400))
    rows = spark.createDataFrame([(float(i), float(x), float(z), float(w)) for i, (x, z, w) in enumerate(zip(a, d, y))], "lon double, a double, d double, y double")
    model = calibrate.fit(rows, ["a", "d"], "y")
    za, zd = (a - a.mean()) / a.std(), (d - d.mean()) / d.std()
    x = np.stack([za, zd, za * za, za * zd, zd * zd, za**3, za * za * zd, za * zd * zd, zd**3], axis=1)
    centred, target, w = x - x.mean(0), np.log(y) - np.log(y).mean(), np.zeros(9)
    for _ in range(4000):
        for j in range(9):
            r = target - centred @ w + centred[:, j] * w[j]
            rho = centred[:, j] @ r / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.01, 0) / (centred[:, j] @ centred[:, j] / len(y))
    assert np.abs(np.array(model.coefficients[1:]) - w).max() < 1e-4
    out, fits = calibrate.out_of_fold(rows, ["a", "d"], "y", 3)
    assert len(fits) == 3 and out.count() == 400


def test_training_table_is_strict_and_reads_back(spark, tmp_path):
    lines = spark.createDataFrame([(" ".join(["1"] * 18),)], "value string")
    with pytest.raises(Exception):
        text.training_rows(lines).collect()
    good = text.training_rows(spark.createDataFrame([(" ".join(["1.5"] * 18 + ["NaN"]),)], "value string"))
    sinks.write_training(good, str(tmp_path / "t"), "\t")
    assert text.read_named(spark, str(tmp_path / "t"), "\t").first()["lon"] == 1.5


def test_classic_netcdf(spark, tmp_path):
    import struct

    def name(s):
        return struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    z = np.array([[1.0, np.nan, 3.0], [4.0, 5.0, 6.0]])
    dims, sizes = [("lat", 2), ("lon", 3)], {"lat": 16, "lon": 24, "z": 48}
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + b"".join(name(n) + struct.pack(">i", k) for n, k in dims) + struct.pack(">ii", 0, 0)
    shapes = {"lat": [0], "lon": [1], "z": [0, 1]}
    size = len(head) + 8 + sum(len(name(v)) + 4 + 4 * len(s) + 8 + 12 for v, s in shapes.items())
    body, at = struct.pack(">ii", 11, 3), size
    for v, s in shapes.items():
        body += name(v) + struct.pack(">i", len(s)) + b"".join(struct.pack(">i", i) for i in s) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 6, sizes[v], at)
        at += sizes[v]
    data = head + body + b"".join(np.asarray(x, dtype=">f8").tobytes() for x in ([-90.0, 90.0], [-180.0, 0.0, 180.0], z))
    (tmp_path / "g.nc").write_bytes(data)
    got = {(r["i_lon"], r["i_lat"]): r["z"] for r in netcdf.read_grids(spark, str(tmp_path / "g.nc")).collect()}
    assert got == {(0, 0): 1.0, (2, 0): 3.0, (0, 1): 4.0, (1, 1): 5.0, (2, 1): 6.0}


def test_outputs_by_time_and_metric(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 1, 2.0, 3.0), (1.0, 1, 4.0, 5.0)], "paleo_time double, point_id int, mean_km double, std_km double")
    sinks.write_metrics(rows, str(tmp_path / "m"), ["mean_km", "std_km"])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    sinks.write_by_time(rows, str(tmp_path / "t"), "paleo_time", "point_id", "mean_km")
    assert (tmp_path / "t" / "paleo_time=1.00").exists()
    assert stats.margin_lengths(spark.createDataFrame([(1, 1, "polyline", "x", 0.5), (1, 2, "polyline", "x", 0.5), (1, 3, "point", "y", 9.0)], "time int, geom_id int, kind string, geom_key string, length_rad double")).first()["length_km"] == pytest.approx(0.5 * scalar.MEAN_RADIUS_KM)


def test_rounds_agree_with_one_machine(spark):
    """Closed nodes, blocked edges, seeds of points and lines, and least distances against the graph on one machine."""
    at = lambda lon, lat: pixel_graph._vectors(np.array(lon, dtype=float), np.array(lat, dtype=float))
    shapes = [
        (0.0, "source", "point", at([0.0], [0.0])), (0.0, "obstacle", "polygon", at([20, 40, 40, 20], [-40, -40, 40, 40])), (0.0, "obstacle", "polyline", at([-30, -30, -60], [-50, 50, 60])),
        (1.0, "source", "point", at([100.0], [50.0])), (1.0, "source", "point", at([-100.0], [-70.0])), (1.0, "obstacle", "polygon", at([170, -170, -170, 170], [-20, -20, 30, 30])),
    ]
    rows = [(t, role, kind, [tuple(map(float, p)) for p in v]) for t, role, kind, v in shapes]
    made = spark.createDataFrame(rows, "time double, role string, kind string, xyz array<struct<x: double, y: double, z: double>>")
    got = {(r["time"], r["node_id"]): (r["outside"], r["dist_rad"]) for r in graph.node_distances(made, 3, 2.0).collect()}
    for time in (0.0, 1.0):
        of = lambda role, kind: [v for t, r, k, v in shapes if (t, r, k) == (time, role, kind)]
        g = pixel_graph.PixelGraph(3, of("obstacle", "polygon"), of("obstacle", "polyline"))
        d = g.distances(np.concatenate(of("source", "point")), 2.0)
        for i in range(len(d)):
            outside, mine = got[time, i]
            assert outside == bool(g.outside[i]) and (mine is None and not math.isfinite(d[i]) or mine == pytest.approx(d[i]))
