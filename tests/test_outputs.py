"""Output grids, feature files and the look-ups of the training table."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from abyssal.operators import calibrate, grid, products, spatial_join, stats
from abyssal.sources import netcdf, sinks, text

POINTS = "point_id long, lon double, lat double, z double"


def test_raster_on_nodes_is_read_back(spark, tmp_path):
    points = spark.createDataFrame([(1, -180.0, -90.0, 4.0), (2, 0.0, 0.0, 7.0), (3, 0.0, 0.0, 9.0), (4, 180.0, 90.0, math.nan)], POINTS)
    sinks.write_raster(points, f"file://{tmp_path}", "a/g.nc", 10.0)
    got = {(r["i_lon"], r["i_lat"], r["lon"], r["lat"]): r["z"] for r in netcdf.read_grids(spark, str(tmp_path / "a" / "g.nc")).collect()}
    assert got == {(0, 0, -180.0, -90.0): 4.0, (18, 9, 0.0, 0.0): 8.0}


def test_points_between_nodes_need_two_quarters(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0, 5.0), (2, -1.0, 1.0, 9.0)], POINTS)
    got = {(r["i_lon"], r["i_lat"]): r["z"] for r in products.gridded(points, 10.0).collect()}
    assert got[(18, 9)] == pytest.approx(7.0) and (19, 9) not in got
    assert (19, 9) in {(r["i_lon"], r["i_lat"]) for r in products.gridded(points, 10.0, least=1).collect()}
    assert products.gridded(points.limit(0), 10.0).count() == 0


def test_products_as_text_and_grids(spark, tmp_path):
    observed = spark.createDataFrame([(0.0, 0.0, 1, 3.0, 4.0, 10.0), (0.0, 5.0, 1, 5.0, 4.0, 30.0)], "paleo_time double, t double, point_id long, lon double, lat double, dist_km double")
    statistics = spark.createDataFrame([(0.0, 1, 2, 20.0, 10.0)], "paleo_time double, point_id long, n long, mean_km double, std_km double")
    points = spark.createDataFrame([(0.0, 1, 0.0, 0.0)], "paleo_time double, point_id long, lon double, lat double")
    rows = products.proximity_products(observed, statistics, points)
    sinks.write_products(rows, f"file://{tmp_path}", 10.0)
    assert spark.read.text(f"{tmp_path}/xyz/product=mean/time=0.00").first()["value"] == "0.0 0.0 20.0"
    assert spark.read.text(f"{tmp_path}/xyz/product=distance/time=5.00").first()["value"] == "5.0 4.0 30.0"
    assert [r["z"] for r in netcdf.read_grids(spark, f"{tmp_path}/grid/std_0.00.nc").collect()] == [10.0]
    fine = spark.createDataFrame([(7, 1.0, 1.0)], "fine_id long, lon double, lat double")
    weights = spatial_join.upscale_weights(points.select(F.col("point_id").alias("src_id"), "lon", "lat"), fine, 10.0)
    up = products.upscaled_products(rows, weights, fine).collect()
    assert sorted((r["product"], r["time"], r["z"]) for r in up) == [("distance", 0.0, 10.0), ("distance", 5.0, 30.0), ("mean", 0.0, 20.0), ("std", 0.0, 10.0)]


def test_average_rate_is_text_and_grid(spark, tmp_path):
    points = spark.createDataFrame([(1, 0.0, 0.0, 2.5)], POINTS)
    sinks.write_average_rate(points, f"file://{tmp_path}", 10.0)
    assert spark.read.text(f"{tmp_path}/xyz").first()["value"] == "0.0 0.0 2.5"
    assert netcdf.read_grids(spark, f"{tmp_path}/rate.nc").first()["z"] == 2.5


def test_plain_outputs(spark, tmp_path):
    points = grid.grid_points(spark, 90.0).limit(3).withColumn("z", F.lit(1.5))
    sinks.write_predictions(points, str(tmp_path / "t"), 90.0, text=True)
    sinks.write_predictions(points, str(tmp_path / "g"), 90.0, text=False)
    assert spark.read.text(str(tmp_path / "t")).count() == 3
    assert spark.read.parquet(str(tmp_path / "g")).where("NOT isnan(z)").count() == 3 and spark.read.parquet(str(tmp_path / "g")).count() == 15
    feature = json.loads(sinks.coverage_json(spark.createDataFrame([(1.0, 2.0, 10.0, 3.5)], "lon double, lat double, time double, v double"), "time", 0.5, ["v"]).first()["value"])
    assert feature == {"point": {"lon": 1.0, "lat": 2.0}, "valid": {"begin": 10.5, "end": 9.5}, "scalars": {"v": 3.5}}
    lines = sinks.table_lines(spark.createDataFrame([(2.0, 1.0), (1.0, 9.0)], "t double, v double"), "%5.1f %6.2f", "t", "v")
    assert [r["value"] for r in lines.collect()] == ["  1.0   9.00", "  2.0   1.00"]


def test_rotation_file(spark, tmp_path):
    (tmp_path / "r.rot").write_text("101  0.0   0.0  0.0  0.0  001 ! start\n101 10.0  60.5 -30.0  4.25 001 !x\n999 0.0 0.0 0.0 0.0 999 ! comment\n\n")
    got = text.read_rotations(spark, str(tmp_path / "r.rot")).orderBy("time").collect()
    assert [tuple(r) for r in got] == [(101, 1, 0.0, 0.0, 0.0, 0.0), (101, 1, 10.0, 60.5, -30.0, 4.25)]


def test_features_of_all_kinds(spark, tmp_path):
    def feature(kind, coordinates):
        return {"id": kind, "properties": {"feature_type": "x", "plate": 3, "end_time": 1.5}, "geometry": {"type": kind, "coordinates": coordinates}}

    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [("Point", [1, 2]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", ring), ("MultiLineString", [ring, ring]), ("Polygon", [ring]), ("MultiPolygon", [[ring], [ring, ring]]), ("Other", [])]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(*s) for s in shapes]}, indent=1))
    rows = text.read_features(spark, str(tmp_path / "f.json"))
    assert {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()} == {"Point": 1, "MultiPoint": 2, "LineString": 1, "MultiLineString": 2, "Polygon": 1, "MultiPolygon": 3}
    first = rows.where("kind = 'Point'").first()
    assert first["points"] == [[1.0, 2.0]] and first["plate"] == 3 and first["begin_time"] is None and first["end_time"] == 1.5
    assert text.arcs(rows).count() == 7 * 3


def test_named_table_can_be_strict(spark, tmp_path):
    (tmp_path / "n.txt").write_text("1 2 3\n")
    assert text.read_named(spark, str(tmp_path / "n.txt")).first()["sedrate"] == 3.0
    with pytest.raises(Exception, match="(?i)malformed"):
        text.read_named(spark, str(tmp_path / "n.txt"), strict=True).collect()


def test_replacing_needs_every_key(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k long, sedthick double")
    new = spark.createDataFrame([(1, 50.0), (2, None)], "k long, sedthick double")
    assert sorted(calibrate.replaced(rows, new, ["k"], "sedthick").collect(), key=str) == [(1, 50.0), (2, None)]
    with pytest.raises(Exception, match="no value for"):
        calibrate.replaced(rows, new.where("k = 1"), ["k"], "sedthick").collect()


def test_one_row_of_equal_ones(spark):
    rows = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, None, "n"), (2, 9, "z")], "k long, o long, v string")
    assert sorted(tuple(r) for r in stats.first_of_equal(rows, ["k"], ["o"]).collect() if r["k"] == 1) == [(1, 2, "b")]
    assert sorted(tuple(r) for r in stats.last_of_key(rows, ["k"], ["o"]).collect()) == [(1, 3, "c"), (2, 9, "z")]


def test_fits_with_and_without_rivers(spark):
    rows = spark.range(400).select((F.col("id") % 40).cast("double").alias("lon"), (1.0 + F.col("id") % 17).alias("age"), (10.0 + F.col("id") % 23).alias("pcb_mean_dist"), (1.0 / (1 + F.col("id") % 5)).alias("rivers"))
    rows = rows.withColumn("sedrate", F.exp(0.05 * F.col("age") + F.col("rivers")))
    full, plain = calibrate.fit(rows, ["age", "pcb_mean_dist", "rivers"], "sedrate"), calibrate.fit(rows, ["age", "pcb_mean_dist"], "sedrate")
    out = calibrate.with_and_without(rows, full, plain).agg(F.avg(F.abs(F.log("with_rivers") - F.log("sedrate"))).alias("w"), F.avg(F.abs(F.log("without_rivers") - F.log("sedrate"))).alias("n")).first()
    assert out["w"] < 0.1 < out["n"]
    got = calibrate.objective(rows.drop("rivers").withColumn("r", F.col("age")), lambda w: F.col("r") * w[0], [1.0], ["age", "pcb_mean_dist"], "sedrate", 3)
    assert -1.0 <= got < 0.5
    line = calibrate.curve(spark, calibrate.fit(rows, ["age"], "sedrate"), 1.0).collect()
    assert len(line) == 20 and line[0]["age"] == 1.0 and line[-1]["age"] == 17.0
