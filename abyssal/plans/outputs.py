"""Queries of output grids, feature files and the training table's look-up, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibrate, lifetime, products
from ..sources import gpml, netcdf, text
from ..storage import shared_dir
from .registry import query, rounded, six, table
from .tables import SUPPLIERS, suppliers

_OBSERVED = """obs AS (SELECT o_custkey AS point_id, (o_custkey % 3)::DOUBLE AS paleo_time, (o_orderkey % 4)::DOUBLE AS t, o_totalprice / 100.0 AS dist_km,
 (o_custkey % 72) AS i_lon, (o_custkey % 35) AS i_lat FROM orders)"""


def _observed(spark, sf_dir) -> DataFrame:
    k = F.col("o_custkey")
    at = {"lon": (k % 72) * 5.0 - 180.0, "lat": (k % 35) * 5.0 - 90.0}
    return table(spark, sf_dir, "orders").select(
        k.alias("point_id"), (k % 3).cast("double").alias("paleo_time"), (F.col("o_orderkey") % 4).cast("double").alias("t"), (F.col("o_totalprice") / 100.0).alias("dist_km"), *(c.alias(n) for n, c in at.items()),
    )


def _products(spark, sf_dir) -> DataFrame:
    observed = _observed(spark, sf_dir)
    points = observed.select("paleo_time", "point_id", "lon", "lat").distinct()
    return products.proximity_products(observed, lifetime.lifetime_statistics(observed), points)


@query(f"""WITH {_OBSERVED}, s AS (SELECT paleo_time, i_lon, i_lat, point_id, avg(dist_km) AS mean, stddev_pop(dist_km) AS std FROM obs GROUP BY ALL),
 p AS (SELECT 'distance' AS product, t AS time, i_lon, i_lat, dist_km AS z FROM obs UNION ALL SELECT 'mean', paleo_time, i_lon, i_lat, mean FROM s UNION ALL SELECT 'std', paleo_time, i_lon, i_lat, std FROM s)
 SELECT printf('%s_%.2f.nc', product, time) AS path, i_lon::INT AS i_lon, i_lat::INT AS i_lat, i_lon * 5.0::DOUBLE - 180 AS lon, i_lat * 5.0::DOUBLE - 90 AS lat, round(avg(z), 6) AS z FROM p GROUP BY ALL""")
def proximity_grid_files(spark, sf_dir):
    """Products of a proximity run as netCDF files, read back."""
    nodes = products.gridded(_products(spark, sf_dir), 5.0, ("product", "time"), on=True)
    files = netcdf.grid_files(nodes.withColumn("name", F.format_string("%s_%.2f.nc", "product", "time")), 5.0, "name")
    return rounded(netcdf.grid_rows(files), "z")


@query(f"""WITH {SUPPLIERS}, g AS (SELECT (i % 37)::INT AS i_lon, (i // 37)::INT AS i_lat FROM range(37 * 19) t(i)),
 p AS (SELECT i_lon, i_lat, node_id, z, lon - (i_lon * 10 - 180) AS dx, lat - (i_lat * 10 - 90) AS dy FROM g, s),
 f AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, floor(((degrees(atan2(dy, dx)) + 360) % 360) / 90)::INT % 4 AS sector FROM p),
 n AS (SELECT *, row_number() OVER (PARTITION BY i_lon, i_lat, sector ORDER BY d, node_id) AS n FROM f WHERE d <= 15)
 SELECT i_lon, i_lat, round(sum(z / (1 + (3 * d / 15) ** 2)) / sum(1 / (1 + (3 * d / 15) ** 2)), 6) AS z FROM n WHERE n = 1 GROUP BY 1, 2 HAVING count(*) >= 2""")
def gridded_between_nodes(spark, sf_dir):
    return rounded(products.gridded(suppliers(spark, sf_dir).withColumnRenamed("node_id", "point_id"), 10.0), "z")


@query("""SELECT s_suppkey::VARCHAR AS feature_id, CASE s_suppkey % 2 WHEN 0 THEN 'margin' ELSE 'ridge' END AS feature_type, (s_suppkey % 7)::INT AS plate, s_acctbal AS begin_time,
 k::INT AS place, (s_suppkey % 100 + k)::DOUBLE AS lon, (s_suppkey % 50 + 2 * k)::DOUBLE AS lat FROM supplier, (SELECT unnest([0, 1]) AS k)""")
def feature_json(spark, sf_dir):
    """Lines of three points written as JSON feature collections and read back as the starts of their two arcs."""
    k = F.col("s_suppkey")
    line = F.array(*(F.array((k % 100 + i).cast("double"), (k % 50 + 2 * i).cast("double")) for i in range(3)))
    properties = F.struct(F.when(k % 2 == 0, "margin").otherwise("ridge").alias("feature_type"), (k % 7).alias("plate"), F.col("s_acctbal").alias("begin_time"))
    feature = F.struct(k.cast("string").alias("id"), properties.alias("properties"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))
    rows = table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value"))
    arcs = text.arcs(text.parsed_features(rows))
    lon, lat = F.degrees(F.atan2(F.col("a.y"), F.col("a.x"))), F.degrees(F.asin(F.col("a.z")))
    return arcs.select("feature_id", "feature_type", "plate", "begin_time", "place", six(lon).alias("lon"), six(lat).alias("lat"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, round(s_acctbal, 6) AS sedthick FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def training_replaced(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("sedthick"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("sedthick"))
    return rounded(calibrate.replaced(rows, new, ["l_suppkey"], "sedthick"), "sedthick")


@query("""SELECT 's' || k AS feature_id, CASE k % 3 WHEN 0 THEN 'PassiveContinentalBoundary' WHEN 1 THEN 'HotSpot' ELSE 'Coastline' END AS feature_type, CASE WHEN k % 5 <> 0 THEN (k % 7)::INT ELSE -1 END AS plate,
 s_acctbal AS begin_time, CASE k % 3 WHEN 0 THEN 'LineString' WHEN 1 THEN 'Point' ELSE 'Polygon' END AS kind, count(*) AS n_points,
 round(sum(((k * 37) % 180 + p) * (p + 1)), 6)::DOUBLE AS lon_sum, round(sum(((k * 13) % 80 + p % 3 * 0.5) * (p + 1)), 6)::DOUBLE AS lat_sum
 FROM (SELECT k, unnest([0, 1, 2, 3]) AS p FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 3 <> 1 UNION ALL SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey % 3 = 1) g JOIN supplier ON s_suppkey = k GROUP BY k, s_acctbal""")
def feature_gpml(spark, sf_dir):
    """Points, lines and rings written as GPML files and read back; sums of coordinates by place tell their order."""
    k = F.col("s_suppkey")
    at = lambda i: F.array(((k * 37) % 180 + i).cast("double"), ((k * 13) % 80 + i % 3 * 0.5).cast("double"))
    kind = F.when(k % 3 == 0, "LineString").when(k % 3 == 1, "Point").otherwise("Polygon")
    name = F.when(k % 3 == 0, "PassiveContinentalBoundary").when(k % 3 == 1, "HotSpot").otherwise("Coastline")
    features = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("feature_id"), name.alias("feature_type"), F.when(k % 5 != 0, (k % 7).cast("int")).alias("plate"), F.col("s_acctbal").alias("begin_time"),
        F.lit(None).cast("double").alias("end_time"), kind.alias("kind"), F.lit(0).alias("part"), F.when(k % 3 == 1, F.array(at(0))).otherwise(F.array(*map(at, range(4)))).alias("points"),
    )
    path = f"{shared_dir(spark)}/abyssal-gpml-{uuid.uuid4().hex}"
    gpml.write_gpml(features, path)
    total = lambda c: six(F.aggregate(F.transform("points", lambda p, i: p[c] * (i + 1)), F.lit(0.0), lambda a, x: a + x))
    return gpml.read_gpml(spark, path).select("feature_id", "feature_type", F.coalesce("plate", F.lit(-1)).alias("plate"), "begin_time", "kind", F.size("points").cast("long").alias("n_points"), total(0).alias("lon_sum"), total(1).alias("lat_sum"))
