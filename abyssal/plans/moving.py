"""Queries of moving plates, trenches and margins, and of distances to lines, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, sphere
from ..operators import kinematics, lifetime, spatial_join
from . import sphere_sql as S
from .registry import query, rounded, six, table
from .tables import ARCS, CUSTOMERS, SUPPLIERS, arcs, customers, haversine, suppliers

R = scalar.MEAN_RADIUS_KM

# All nations are plates; those from the fourth on turn relative to the first, each about a fixed pole at a steady rate.


def rotations(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey") + 1
    base = table(spark, sf_dir, "nation").select(
        (k * 100).cast("int").alias("moving_plate"), F.when(k > 3, F.lit(100)).otherwise(F.lit(0)).cast("int").alias("fixed_plate"),
        (k * 11 % 120 - 30).cast("double").alias("pole_lat"), (k * 50 % 360 - 170).cast("double").alias("pole_lon"), (0.1 + k % 10 * 0.05).alias("rate"),
    )
    return base.select("*", F.explode(F.array(F.lit(0.0), F.lit(50.0), F.lit(300.0))).alias("time")).withColumn("angle", F.col("time") * F.col("rate")).drop("rate")


def anchored(spark, sf_dir, last: float) -> DataFrame:
    return kinematics.to_anchor(kinematics.rotations_at(rotations(spark, sf_dir), kinematics.times(spark, 0.0, last, 1.0)))


def _anchored_sql(last: int) -> str:
    half = "radians(t * (0.1 + k % 10 * 0.05)) / 2"
    own = (f"cos({half})", *S.scaled(S.from_lon_lat("(k * 50 % 360 - 170)", "(k * 11 % 120 - 30)"), f"sin({half})"))
    both = S.times(S.turn("a."), S.turn("b."))
    return f"""own AS (SELECT (k * 100)::INT AS plate, t::DOUBLE AS t, {S.as_(own, "")} FROM (SELECT n_nationkey + 1 AS k FROM nation), range(0, {last + 1}) r(t)),
 rot AS (SELECT * FROM own WHERE plate <= 300 UNION ALL SELECT b.plate, b.t, {S.as_(both, "")} FROM own a JOIN own b ON a.plate = 100 AND b.plate > 300 AND a.t = b.t),
 stg AS (SELECT a.plate, a.t, {S.as_(S.times(S.turn("a."), S.inverse(S.turn("b."))), "")} FROM rot a JOIN rot b ON a.plate = b.plate AND b.t = a.t + 1)"""


_AT = S.from_lon_lat("20", "10")


@query(f"""WITH {_anchored_sql(10)}, v AS (SELECT t, plate, {S.as_(S.velocity(S.turn(""), _AT, "1.0", R), "v")} FROM stg)
 SELECT t AS time, plate, round({S.norm(S.named("v"))}, 6) AS cm_yr, round(abs({S.dot(S.named("v"), _AT)}), 6) AS radial FROM v""")
def stage_velocity(spark, sf_dir):
    a = anchored(spark, sf_dir, 10.0)
    both = a.join(a.select((F.col("time") - 1).alias("time"), "plate", F.col("q").alias("before")), ["time", "plate"])
    turned = sphere.evaluated(both, step=kinematics.stage(F.col("q"), F.col("before")), at=sphere.from_lon_lat(F.lit(20.0), F.lit(10.0)))
    moved = sphere.evaluated(turned, v=kinematics.stage_velocity(F.col("step"), F.col("at"), 1.0))
    return moved.select("time", "plate", six(sphere.norm(F.col("v"))).alias("cm_yr"), six(F.abs(sphere.dot(F.col("v"), F.col("at")))).alias("radial"))


# Trenches: the suppliers' arcs, at three times, some of them topological lines.


def sections(spark, sf_dir) -> DataFrame:
    k = F.col("geom_id")
    sharer = lambda i, c, r: F.struct(i.cast("int").alias("plate_id"), c.alias("clockwise"), r.alias("reversed"))
    return arcs(spark, sf_dir).select(
        (k % 3).cast("double").alias("time"), k.alias("section_id"), F.when(k % 2 == 0, "Left").otherwise("Right").alias("polarity"), ((k % 6 + 1) * 100).cast("int").alias("plate_id"),
        (k % 5 == 0).alias("is_topological_line"), "a", "b", F.array(sharer(F.lit(100), F.lit(True), F.lit(True)), sharer(F.lit(200) + 100 * (k % 4), F.lit(True), F.lit(False))).alias("sharing"),
    )


def _convergence_sql() -> str:
    a, b, m, n, v, u = (S.named(c) for c in ("a", "e", "m", "n", "v", "u"))
    relative = S.times(S.turn("s."), S.inverse(S.turn("o.")))
    clockwise = S.cross(n, m)
    oblique = lambda w: f"CASE WHEN {S.norm(w)} = 0 THEN 0 ELSE degrees({S.angle(w, n)}) * CASE WHEN {S.dot(w, clockwise)} < 0 THEN -1 ELSE 1 END END"
    length = S.norm(S.cross(m, ("0", "0", "1")))
    east = S.scaled(("(-my)", "mx", "0"), f"1 / {length}")
    north = S.cross(m, east)
    return f"""{_anchored_sql(4)}, {ARCS},
 sec AS (SELECT geom_id, (geom_id % 3)::DOUBLE AS t, geom_id % 2 = 0 AS on_left, CASE WHEN geom_id % 2 = 0 THEN 100 ELSE 200 + 100 * (geom_id % 4) END AS over_id, CASE WHEN geom_id % 2 = 0 THEN 200 + 100 * (geom_id % 4) ELSE 100 END AS sub_id,
  (geom_id % 6 + 1) * 100 AS own_id, ax, ay, az, ex, ey, ez, len, greatest(1, ceil(len / 0.02))::INT AS pieces FROM arcs WHERE len > 0),
 mid AS (SELECT *, CASE WHEN geom_id % 5 = 0 THEN over_id ELSE own_id END AS line_id, {S.as_(S.part_of_arc(a, b, "len", "((piece + 0.5) / pieces)"), "m")}, {S.as_(S.scaled(S.cross(a, b), f"CASE WHEN on_left THEN 1 ELSE -1 END / {S.norm(S.cross(a, b))}"), "n")}
  FROM (SELECT *, unnest(range(0, pieces)) AS piece FROM sec)),
 rel AS (SELECT mid.*, {S.as_(relative, "c")}, {S.as_(S.turn("l."), "l")} FROM mid JOIN stg s ON s.plate = sub_id AND s.t = mid.t JOIN stg o ON o.plate = over_id AND o.t = mid.t JOIN stg l ON l.plate = line_id AND l.t = mid.t),
 vel AS (SELECT *, {S.as_(S.velocity(S.turn("c"), m, "1.0", R), "v")}, {S.as_(S.velocity(S.turn("l"), m, "1.0", R), "u")} FROM rel),
 obl AS (SELECT *, {S.norm(v)} AS cs, {oblique(v)} AS co, {S.norm(u)} AS us, {oblique(u)} AS uo FROM vel),
 conv AS (SELECT t AS time, {S.lon_of(m)} AS lon, {S.lat_of(m)} AS lat, CASE WHEN abs(co) > 90 THEN -cs ELSE cs END AS conv_cm_yr, co AS conv_obliq_deg, CASE WHEN abs(uo) < 90 THEN -us ELSE us END AS abs_cm_yr, uo AS abs_obliq_deg,
  degrees(len / pieces) AS arc_len_deg, (degrees(atan2({S.dot(n, east)}, {S.dot(n, north)})) + 360) % 360 AS normal_azimuth_deg, sub_id::INT AS subducting_plate, over_id::INT AS overriding_plate FROM obl)"""


_TEN = ["lon", "lat", "conv_cm_yr", "conv_obliq_deg", "abs_cm_yr", "abs_obliq_deg", "arc_len_deg"]


@query(f"WITH {_convergence_sql()} SELECT time, {', '.join(f'round({c}, 6) AS {c}' for c in _TEN)}, round(normal_azimuth_deg, 6) % 360 AS normal_azimuth_deg, subducting_plate, overriding_plate FROM conv")
def trench_convergence(spark, sf_dir):
    out = kinematics.convergence(sections(spark, sf_dir), anchored(spark, sf_dir, 4.0), 0.02)
    return rounded(out, *_TEN).withColumn("normal_azimuth_deg", six("normal_azimuth_deg") % 360)


def thickness(spark, sf_dir) -> DataFrame:
    """A raster of suppliers a time, each time with other values."""
    nodes = suppliers(spark, sf_dir).withColumn("time", F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))))
    return nodes.withColumn("z", F.col("z") / 10 + 300 * (F.col("time") + 1))


_VOLUME = f"""{_convergence_sql()}, {SUPPLIERS}, r AS (SELECT node_id, s.lon AS rlon, s.lat AS rlat, t::DOUBLE AS rt, s.z / 10 + 300 * (t + 1) AS z FROM s, range(0, 3) k(t)),
 near AS (SELECT conv.*, z, row_number() OVER (PARTITION BY time, lon, lat, subducting_plate, overriding_plate ORDER BY {haversine('lon', 'lat', 'rlon', 'rlat')}, node_id) AS n
  FROM conv JOIN r ON rt = time AND {haversine('lon', 'lat', 'rlon', 'rlat')} <= radians(20)),
 w AS (SELECT *, radians(arc_len_deg) * 1000 * {R} AS len_m, 0.01 * abs(conv_cm_yr) * cos(radians(conv_obliq_deg)) AS nv FROM near WHERE n = 1)"""


@query(f"""WITH {_VOLUME} SELECT time, round(sum(len_m * z) / sum(len_m), 6) AS mean_thickness, round(sqrt(greatest(0.0, sum(len_m * z * z) / sum(len_m) - (sum(len_m * z) / sum(len_m)) ** 2)), 4) AS std_thickness,
 round(sum(len_m) / 1e6, 6) AS length_mm, round(sum(nv * z * len_m) / 1e9, 6) AS volume_km3_yr, round(sum(nv * z * len_m) / sum(len_m), 6) AS volume_per_m FROM w GROUP BY time""")
def subducting_volume(spark, sf_dir):
    out = kinematics.subducted_sediment(kinematics.convergence(sections(spark, sf_dir), anchored(spark, sf_dir, 4.0), 0.02), thickness(spark, sf_dir))
    return out.select("time", six("mean_thickness").alias("mean_thickness"), F.round("std_thickness", 4).alias("std_thickness"), six(F.col("length_m") / 1e6).alias("length_mm"), six(F.col("volume_m3_yr") / 1e9).alias("volume_km3_yr"), six("volume_per_m").alias("volume_per_m"))


@query(f"WITH {_VOLUME} SELECT time, round(lon, 6) AS lon, round(lat, 6) AS lat, round(z, 6) AS thickness, round(nv * z, 6) AS volume_m2_yr, round(nv * 100, 6) AS normal_cm_yr FROM w")
def thickness_at_trenches(spark, sf_dir):
    out = kinematics.thickness_at_arcs(kinematics.convergence(sections(spark, sf_dir), anchored(spark, sf_dir, 4.0), 0.02), thickness(spark, sf_dir))
    return rounded(out.select("time", "lon", "lat", "thickness", "volume_m2_yr", "normal_cm_yr"), "lon", "lat", "thickness", "volume_m2_yr", "normal_cm_yr")


# Distances to margins: the suppliers' arcs on moving plates, some of which exist for part of the time.


def margins(spark, sf_dir) -> DataFrame:
    k = F.col("geom_id")
    return arcs(spark, sf_dir).select("geom_id", "a", "b", ((k % 25 + 1) * 100).cast("int").alias("plate"), F.when(k % 4 == 0, 7.0).alias("begin_time"), F.when(k % 5 == 0, 2.0).alias("end_time"), F.when(k % 3 == 0, "Fault").otherwise("PassiveContinentalBoundary").alias("feature_type"))


_MAR = f"""mar AS (SELECT geom_id, rot.t, {S.as_(S.turned(S.turn("rot."), S.named("arcs.a")), "a")}, {S.as_(S.turned(S.turn("rot."), S.named("arcs.e")), "e")}
  FROM arcs JOIN rot ON rot.plate = (geom_id % 25 + 1) * 100 WHERE len > 0 AND geom_id % 3 <> 0 AND (geom_id % 4 <> 0 OR rot.t <= 7) AND (geom_id % 5 <> 0 OR rot.t >= 2))"""
_MARGINS = f"{_anchored_sql(10)}, {ARCS}, {_MAR}"


@query(f"""WITH {_MARGINS}, {CUSTOMERS},
 pts AS (SELECT query_id AS point_id, rot.t, {S.as_(S.turned(S.turn("rot."), S.from_lon_lat("q.lon", "q.lat")), "p")} FROM q JOIN rot ON rot.plate = (query_id % 25 + 1) * 100 AND rot.t <= query_id % 12),
 d AS (SELECT point_id, pts.t, min({S.arc_distance(S.named("p"), S.named("a"), S.named("e"))}) AS d FROM pts JOIN mar USING (t) GROUP BY 1, 2)
 SELECT 0.0::DOUBLE AS paleo_time, point_id, count(*) AS n, round(least(avg(CASE WHEN d <= 0.5 THEN d ELSE pi() END * {R!r}), 3000.0), 6) AS mean_km, round(stddev_pop(CASE WHEN d <= 0.5 THEN d ELSE pi() END * {R!r}), 5) AS std_km FROM d GROUP BY 2""")
def ocean_proximity(spark, sf_dir):
    """Points and margins move with their plates; margins farther than half a radian count with half the circumference."""
    q = F.col("query_id")
    points = customers(spark, sf_dir).select(F.lit(0.0).alias("paleo_time"), q.alias("point_id"), (q % 12).cast("double").alias("birth_time"), ((q % 25 + 1) * 100).cast("int").alias("plate"), "lon", "lat")
    turns = anchored(spark, sf_dir, 10.0)
    there = kinematics.valid_at(kinematics.of_types(margins(spark, sf_dir), ["PassiveContinentalBoundary"]), list(range(11)))
    out = lifetime.proximity(points, lambda rows: kinematics.reconstructed(rows, turns), kinematics.reconstructed_lines(there, turns), 1, 10, 0.5, 3000.0)
    return out.select("paleo_time", "point_id", "n", six("mean_km").alias("mean_km"), F.round("std_km", 5).alias("std_km"))


_LINES = f"""{CUSTOMERS}, {ARCS}, k AS (SELECT *, {S.as_(S.from_lon_lat("lon", "lat"), "p")} FROM q), d AS (SELECT query_id, min({S.arc_distance(S.named("p"), S.named("a"), S.named("e"))}) AS d FROM k, arcs WHERE len > 0 GROUP BY 1)"""


@query(f"WITH {_LINES} SELECT query_id, round(d * {R!r}, 6) AS dist_km FROM d")
def line_distance(spark, sf_dir):
    return rounded(spatial_join.distance_to_lines(customers(spark, sf_dir), arcs(spark, sf_dir)), "dist_km")


@query(f"WITH {_LINES} SELECT query_id, round(CASE WHEN d <= 0.2 THEN d ELSE pi() END * {R!r}, 6) AS dist_km FROM d")
def line_distance_threshold(spark, sf_dir):
    return rounded(spatial_join.distance_to_lines(customers(spark, sf_dir), arcs(spark, sf_dir), 0.2), "dist_km")


# Rasters along lines: at the middle of each piece the nearest supplier, smoothed.


def _along_sql(pieces: str, keys: str) -> str:
    """Rows of ``pieces`` (keys, piece, lon, lat, weight) with z."""
    d = haversine("p.lon", "p.lat", "s.lon", "s.lat")
    between = haversine("a.lon", "a.lat", "c.lon", "c.lat")
    return f"""{pieces}, {SUPPLIERS}, b AS (SELECT p.*, node_id, row_number() OVER (PARTITION BY {keys}, piece ORDER BY {d}, node_id) AS n FROM pieces p JOIN s ON {d} <= radians(20)),
 m AS (SELECT node_id, sum(z * w) / sum(w) AS z FROM (SELECT a.node_id, c.z, radians(10) ** 2 / (radians(10) ** 2 + 9 * {between} ** 2) AS w FROM s a JOIN s c ON {between} <= radians(10)) GROUP BY 1),
 f AS (SELECT {keys}, piece, round(p.lon, 6) AS lon, round(p.lat, 6) AS lat, round(coalesce(m.z, 'NaN'::DOUBLE), 6) AS z, round(p.weight, 6) AS weight FROM pieces p LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING ({keys}, piece) LEFT JOIN m ON m.node_id = b.node_id)"""


def _pieces_sql(source: str, keys: str) -> str:
    mid = S.part_of_arc(S.named("a"), S.named("e"), "len", "((piece + 0.5) / n)")
    return f"""cut AS (SELECT *, unnest(range(0, n)) AS piece FROM (SELECT *, greatest(1, ceil(len / 0.02))::INT AS n FROM {source} WHERE len > 0)),
 xyz AS (SELECT {keys}, piece::INT AS piece, len / n AS weight, {S.as_(mid, "m")} FROM cut), pieces AS (SELECT {keys}, piece, weight, {S.lon_of(S.named("m"))} AS lon, {S.lat_of(S.named("m"))} AS lat FROM xyz)"""


_SIX = ["lon", "lat", "z", "weight"]


@query(f"WITH {ARCS}, {_along_sql(_pieces_sql('arcs', 'geom_id'), 'geom_id')} SELECT * FROM f")
def raster_along_lines(spark, sf_dir):
    return rounded(spatial_join.query_lines(arcs(spark, sf_dir), suppliers(spark, sf_dir), 0.02, math.radians(20), math.radians(10)), *_SIX)


@query(f"WITH {_MARGINS}, lines AS (SELECT *, {S.angle(S.named('a'), S.named('e'))} AS len FROM mar WHERE t IN (3, 8)), {_along_sql(_pieces_sql('lines', 'geom_id, t'), 'geom_id, t')} SELECT * FROM f")
def raster_along_moved_lines(spark, sf_dir):
    there = kinematics.valid_at(margins(spark, sf_dir), [3.0, 8.0])
    out = kinematics.query_features(there, anchored(spark, sf_dir, 10.0), suppliers(spark, sf_dir), ["PassiveContinentalBoundary"], 0.02, math.radians(20), math.radians(10))
    return rounded(out, *_SIX)


@query(f"WITH {ARCS}, lines AS (SELECT *, (geom_id % 3)::DOUBLE AS time FROM arcs WHERE geom_id % 4 = 1), {_along_sql(_pieces_sql('lines', 'geom_id, time'), 'geom_id, time')} SELECT * FROM f")
def raster_along_sections(spark, sf_dir):
    k = F.col("geom_id")
    resolved = arcs(spark, sf_dir).select("geom_id", (k % 3).cast("double").alias("time"), F.when(k % 4 == 1, "SubductionZone").otherwise("MidOceanRidge").alias("feature_type"), "a", "b")
    return rounded(kinematics.query_sections(resolved, suppliers(spark, sf_dir), ["SubductionZone"], 0.02, math.radians(20), math.radians(10)), *_SIX)

