"""Shortest paths over a pixel graph of the sphere around obstacles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sphere
from ..storage import stored
from . import polygons
from .grid import pixel_nodes, pixel_vector
from .spatial_join import nearest_candidates, sphere_pairs, tessellated
from .stats import near_best

#: Steps (rows up, columns right) to the eight neighbours and the eight a knight's move away.
STEPS = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i or j) and max(abs(i), abs(j)) < 2 or {abs(i), abs(j)} == {1, 2}]


def neighbour_edges(spark: SparkSession, depth: int) -> DataFrame:
    """Edges (src, dst, dist_rad) between pixel centres: sixteen neighbours, around the date line but not over a pole."""
    return _edges(spark, depth).select("src", "dst", "dist_rad")


def _edges(spark: SparkSession, depth: int) -> DataFrame:
    """Edges with the number of their step."""
    n_lon, n_lat = 4 << depth, 2 << depth
    nodes = pixel_nodes(spark, depth)
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(i).alias("di"), F.lit(j).alias("dj")) for k, (i, j) in enumerate(STEPS))))
    to = nodes.select("node_id", "lon", "lat", "i_lon", "i_lat", steps.alias("s")).select("node_id", "lon", "lat", F.col("s.step").alias("step"), (F.col("i_lat") + F.col("s.di")).alias("r"), F.pmod(F.col("i_lon") + F.col("s.dj"), F.lit(n_lon)).alias("c"))
    size = 90.0 / (1 << depth)
    there = to.where(F.col("r").between(0, n_lat - 1))
    dist = sphere.great_circle(F.col("lon"), F.col("lat"), -180.0 + (F.col("c") + 0.5) * size, -90.0 + (F.col("r") + 0.5) * size)
    return there.select(F.col("node_id").alias("src"), (F.col("r") * n_lon + F.col("c")).cast("int").alias("dst"), dist.alias("dist_rad"), "step")


def surrounding_nodes(points: DataFrame, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (query_id, *by, node_id, dist): the four pixel centres around each point, two next to a pole. Columns ``by``, such as
    a time, tell apart the places of a point."""
    n_lon, n_lat, size = 4 << depth, 2 << depth, 90.0 / (1 << depth)
    r, c = F.floor(0.5 + (F.col("lat") + 90.0) / size).cast("int"), F.floor(0.5 + (F.col("lon") + 180.0) / size).cast("int")
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0) for j in (-1, 0))))
    rows = points.select("query_id", *by, "lon", "lat", r.alias("r"), c.alias("c"), corners.alias("k"))
    rows = rows.withColumns({"row": F.col("r") + F.col("k.di"), "col": F.pmod(F.col("c") + F.col("k.dj"), F.lit(n_lon))}).where(F.col("row").between(0, n_lat - 1))
    dist = sphere.great_circle(F.col("lon"), F.col("lat"), -180.0 + (F.col("col") + 0.5) * size, -90.0 + (F.col("row") + 0.5) * size)
    return rows.select("query_id", *by, (F.col("row") * n_lon + F.col("col")).alias("node_id"), dist.alias("dist"))


def closed_nodes(shapes: DataFrame, depth: int) -> DataFrame:
    """Rows (time, node_id) of the pixel centres inside polygons (shape, time, xyz) of any size, the smaller side of each ring."""
    return polygons.pixels_inside(shapes.select("shape", "time", "xyz"), depth, ("shape", "time")).select("time", F.col("cell").alias("node_id")).distinct()


def _segments(shapes: DataFrame) -> DataFrame:
    """Arcs (shape, time, a, b) of lines and rings (kind, xyz); a point is an arc without length."""
    ring = F.when(F.col("kind") == "polygon", F.concat("xyz", F.slice("xyz", 1, 1))).otherwise(F.col("xyz"))
    pair = lambda v, i: F.struct(v.alias("a"), F.get(F.col("ring"), i + 1).alias("b"))
    arcs = F.when(F.col("kind") == "point", F.transform("ring", lambda v: F.struct(v.alias("a"), v.alias("b")))).otherwise(F.filter(F.transform("ring", pair), lambda s: s["b"].isNotNull()))
    return shapes.withColumn("ring", ring).select("shape", "time", F.explode(arcs).alias("s")).select("shape", "time", "s.a", "s.b")


def blocked_edges(edges: DataFrame, obstacles: DataFrame, depth: int) -> DataFrame:
    """Rows (time, src, dst, step) of edges (src, dst, step) that cross an arc (time, a, b), found by the middles of edges and of
    pieces of the arcs no longer than a pixel."""
    size = math.radians(90.0 / (1 << depth))
    ends = sphere.evaluated(edges.select("src", "dst", "step"), p=pixel_vector(F.col("src"), depth), q=pixel_vector(F.col("dst"), depth))
    ends = sphere.evaluated(ends, m=sphere.plus(F.col("p"), F.col("q"))).withColumns({"lon": sphere.lon_of(F.col("m")), "lat": sphere.lat_of(F.col("m"))})
    pieces = tessellated(obstacles, size).select("time", "a", "b", sphere.lon_of(F.col("mid")).alias("lon2"), sphere.lat_of(F.col("mid")).alias("lat2"))
    pairs = sphere_pairs(ends, pieces, 1.01 * size * (math.sqrt(5) + 1) / 2)
    p, q, a, b = (F.col(c) for c in "pqab")
    n, m = sphere.cross(p, q), sphere.cross(a, b)
    across = (sphere.dot(p, m) * sphere.dot(q, m) < 0) & (sphere.dot(a, n) * sphere.dot(b, n) < 0) & (sphere.dot(F.col("m"), sphere.plus(a, b)) > 0)
    return pairs.where(across).select("time", "src", "dst", "step").distinct()


def seeds(nodes: DataFrame, sources: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Rows (time, node_id, d): of each source (shape, time, a, b), the nodes (time, node_id) no more than 0.7 of a pixel
    farther from it than the nearest one and within ``threshold``. Nodes near the source are found by cells; a source with none
    near, so one deep inside an obstacle, by a tree of caps."""
    size = math.radians(90.0 / (1 << depth))
    cut = tessellated(sources, size).select("shape", "time", F.col("pa").alias("a"), F.col("pb").alias("b"), "mid", (F.col("arc_len") / 2).alias("own"))
    points = sources.where(sphere.angle(F.col("a"), F.col("b")) == 0).withColumns({"mid": F.col("a"), "own": F.lit(0.0)})
    pieces = cut.unionByName(points).withColumns({"lon2": sphere.lon_of(F.col("mid")), "lat2": sphere.lat_of(F.col("mid"))})
    at = sphere.evaluated(nodes.select("time", "node_id"), p=pixel_vector(F.col("node_id"), depth))
    at = at.withColumns({"lon": sphere.lon_of(F.col("p")), "lat": sphere.lat_of(F.col("p"))})
    point = sphere.angle(F.col("a"), F.col("b")) == 0
    d = F.when(point, sphere.angle(F.col("p"), F.col("a"))).otherwise(sphere.arc_distance(F.col("p"), F.col("a"), F.col("b")))
    reach = 3 * size
    pairs = sphere_pairs(at, pieces, min(math.pi, reach + size / 2), ("time",)).groupBy("shape", "time", "node_id").agg(F.min(d).alias("d"))
    near = near_best(pairs, "shape", "d", 0.7 * size).withColumn("best", F.min("d").over(Window.partitionBy("shape"))).where(F.col("best") + 0.7 * size <= reach)
    near = stored(near.select("shape", "time", "node_id", "d"), "seeds")
    left = stored(pieces.join(near.select("shape").distinct(), "shape", "left_anti").withColumn("piece", F.monotonically_increasing_id()), "source-pieces")
    if left.limit(1).count():
        items = at.select("time", "node_id", F.col("p").alias("c"), F.lit(0.0).alias("r"))
        asked = left.select("shape", "piece", "time", F.col("mid").alias("p"), "own")
        far = nearest_candidates(asked, items, ("shape", "piece"), ("time",), 0.7 * size).drop("p").join(left.select("piece", "a", "b"), "piece").withColumnRenamed("c", "p")
        near = near.unionByName(near_best(far.groupBy("shape", "time", "node_id").agg(F.min(d).alias("d")), "shape", "d", 0.7 * size))
    return near.where(F.col("d") <= threshold).groupBy("time", F.col("node_id").cast("int").alias("node_id")).agg(F.min("d").alias("d"))


#: Steps along edges between two written tables, and the width of a band of distances in pixels.
HOPS, BAND = 5, 16.0


def barred_steps(closed: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows (time, node_id, bars): for nodes that some step may not reach, a bit for each such step; closed nodes have all."""
    every = closed.select("time", "node_id", F.lit((1 << len(STEPS)) - 1).alias("bars"))
    some = blocked.select("time", F.col("dst").alias("node_id"), F.expr("shiftleft(1, step)").alias("bars"))
    return every.unionByName(some).groupBy("time", "node_id").agg(F.bit_or("bars").alias("bars"))


def relaxed(start: DataFrame, barred: DataFrame, depth: int, threshold: float, most: int = 100_000) -> DataFrame:
    """Rows (time, node_id, d): least distances from ``start`` (time, node_id, d) over the pixel graph less ``barred`` steps
    (time, node_id, bars), within ``threshold``.

    Delta stepping: of each time only the nodes in the lowest band of distances that got nearer are
    expanded, in hops of one aggregation; after every few hops the table is written, and nodes too far below the
    band for any step to come back to them leave it. A step's target follows from the node's number and its length from the
    row of pixels, so no table of edges is read or shuffled; only barred steps are looked up. Times
    whose distances are settled leave on their own.
    """
    size, lengths = math.radians(90.0 / (1 << depth)), _steps(depth)
    longest = max(x[3] for s in lengths for x in s)
    steps = F.broadcast(start.sparkSession.createDataFrame(list(enumerate(lengths)), "row int, steps array<struct<k: int, di: int, dj: int, dist: double>>"))  # one row a row of pixels
    bars = stored(barred, "barred").withColumnsRenamed({"time": "_time", "node_id": "_node"})
    now, settled = stored(start.selectExpr("time", "node_id", "d", "true AS fresh"), "reached"), []
    for _ in range(most):
        floors = {r["time"]: r["low"] for r in now.where("fresh").groupBy("time").agg(F.min("d").alias("low")).collect()}  # a row a time
        if not floors:
            return _all([*settled, now]).select("time", "node_id", "d")
        now = now.withColumn("low", F.element_at(F.create_map(*(F.lit(x) for t in floors.items() for x in t)), F.col("time")))
        gone = F.col("low").isNull() | (F.col("d") < F.col("low") - longest) & ~F.col("fresh")
        settled.append(now.where(gone))
        now = stored(_hops(now.where(~gone), steps, bars, depth, threshold, BAND * size), "reached")
    raise RuntimeError("distances did not settle")


def _hops(now: DataFrame, steps: DataFrame, bars: DataFrame, depth: int, threshold: float, band: float) -> DataFrame:
    """Hops of one look-up of lengths by row of pixels, one of barred steps and one aggregation each."""
    n_lon = 4 << depth
    own = "named_struct('node_id', node_id, 'k', -1, 'old', d, 'new', CAST(NULL AS DOUBLE), 'waits', fresh AND NOT goes)"
    to = f"named_struct('node_id', CAST((row + s.di) * {n_lon} + pmod(node_id % {n_lon} + s.dj, {n_lon}) AS INT), 'k', s.k, 'old', CAST(NULL AS DOUBLE), 'new', d + s.dist, 'waits', false)"
    sent = f"explode(CASE WHEN goes THEN concat(array({own}), filter(transform(steps, s -> {to}), t -> t.new <= {threshold!r}D)) ELSE array({own}) END) AS n"
    row, goes = F.expr(f"CAST(node_id div {n_lon} AS INT) AS row"), F.expr(f"fresh AND d < low + {band!r}D AS goes")
    least = [F.expr(x) for x in ("first(low) AS low", "min(n.old) AS old", "min(n.new) AS new", "max(n.waits) AS waits")]
    for _ in range(HOPS):
        open_ = now.select("*", row, goes).join(steps, "row").selectExpr("time", "low", sent)
        free = open_.join(bars, F.expr("time = _time AND n.node_id = _node"), "left").where("n.k < 0 OR bars IS NULL OR (shiftright(bars, n.k) & 1) = 0")
        now = free.groupBy("time", "n.node_id").agg(*least).selectExpr("time", "node_id", "least(old, new) AS d", "new IS NOT NULL AND (old IS NULL OR new < old) OR waits AS fresh", "low")
    return now.drop("low")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].select("time", "node_id", "d")
    for t in tables[1:]:
        out = out.unionByName(t.select("time", "node_id", "d"))
    return out


def _steps(depth: int) -> list[list[tuple[int, int, int, float]]]:
    """For each row of pixels the steps (number, rows up, columns right, length) that stay on the grid."""
    n_lat, size = 2 << depth, 90.0 / (1 << depth)
    lat = [math.radians(-90.0 + (r + 0.5) * size) for r in range(n_lat)]

    def length(r: int, i: int, j: int) -> float:
        h = math.sin((lat[r + i] - lat[r]) / 2) ** 2 + math.cos(lat[r]) * math.cos(lat[r + i]) * math.sin(math.radians(j * size) / 2) ** 2
        return 2 * math.asin(min(1.0, math.sqrt(h)))

    return [[(k, i, j, length(r, i, j)) for k, (i, j) in enumerate(STEPS) if 0 <= r + i < n_lat] for r in range(n_lat)]


def node_distances(geometries: DataFrame, depth: int, threshold: float = math.pi) -> DataFrame:
    """Rows (time, node_id, outside, dist_rad) for each time of ``geometries`` (time, role, kind, xyz).

    Role ``source`` has the points, lines and outlines that distances start from; role ``obstacle``
    polygons of any size, whose insides are closed, and polylines. A node that can't be reached within
    ``threshold`` has null. All times are one plan: closed nodes and blocked edges, then least distances in rounds.
    """
    alike = geometries.select("time", "role", "kind", "xyz").dropDuplicates()
    shapes = stored(alike.withColumn("shape", F.monotonically_increasing_id()), "shapes")
    obstacles = shapes.where("role = 'obstacle'")
    n = (4 << depth) * (2 << depth)
    nodes = shapes.select("time").distinct().select("time", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("node_id"))
    closed = stored(closed_nodes(obstacles.where("kind = 'polygon'"), depth), "closed")
    nodes = stored(nodes.join(closed.withColumn("outside", F.lit(False)), ["time", "node_id"], "left").withColumn("outside", F.coalesce("outside", F.lit(True))), "nodes")
    blocked = blocked_edges(_edges(geometries.sparkSession, depth), _segments(obstacles.where("kind <> 'point'")), depth)
    start = seeds(nodes.where("outside").select("time", "node_id"), _segments(shapes.where("role = 'source'")), depth, threshold)
    reached = relaxed(start, barred_steps(closed, blocked), depth, threshold)
    return nodes.join(reached.withColumnRenamed("d", "dist_rad"), ["time", "node_id"], "left")


def path_distances(points: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Rows (query_id, time, dist_rad): inverse-distance mean of the reached nodes around each point
    (query_id, time, lon, lat). If all of them lie in obstacles, the least of node distance plus way to
    the node over outside nodes near the closest one; null where there is no way."""
    size = math.radians(90.0 / (1 << depth))
    near = surrounding_nodes(points, depth, ("time",)).join(nodes, ["time", "node_id"], "left")
    w = F.when(F.col("dist") != 0, 1.0 / F.when(F.col("dist") != 0, F.col("dist")))
    reached = F.col("dist_rad").isNotNull()
    around = near.groupBy("query_id", "time").agg(
        F.coalesce(F.min(F.when(F.col("dist") == 0, F.col("dist_rad"))), F.sum(F.when(reached, w * F.col("dist_rad"))) / F.sum(F.when(reached, w))).alias("dist_rad"),
        F.max("outside").alias("any_outside"),
    )
    closed = stored(points.join(around.where(~F.col("any_outside")).select("query_id", "time"), ["query_id", "time"], "left_semi"), "points-in-obstacles")
    pixels = nodes.where("outside").select("time", "dist_rad", pixel_vector(F.col("node_id"), depth).alias("c"), F.lit(0.0).alias("r"))
    asked = closed.select("query_id", "time", sphere.from_lon_lat(F.col("lon"), F.col("lat")).alias("p"), F.lit(0.0).alias("own"))
    pairs = nearest_candidates(asked, pixels, by=("time",), slack=0.7 * size).withColumns({"dist": sphere.angle(F.col("p"), F.col("c")), "key": F.struct("query_id", "time")})
    wide = near_best(pairs, "key", "dist", 0.7 * size).groupBy("query_id", "time").agg(F.min(F.col("dist") + F.col("dist_rad")).alias("wide_rad"))
    return around.join(wide, ["query_id", "time"], "left").select("query_id", "time", F.when(F.col("any_outside"), F.col("dist_rad")).otherwise(F.col("wide_rad")).alias("dist_rad"))
