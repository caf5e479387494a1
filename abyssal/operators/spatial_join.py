"""Distance joins by cells: both sides are dealt to cells as wide as the radius, one side
to the neighbouring cells too, so that an equi-join finds all pairs and nothing is broadcast
or paired blindly."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.scalar import MEAN_RADIUS_KM
from ..storage import stored
from .grid import pixel_at, pixel_vector


def _celled(df: DataFrame, axes: list[Column], size: float, around: bool) -> DataFrame:
    names = [f"_c{i}" for i in range(len(axes))]
    df = df.withColumns({n: F.floor(a / size).cast("long") for n, a in zip(names, axes)})
    for n in names if around else ():
        df = df.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    return df


def planar_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs within ``radius`` in degrees (no wrap), of ``left`` (lon, lat) and ``right`` (lon2, lat2), with ``dist``."""
    a = _celled(left, [F.col("lon"), F.col("lat")], radius, False)
    b = _celled(right, [F.col("lon2"), F.col("lat2")], radius, True)
    dist = F.sqrt(F.pow(F.col("lon") - F.col("lon2"), 2) + F.pow(F.col("lat") - F.col("lat2"), 2))
    return a.join(b, ["_c0", "_c1"]).withColumn("dist", dist).where(F.col("dist") <= radius).drop("_c0", "_c1")


def _places(df: DataFrame, *columns: str) -> DataFrame:
    """Rows at a place; those without a number for it meet nothing."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in columns)))


def _within(radius: float) -> tuple[Column, Column]:
    """Whether rows (lon, lat, _v) and (lon2, lat2, _w) are within ``radius``, and how far apart. The chord between their unit vectors
    settles it but for a band of rounding, where the distance itself does."""
    chord, reach = sphere.plus(F.col("_v"), sphere.scaled(F.col("_w"), F.lit(-1.0))), (2 * math.sin(min(radius, math.pi) / 2)) ** 2
    dist, square = sphere.great_circle(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), sphere.dot(chord, chord)
    return (square <= reach * (1 + 1e-9) + 1e-15) & ((square <= reach * (1 - 1e-9) - 1e-15) | (dist <= radius)), dist


def sphere_pairs(left: DataFrame, right: DataFrame, radius: float, by: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """Pairs within ``radius`` radians, over poles and date line, with ``dist`` in radians; columns ``by`` must be equal too.

    With ``spread`` the cells are dealt to many tasks however small the sides are: pairs of wide radii outnumber them.
    """
    chord = max(1e-9, 2 * math.sin(min(radius, math.pi) / 2)) * (1 + 1e-12)
    axes = lambda v: [F.col(v)[c] for c in "xyz"]
    a = _celled(sphere.evaluated(_places(left, "lon", "lat"), _v=sphere.from_lon_lat(F.col("lon"), F.col("lat"))), axes("_v"), chord, False)
    b = _celled(sphere.evaluated(_places(right, "lon2", "lat2"), _w=sphere.from_lon_lat(F.col("lon2"), F.col("lat2"))), axes("_w"), chord, True)
    cell = [*by, "_c0", "_c1", "_c2"]
    if spread:
        a, b = (df.repartition(_tasks(df), *cell) for df in (a, b))
    near, dist = _within(radius)
    return a.join(b, cell).where(near).withColumn("dist", dist).drop("_c0", "_c1", "_c2", "_v", "_w")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


#: Depths of the pixels that caps are kept for, from the coarsest on.
LEVELS = (1, 3, 5, 7, 9, 11, 13)
#: Items a pixel of the last depth that a search goes to, on average over those that hold any.
PIXEL_ITEMS = 2


#: What the angles of ``_apart`` may be off by, with room to spare.
ROUNDING = 1e-7


def _apart(a: Column, b: Column) -> Column:
    """Angle between unit vectors by their chord: few terms, and to 2e-8 even where they are opposite."""
    return 2 * F.asin(F.least(F.lit(1.0), sphere.norm(sphere.plus(a, sphere.scaled(b, F.lit(-1.0)))) / 2))


def _caps(items: DataFrame, by: tuple[str, ...], levels: tuple[int, ...] = LEVELS, size: Column | None = None) -> DataFrame:
    """Rows (*by, level, cell, reach, n, m): the angle around a pixel's centre m that holds all items whose middle lies in it, and their sum of ``size`` (1)."""
    at = sphere.evaluated(items.select(*by, "c", "r", (F.lit(1) if size is None else size).alias("n")), _lon=sphere.lon_of(F.col("c")), _lat=sphere.lat_of(F.col("c")))
    rows = at.withColumn("level", F.explode(F.array(*(F.lit(d) for d in levels))))
    high = 2 * F.pow(F.lit(2.0), F.col("level"))
    row = F.least(high - 1, F.greatest(F.lit(0.0), F.floor((F.col("_lat") + 90.0) / (180.0 / high))))
    rows = sphere.evaluated(rows, cell=(row * 2 * high + F.pmod(F.floor((F.col("_lon") + 180.0) / (180.0 / high)), 2 * high)).cast("int"))
    middle = sphere.from_lon_lat(-180.0 + (F.col("cell") % (2 * high) + 0.5) * (180.0 / high), -90.0 + (F.floor(F.col("cell") / (2 * high)) + 0.5) * (180.0 / high))
    caps = sphere.evaluated(rows, m=middle).groupBy(*by, "level", "cell").agg(F.max(_apart(F.col("m"), F.col("c")) + F.col("r")).alias("reach"), F.sum("n").alias("n"))
    return sphere.evaluated(caps, m=middle)


def _inner(cell: Column, at: int, level: int, k: str = "k") -> Column:
    """The pixel of depth ``level`` at place ``k`` (i, j) within a pixel of depth ``at``."""
    more, wide = 1 << (level - at), 4 << at
    row, col = F.floor(cell / wide) * more + F.col(f"{k}.i"), (cell % wide) * more + F.col(f"{k}.j")
    return (row * (wide * more) + col).cast("int")


def _steps(at: int, level: int) -> Column:
    more = range(1 << (level - at))
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in more for j in more)))


def _grouped(queries: DataFrame, items: DataFrame, by: tuple[str, ...], slack: float) -> tuple[DataFrame, DataFrame]:
    """Queries with the pixel ``_g`` that they lie in, and rows (*by, _g, items' columns but by): what the queries of a pixel may need.

    Bounding caps of the items by pixel, in levels: at each level a pixel of queries keeps the pixels whose least distance does not
    exceed the smallest of their greatest distances plus ``slack``, and goes on to the pixels within them. So
    no query meets all items, and queries far from every item meet few. The last level follows the number of items,
    so that a query meets no more of them in larger tables.
    """
    caps = stored(_caps(items, by), "caps")
    sizes = {r["level"]: r["n"] / r["caps"] for r in caps.groupBy("level").agg(F.sum("n").alias("n"), F.count("*").alias("caps")).collect()}
    levels = LEVELS[: next((i for i, d in enumerate(LEVELS) if sizes.get(d, 0) <= PIXEL_ITEMS), len(LEVELS) - 1) + 1]
    tasks = _tasks(queries)
    queries = sphere.evaluated(queries, _g=pixel_at(F.col("p"), levels[-1])).repartition(tasks, *by, "_g")
    centre = pixel_vector(F.col("_g"), levels[-1])
    each = sphere.evaluated(queries, _p=centre).groupBy(*by, "_g").agg(F.max(_apart(F.col("p"), F.col("_p")) + F.col("own")).alias("own"))
    each = sphere.evaluated(each, _p=centre)
    n, at = (4 << LEVELS[0]) * (2 << LEVELS[0]), None
    now = each.select(*by, "_g", "_p", "own", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cell"))
    for level in levels:
        if at is not None:
            now = now.withColumn("k", _steps(at, level)).withColumn("cell", _inner(F.col("cell"), at, level)).drop("k")
        hit = now.join(caps.where(F.col("level") == level).drop("level", "n"), [*by, "cell"])
        hit = sphere.evaluated(hit, d=_apart(F.col("_p"), F.col("m")), span=F.col("reach") + F.col("own"))
        met = hit.groupBy(*by, "_g").agg(F.first("_p").alias("_p"), F.first("own").alias("own"), F.min(F.col("d") + F.col("span")).alias("best"), F.collect_list(F.struct("cell", (F.col("d") - F.col("span")).alias("least"))).alias("cells"))
        kept = F.filter("cells", lambda c: c["least"] <= F.col("best") + slack + 4 * ROUNDING)
        now, at = met.select(*by, "_g", "_p", "own", F.explode(kept).alias("k")).select(*by, "_g", "_p", "own", "k.cell"), level
    now, ours = now.select(*by, "_g", "cell").repartition(tasks, *by, "cell"), items.withColumn("cell", pixel_at(F.col("c"), at))
    return queries, now.join(ours, [*by, "cell"]).drop("cell").repartition(tasks, *by, "_g")


def nearest_candidates(queries: DataFrame, items: DataFrame, key: tuple[str, ...] = ("query_id",), by: tuple[str, ...] = (), slack: float = 0.0) -> DataFrame:
    """Pairs of ``queries`` (*key, *by, vector p, its extent own in radians) with all of ``items`` (*by, middle c, extent r, others) that
    may be no farther than the query's nearest one plus ``slack``, however far that is (see ``_grouped``)."""
    queries, found = _grouped(queries.select(*key, *by, "p", "own"), items, by, slack)
    return queries.drop("own").join(found, [*by, "_g"]).drop("_g")


def _near_nodes(queries: DataFrame, nodes: DataFrame, node: str, by: tuple[str, ...], slack: float) -> DataFrame:
    """Rows (*by, lon, lat, near): of each place of ``queries`` the array of (dist, node) from the nodes no farther than its nearest one plus ``slack``, and maybe others.

    Equal places are asked once. A pixel's candidates are one array, so that no pair is shuffled or sorted.
    """
    asked = sphere.evaluated(_places(queries.select(*by, "lon", "lat"), "lon", "lat").distinct(), p=sphere.from_lon_lat(F.col("lon"), F.col("lat"))).withColumn("own", F.lit(0.0))
    items = sphere.evaluated(_places(nodes.select(node, *by, "lon2", "lat2"), "lon2", "lat2"), c=sphere.from_lon_lat(F.col("lon2"), F.col("lat2"))).withColumn("r", F.lit(0.0))
    asked, found = _grouped(asked, items, by, slack)
    one = F.struct(F.col(node).alias("node"), "lon2", "lat2", F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.z").alias("z"))
    met = asked.join(found.groupBy(*by, "_g").agg(F.collect_list(one).alias("_items")), [*by, "_g"])
    square = lambda c: sum((F.col("p")[k] - c[k]) * (F.col("p")[k] - c[k]) for k in "xyz")
    met = sphere.evaluated(met, _all=F.transform("_items", lambda c: F.struct(square(c).alias("square"), c.alias("c")))).drop("_items")
    met = sphere.evaluated(met, _least=F.array_min(F.transform("_all", lambda c: c["square"])))
    # Chords and angles agree to far less than this; the haversine distance of the few that are left decides.
    reach = F.pow(2 * F.sin(F.least(F.lit(math.pi), 2 * F.asin(F.least(F.lit(1.0), F.sqrt("_least") / 2)) + slack) / 2), 2) * (1 + 1e-9) + 1e-15
    near = F.transform(F.filter("_all", lambda c: c["square"] <= F.col("_reach")), lambda c: F.struct(sphere.great_circle(F.col("lon"), F.col("lat"), c["c"]["lon2"], c["c"]["lat2"]).alias("dist"), c["c"]["node"].alias(node)))
    return sphere.evaluated(met, _reach=reach).select(*by, "lon", "lat", near.alias("near"))


def nearest(queries: DataFrame, nodes: DataFrame, radius: float = math.pi, key: str = "query_id", node: str = "node_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The node nearest to each query (of one key and one value of columns ``by``) within ``radius`` radians, ties to the smaller id; null where there is none."""
    places = nodes.groupBy(*by, "lon2", "lat2").agg(F.min(node).alias(node))
    near = sphere.evaluated(_near_nodes(queries, places, node, by, 0.0), b=F.array_min("near")).where(F.col("b.dist") <= radius)
    return queries.join(near.select(*by, "lon", "lat", F.col(f"b.{node}").alias(node), F.col("b.dist").alias("dist")), [*by, "lon", "lat"], "left").select(*queries.columns, node, "dist")


def nearest_anywhere(queries: DataFrame, nodes: DataFrame, key: str = "query_id", node: str = "node_id") -> DataFrame:
    """``nearest`` without a bound."""
    return nearest(queries, nodes, key=key, node=node)


def near_places(queries: DataFrame, nodes: DataFrame, radius: float, slack: float, node: str = "node_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, lon, lat, node, dist): of each distinct place of ``queries`` the nodes within ``radius`` and no farther than its nearest one plus ``slack``."""
    near = sphere.evaluated(_near_nodes(queries, nodes, node, by, slack), _best=F.array_min(F.transform("near", lambda c: c["dist"])))
    kept = F.filter("near", lambda c: (c["dist"] <= radius) & (c["dist"] <= F.col("_best") + slack))
    return near.select(*by, "lon", "lat", F.explode(kept).alias("k")).select(*by, "lon", "lat", f"k.{node}", "k.dist")


#: Depths at which ``counts_within`` compares pixels with pixels.
COUNT_LEVELS = (1, 3, 5)


def counts_within(queries: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """Rows (lon, lat, n_within): how many nodes (lon2, lat2) are within ``radius`` of each distinct place of ``queries``; places without any have no row.

    Pixels of queries meet pixels of nodes, from coarse to fine: pixels as a whole within reach add their count, those out of
    it go, and only places in pixels at the rim of the last depth are compared one by one.
    """
    last = COUNT_LEVELS[-1]
    asked = sphere.evaluated(_places(queries.select("lon", "lat"), "lon", "lat").distinct(), c=sphere.from_lon_lat(F.col("lon"), F.col("lat"))).withColumn("r", F.lit(0.0))
    given = _places(nodes.select("lon2", "lat2"), "lon2", "lat2").groupBy("lon2", "lat2").agg(F.count("*").alias("n"))
    given = stored(sphere.evaluated(given, c=sphere.from_lon_lat(F.col("lon2"), F.col("lat2"))).withColumn("r", F.lit(0.0)), "count-nodes")
    asked = stored(asked, "count-places")
    ours = stored(_caps(asked, (), COUNT_LEVELS), "count-caps").select("level", F.col("cell").alias("g"), F.col("reach").alias("own"), F.col("m").alias("gm"))
    caps = stored(_caps(given, (), COUNT_LEVELS, F.col("n")), "count-caps").select("level", "cell", "reach", "n", "m")
    at_level = lambda df, d: df.where(F.col("level") == d).drop("level")
    rim, at, whole = None, None, []
    for level in COUNT_LEVELS:
        if rim is None:
            now = at_level(ours, level).crossJoin(at_level(caps, level))
        else:
            for name, of in (("g", ours), ("cell", caps)):
                rim = rim.withColumn("k", _steps(at, level)).withColumn(name, _inner(F.col(name), at, level)).drop("k").repartition(_tasks(rim), name).join(at_level(of, level), name)
            now = rim
        now = sphere.evaluated(now, d=_apart(F.col("gm"), F.col("m")), span=F.col("own") + F.col("reach"))
        now = stored(now.where(F.col("d") - F.col("span") <= radius + 4 * ROUNDING).select("g", "cell", "n", (F.col("d") + F.col("span") <= radius - 4 * ROUNDING).alias("inside")), "count-pixels")
        whole.append(now.where("inside").groupBy("g").agg(F.sum("n").alias("n")))
        rim, at = now.where("not inside").select("g", "cell"), level
    places = sphere.evaluated(asked.select("lon", "lat", F.col("c").alias("_v")), **{f"g{d}": pixel_at(F.col("_v"), d) for d in COUNT_LEVELS})
    right = given.select("lon2", "lat2", "n", F.col("c").alias("_w"), pixel_at(F.col("c"), last).alias("cell"))
    tasks = _tasks(rim)
    left = places.select("lon", "lat", "_v", F.col(f"g{last}").alias("g")).repartition(tasks, "g").join(rim.repartition(tasks, "g"), "g")
    near, _ = _within(radius)
    parts = left.join(right, "cell").where(near).groupBy("lon", "lat").agg(F.sum("n").alias("n"))
    for d, inside in zip(COUNT_LEVELS, whole):
        parts = parts.unionByName(places.join(inside.withColumnRenamed("g", f"g{d}"), f"g{d}").select("lon", "lat", "n"))
    return parts.groupBy("lon", "lat").agg(F.sum("n").alias("n_within"))


def query_raster(queries: DataFrame, nodes: DataFrame, search_radius: float, smoothing_radius: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (query_id, *by, z): the nearest node's value within the radius, NaN if there is none. With
    ``smoothing_radius`` r (radians) the nodes within r of that node are averaged by r^2 / (r^2 + 9 d^2).
    Columns ``by``, such as the time of a raster, tell apart rasters whose nodes share ids, and queries of one id."""
    near = nearest(queries, nodes.select("node_id", *by, F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), search_radius, by=by)
    values = nodes.select("node_id", *by, F.col("z").alias("value"))
    if smoothing_radius is not None:
        near = stored(near, "nearest")
        hit = near.select("node_id", *by).where(F.col("node_id").isNotNull()).distinct()
        centres = nodes.join(hit, ["node_id", *by]).select("node_id", *by, "lon", "lat")
        places = nodes.groupBy(*by, F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).agg(F.sum("z").alias("z"), F.count("*").alias("n"))
        pairs = sphere_pairs(centres, places, smoothing_radius, by, spread=True)
        pairs = sphere.evaluated(pairs, w=smoothing_radius**2 / (smoothing_radius**2 + 9 * F.col("dist") * F.col("dist")))
        values = pairs.groupBy("node_id", *by).agg((F.sum(F.col("w") * F.col("z")) / F.sum(F.col("w") * F.col("n"))).alias("value"))
    return near.join(values, ["node_id", *by], "left").select("query_id", *by, F.coalesce("value", F.lit(float("nan"))).alias("z"))


def upscale_weights(coarse: DataFrame, fine: DataFrame, spacing: float) -> DataFrame:
    """Edges (fine_id, src_id, w): up to six coarse points (src_id, lon, lat) within 1.2 spacings in
    degrees of each fine point, the nearest ones, with weights that add up to 1. Fine points without any go."""
    r = 1.2 * spacing
    pairs = planar_pairs(fine.select("fine_id", "lon", "lat"), coarse.select("src_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), r)
    raw = (1.0001 * r - F.col("dist")) / (1 + 2 * F.col("dist") / r)
    order = Window.partitionBy("fine_id").orderBy("dist", "src_id")
    six = pairs.select("fine_id", "src_id", raw.alias("raw"), F.row_number().over(order).alias("n")).where("n <= 6")
    return six.select("fine_id", "src_id", (F.col("raw") / F.sum("raw").over(Window.partitionBy("fine_id"))).alias("w"))


def upscaled(weights: DataFrame, values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (fine_id, z): weighted sums of the coarse values (src_id, z), for each of columns ``by``, such as a time."""
    return weights.join(values.select("src_id", *by, "z"), "src_id").groupBy("fine_id", *by).agg(F.sum(F.col("z") * F.col("w")).alias("z"))


def by_sectors(targets: DataFrame, points: DataFrame, radius: float, sectors: int = 4, least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (node_id, z), for each of the points' columns ``by``: in each of ``sectors`` equal directions the point nearest to the target within
    ``radius`` degrees (planar), if ``least`` sectors have one, weighted by 1 / (1 + (3 d / radius)^2)."""
    pairs = planar_pairs(targets.select("node_id", "lon", "lat"), points.select("point_id", *by, F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "z"), radius)
    angle = F.degrees(F.atan2(F.col("lat2") - F.col("lat"), F.col("lon2") - F.col("lon")))
    sector = F.pmod(F.floor(F.pmod(angle + 360.0, F.lit(360.0)) / (360.0 / sectors)).cast("int"), F.lit(sectors))
    first = pairs.groupBy("node_id", *by, sector.alias("sector")).agg(F.min(F.struct("dist", "point_id", "z")).alias("p"))
    w = 1 / (1 + F.pow(3 * F.col("p.dist") / radius, 2))
    return first.groupBy("node_id", *by).agg((F.sum(w * F.col("p.z")) / F.sum(w)).alias("z"), F.count("*").alias("n")).where(F.col("n") >= least).select("node_id", *by, "z")


def distance_to_lines(points: DataFrame, segments: DataFrame, threshold: float | None = None, longest: float = 0.05, by: tuple[str, ...] = (), beyond: float | None = math.pi) -> DataFrame:
    """Rows (query_id, *by, dist_km): distance of points to the nearest arc of ``segments`` (a, b vectors), mean radius.

    Arcs are cut to at most ``longest`` radians and found through their middles by a tree of caps; equal arcs and equal places
    count once in the search; columns ``by``, such as a time, must be equal too, so that a point
    may be asked for at several times. Beyond ``threshold`` radians, or with nothing in reach, the
    distance counts as half the circumference, as in the calibration of the model, or as
    ``beyond`` radians; None gives null.
    """
    segments = segments.select(*by, "a", "b").distinct()
    pieces = tessellated(segments, longest).select(*by, "pa", "pb", F.col("mid").alias("c"), (F.col("arc_len") / 2).alias("r"))
    pieces = sphere.evaluated(sphere.evaluated(pieces, n=sphere.unit(sphere.cross(F.col("pa"), F.col("pb")))), na=sphere.cross(F.col("n"), F.col("pa")), nb=sphere.cross(F.col("pb"), F.col("n")))
    places = _places(points.select(*by, "lon", "lat"), "lon", "lat").distinct()
    asked = sphere.evaluated(places, p=sphere.from_lon_lat(F.col("lon"), F.col("lat"))).withColumn("own", F.lit(0.0))
    p, n = F.col("p"), F.col("n")
    beside = (sphere.dot(F.col("na"), p) >= 0) & (sphere.dot(F.col("nb"), p) >= 0)
    end = lambda v: 2 * F.asin(F.least(F.lit(1.0), sphere.norm(sphere.plus(p, sphere.scaled(v, F.lit(-1.0)))) / 2))
    d = F.when(beside, F.asin(F.least(F.lit(1.0), F.abs(sphere.dot(p, n))))).otherwise(F.least(end(F.col("pa")), end(F.col("pb"))))
    near = nearest_candidates(asked, pieces, ("lon", "lat"), by).groupBy(*by, "lon", "lat").agg(F.min(d).alias("d"))
    if threshold is not None:
        near = near.where(F.col("d") <= threshold)
    return points.select("query_id", *by, "lon", "lat").join(near, [*by, "lon", "lat"], "left").select("query_id", *by, (F.coalesce("d", F.lit(beyond)) * MEAN_RADIUS_KM).alias("dist_km"))


def tessellated(segments: DataFrame, threshold: float) -> DataFrame:
    """Each arc (columns a, b, others kept) cut evenly into pieces of at most ``threshold`` radians: pa, pb, mid, piece, arc_len. Arcs without length go."""
    rows = sphere.evaluated(segments, _len=sphere.angle(F.col("a"), F.col("b"))).where("_len > 0")
    rows = sphere.evaluated(rows, _n=F.greatest(F.lit(1), F.ceil(F.col("_len") / threshold).cast("int")), _sin=F.sin("_len"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def part(k: float) -> Column:
        w = F.col("_len") * (F.col("piece") + k) / F.col("_n")
        return sphere.plus(sphere.scaled(F.col("a"), F.sin(F.col("_len") - w) / F.col("_sin")), sphere.scaled(F.col("b"), F.sin(w) / F.col("_sin")))

    return sphere.evaluated(rows, pa=part(0.0), pb=part(1.0), mid=part(0.5), arc_len=F.col("_len") / F.col("_n")).drop("_len", "_n", "_sin")


def query_lines(segments: DataFrame, nodes: DataFrame, threshold: float, search_radius: float, smoothing_radius: float | None = None) -> DataFrame:
    """Rows (query_id, lon, lat, z, weight): the raster along lines (geom_id, a, b), at the middle of each piece of at
    most ``threshold`` radians, with the piece's length as weight. Feature types are picked before moving geometries
    that keep their type, and after resolving those that get it then."""
    pieces = tessellated(segments, threshold).select("geom_id", "piece", F.col("arc_len").alias("weight"), sphere.lon_of(F.col("mid")).alias("lon"), sphere.lat_of(F.col("mid")).alias("lat"))
    points = pieces.withColumn("query_id", F.struct("geom_id", "piece"))
    found = query_raster(points.select("query_id", "lon", "lat"), nodes, search_radius, smoothing_radius)
    return points.join(found, "query_id").select("geom_id", "piece", "lon", "lat", "z", "weight")
