"""Text inputs: point lists, the training table, rotations, file names by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sphere

#: Columns of the training table.
ALLDATA = (
    "lon lat sedrate sedthick age pcb_mean_dist amazon congo ganges godavari indus magdalena mahanadi "
    "mississippi narmada niger orinoco paleo_congo parana"
).split()
RIVERS = ALLDATA[6:]
ALLDATA_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in ALLDATA])


def parsed_points(lines: DataFrame, value: str = "value") -> DataFrame:
    """lon and lat from the first two words of each line; lines with fewer or that aren't numbers, and comments, are skipped."""
    words = F.split(F.trim(F.col(value)), r"\s+")
    rows = lines.where(~F.trim(F.col(value)).startswith("#")).select(*lines.columns, F.expr("1").alias("_one"), words.alias("_w"))
    rows = rows.withColumns({"lon": F.get("_w", F.lit(0)).try_cast("double"), "lat": F.get("_w", F.lit(1)).try_cast("double")})
    return rows.where("lon IS NOT NULL AND lat IS NOT NULL").drop("_one", "_w")


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parsed_points(spark.read.text(path)).select("lon", "lat")


def numbers(line: Column) -> Column:
    """All words of a line as numbers, NaN for those that aren't."""
    return F.transform(F.split(F.trim(line), r"\s+"), lambda w: F.coalesce(w.try_cast("double"), F.lit(float("nan"))))


def training_rows(lines: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """The nineteen columns of each line; ``strict`` fails on any line with another number of words or one that is no number, else NaN."""
    row = numbers(F.col(value)) if not strict else F.transform(F.split(F.trim(F.col(value)), r"\s+"), lambda w: w.cast("double"))
    rows = lines.select(row.alias("r"))
    if strict:
        rows = rows.where(F.assert_true(F.size("r") == len(ALLDATA), F.lit("a line needs 19 numbers")).isNull())
    return rows.select(*(F.get("r", F.lit(i)).alias(c) for i, c in enumerate(ALLDATA)))


def read_training(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return training_rows(spark.read.text(path), strict=strict)


def read_named(spark: SparkSession, path: str, sep: str = " ", strict: bool = False) -> DataFrame:
    """The training table from a file with one separator between columns; NaN as text. ``strict`` fails on lines with
    another number of columns or one that is no number, which else are null."""
    return spark.read.csv(path, sep=sep, schema=ALLDATA_SCHEMA, nanValue="NaN", mode="FAILFAST" if strict else "PERMISSIVE")


_COLLECTION = """features array<struct<id: string, properties: struct<feature_type: string, plate: int, begin_time: double, end_time: double>,
 geometry: struct<type: string, coordinates: string>>>"""


def parsed_features(collections: DataFrame, value: str = "value") -> DataFrame:
    """Rows (feature_id, feature_type, plate, begin_time, end_time, kind, part, points) of JSON feature collections, one a row.

    Points, lines and polygons count, several of them in one geometry too; each line or ring is a part with its
    (lon, lat) arrays. Times are ages, null if open; other geometries have no row.
    """
    f = collections.select(F.explode(F.from_json(value, _COLLECTION)["features"]).alias("f"))
    kind, body = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    read = lambda depth: F.from_json(body, "array<" * depth + "double" + ">" * depth)
    parts = (
        F.when(kind == "Point", F.array(F.array(read(1)))).when(kind == "MultiPoint", F.transform(read(2), lambda p: F.array(p))).when(kind == "LineString", F.array(read(2)))
        .when(kind.isin("MultiLineString", "Polygon"), read(3)).when(kind == "MultiPolygon", F.flatten(read(4)))
    )
    columns = [F.col("f.id").alias("feature_id"), *(F.col(f"f.properties.{c}").alias(c) for c in ("feature_type", "plate", "begin_time", "end_time")), kind.alias("kind")]
    return f.select(*columns, F.posexplode(parts).alias("part", "points"))


def read_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``parsed_features`` of files, each of one collection."""
    return parsed_features(spark.read.text(path, wholetext=True))


def arcs(features: DataFrame) -> DataFrame:
    """Arcs (.., place, a, b) between neighbouring points of each line or ring; single points have none."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.get("points", i).alias("p"), F.get("points", i + 1).alias("q")))
    rows = features.where(F.size("points") > 1).select("*", F.posexplode(pairs).alias("place", "_pq"))
    end = lambda c: sphere.from_lon_lat(F.col(f"_pq.{c}")[0], F.col(f"_pq.{c}")[1])
    return rows.withColumns({"a": end("p"), "b": end("q")}).drop("points", "_pq")


def read_rotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """moving_plate, fixed_plate, time, pole_lat, pole_lon, angle from rotation files; comments and lines of plate 999 are left out."""
    n = F.split(F.trim(F.split("value", "!").getItem(0)), r"\s+")
    cells = [F.get(n, F.lit(i)).try_cast("double") for i in range(6)]
    rows = spark.read.text(path).select(*(c.alias(x) for c, x in zip(cells, ("moving_plate", "time", "pole_lat", "pole_lon", "angle", "fixed_plate"))))
    rows = rows.where("moving_plate IS NOT NULL AND fixed_plate IS NOT NULL AND moving_plate <> 999")
    return rows.select(F.col("moving_plate").cast("int").alias("moving_plate"), F.col("fixed_plate").cast("int").alias("fixed_plate"), "time", "pole_lat", "pole_lon", "angle")


def manifest(spark: SparkSession, pattern: str, first: int, last: int) -> DataFrame:
    """Rows (time, path): file names by time from a printf pattern."""
    return spark.range(first, last + 1).select(F.col("id").cast("double").alias("time"), F.format_string(pattern, F.col("id").cast("double")).alias("path"))


def comparable(lines: DataFrame, value: str, column: int) -> DataFrame:
    """Lines whose word at ``column`` (from 0) isn't the text NaN."""
    return lines.where(F.get(F.split(F.trim(F.col(value)), r"\s+"), F.lit(column)) != "NaN")
