"""Features in GPML files, plain or zipped, as the rows that JSON collections give, and rows as such files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The element that holds a feature, the words for open times and the name spaces.
MEMBER_END = "</gml:featureMember>"
PAST, FUTURE = "http://gplates.org/times/distantPast", "http://gplates.org/times/distantFuture"
HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<gpml:FeatureCollection xmlns:gml="http://www.opengis.net/gml" xmlns:gpml="http://www.gplates.org/gplates" gpml:version="1.6.0339">\n'
FOOTER = "</gpml:FeatureCollection>\n"

_TIME = "struct<TimeInstant: struct<timePosition: string>>"
_FEATURE = f"""identity string, validTime struct<TimePeriod: struct<begin: {_TIME}, end: {_TIME}>>,
 reconstructionPlateId struct<value: string, ConstantValue: struct<value: string>>"""


def _zipped_members(files: DataFrame) -> DataFrame:
    """Rows (value) of the members of gzip files (content), unzipped piece by piece."""
    end = MEMBER_END.encode()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                data, left = content.as_buffer().to_pybytes(), b""
                while data:
                    stream = zlib.decompressobj(wbits=31)
                    while not stream.eof:
                        piece = stream.decompress(data, 8 << 20)
                        if not piece and not stream.unconsumed_tail and not stream.eof:
                            raise ValueError("a zipped file ends too early")
                        *whole, left = (left + piece).split(end)
                        data = stream.unconsumed_tail
                        if whole:
                            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in whole])], names=["value"])
                    data = stream.unused_data  # files joined end to end

    return files.select("content").mapInArrow(split, "value string")


def parsed_members(members: DataFrame, value: str = "value") -> DataFrame:
    """Rows (feature_id, feature_type, plate, begin_time, end_time, kind, part, points) of feature members, one a row, as ``text.parsed_features`` gives them.

    Whatever property holds a geometry, points (each one of several too), lines and rings of polygons, the outer one first, are parts
    with (lon, lat) arrays. Times are ages, null if open; the plate is null where none is given. Features without such
    a geometry (topologies among them) have no row; a member that is no XML is an error. Text before the first
    and after the last member is skipped.
    """
    body = F.regexp_extract(value, r"(?s)<gml:featureMember[^>]*>(.*)", 1)
    plain = F.trim(F.regexp_replace(body, r"(</?)[A-Za-z_][\w.-]*:", "$1"), F.lit(" \t\r\n"))
    rows = members.select(plain.alias("x")).where("x <> ''")
    read = F.from_xml("x", _FEATURE, {"mode": "FAILFAST"})
    texts = lambda kind, path: F.transform(F.xpath("x", F.lit(path)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    shapes = F.concat(texts("Point", "//Point/pos/text()"), texts("LineString", "//LineString/posList/text()"), texts("Polygon", "//Polygon//posList/text()"))
    rows = rows.select(F.regexp_extract("x", r"(?s)^(?:<!--.*?-->\s*)*<([\w.-]+)", 1).alias("feature_type"), read.alias("f"), F.posexplode(shapes).alias("part", "s"))
    n = F.transform(F.split(F.trim("s.text", F.lit(" \t\r\n")), r"\s+"), lambda w: w.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("int(size(n) div 2)") - 1), lambda i: F.array(F.get("n", 2 * i + 1), F.get("n", 2 * i)))
    age = lambda c: F.col(f"f.validTime.TimePeriod.{c}.TimeInstant.timePosition").try_cast("double")
    plate = F.coalesce("f.reconstructionPlateId.ConstantValue.value", "f.reconstructionPlateId.value").try_cast("int")
    return rows.withColumn("n", n).select(
        F.col("f.identity").alias("feature_id"), "feature_type", plate.alias("plate"), age("begin").alias("begin_time"), age("end").alias("end_time"), F.col("s.kind").alias("kind"), "part", pairs.alias("points"),
    )


def read_gpml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``parsed_members`` of files or folders of them. Plain files are split at members, so one file may feed many tasks; files
    called .gpmlz are unzipped by one task each."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    zipped = [p for p in paths if p.lower().endswith(".gpmlz")]
    plain = [p for p in paths if p not in zipped]
    members = []
    if plain:
        members.append(spark.read.text(plain, lineSep=MEMBER_END))
    if zipped:
        members.append(_zipped_members(spark.read.format("binaryFile").load(zipped)))
    return parsed_members(members[0] if len(members) == 1 else members[0].union(members[1]))


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def members(features: DataFrame) -> DataFrame:
    """A member of a GPML file for each feature, as rows (value), from the rows that ``parsed_members`` gives.

    The parts of a feature are put together in their order: the rings of a polygon, and each point and line as a property of its own.
    """
    flat = F.array_join(F.flatten(F.transform("points", lambda p: F.array(p[1].cast("string"), p[0].cast("string")))), " ")
    keys = ["feature_id", "feature_type", "plate", "begin_time", "end_time"]
    whole = features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "kind", flat.alias("text")))).alias("parts"))
    constant = lambda name, value: F.concat(F.lit(f"<gpml:{name}><gpml:ConstantValue><gpml:value>"), value, F.lit(f"</gpml:value></gpml:ConstantValue></gpml:{name}>"))
    time = lambda name, at, open_: F.concat(F.lit(f"<gml:{name}><gml:TimeInstant><gml:timePosition>"), F.coalesce(F.col(at).cast("string"), F.lit(open_)), F.lit(f"</gml:timePosition></gml:TimeInstant></gml:{name}>"))
    of = lambda kind: F.filter("parts", lambda p: p["kind"] == kind)
    ring = lambda p, side: F.concat(F.lit(f"<gml:{side}><gml:LinearRing><gml:posList>"), p["text"], F.lit(f"</gml:posList></gml:LinearRing></gml:{side}>"))
    each = lambda kind, name, start, end: F.array_join(F.transform(of(kind), lambda p: constant(name, F.concat(F.lit(start), p["text"], F.lit(end)))), "")
    rings = F.array_join(F.transform(of("Polygon"), lambda p, i: F.when(i == 0, ring(p, "exterior")).otherwise(ring(p, "interior"))), "")
    value = F.concat(
        F.lit("<gml:featureMember><gpml:"), "feature_type", F.lit("><gpml:identity>"), _escaped(F.coalesce("feature_id", F.lit(""))), F.lit("</gpml:identity><gml:validTime><gml:TimePeriod>"),
        time("begin", "begin_time", PAST), time("end", "end_time", FUTURE), F.lit("</gml:TimePeriod></gml:validTime>"),
        F.when(F.col("plate").isNotNull(), constant("reconstructionPlateId", F.col("plate").cast("string"))).otherwise(""),
        each("Point", "position", "<gml:Point><gml:pos>", "</gml:pos></gml:Point>"), each("LineString", "centerLineOf", "<gml:LineString><gml:posList>", "</gml:posList></gml:LineString>"),
        F.when(F.size(of("Polygon")) > 0, constant("outlineOf", F.concat(F.lit("<gml:Polygon>"), rings, F.lit("</gml:Polygon>")))).otherwise(""),
        F.lit("</gpml:"), "feature_type", F.lit(">" + MEMBER_END),
    )
    return whole.select(value.alias("value"))


def write_gpml(features: DataFrame, path: str, zipped: bool = False) -> None:
    """A folder of GPML files, one a task, each a whole collection; Spark commits them together."""

    def collection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda text: pa.RecordBatch.from_arrays([pa.array([text.rstrip()])], names=["value"])
        yield line(HEADER)
        yield from batches
        yield line(FOOTER)

    out = members(features).mapInArrow(collection, "value string").write.mode("overwrite")
    (out.option("compression", "gzip") if zipped else out).text(path)
