"""GPML files, plain and zipped."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from abyssal.sources import gpml

TIME = "<gml:{0}><gml:TimeInstant><gml:timePosition gml:frame='http://gplates.org/TRS/flat'>{1}</gml:timePosition></gml:TimeInstant></gml:{0}>"


def member(kind: str, name: str, plate: int | None, begin: str, end: str, body: str) -> str:
    plate_of = "" if plate is None else f"<gpml:reconstructionPlateId><gpml:ConstantValue><gpml:value>{plate}</gpml:value><gpml:valueType>gpml:plateId</gpml:valueType></gpml:ConstantValue></gpml:reconstructionPlateId>"
    return f"""<gml:featureMember>
 <!-- one feature --><gpml:{kind}><gpml:identity>{name}</gpml:identity><gml:name>a &lt;b&gt; &amp; c</gml:name>
 <gml:validTime><gml:TimePeriod>{TIME.format("begin", begin)}{TIME.format("end", end)}</gml:TimePeriod></gml:validTime>{plate_of}{body}</gpml:{kind}>
</gml:featureMember>
"""


ONE = member("SubductionZone", "GPlates-1", 801, "230.5", gpml.FUTURE, "<gpml:centerLineOf><gpml:ConstantValue><gpml:value><gml:OrientableCurve gml:orientation='+'><gml:baseCurve><gml:LineString><gml:posList gml:dimension='2'> 1 2\n 3.5 4 -5 6 </gml:posList></gml:LineString></gml:baseCurve></gml:OrientableCurve></gpml:value></gpml:ConstantValue></gpml:centerLineOf>")
TWO = member("Coastline", "GPlates-2", None, gpml.PAST, "0", "<gpml:boundary><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 0 9 9 9</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>1 1 1 2 2 2</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></gpml:boundary><gpml:position><gml:Point><gml:pos>-10 20</gml:pos></gml:Point></gpml:position>")
THREE = member("HotSpot", "GPlates-3", 3, "10", "-999", "<gpml:multiPosition><gml:MultiPoint><gml:pointMember><gml:Point><gml:pos>1 2</gml:pos></gml:Point></gml:pointMember><gml:pointMember><gml:Point><gml:pos>3 4</gml:pos></gml:Point></gml:pointMember></gml:MultiPoint></gpml:multiPosition>")
EMPTY = member("TopologicalNetwork", "GPlates-4", 4, "10", "0", "<gpml:network/>")


def rows(df) -> list[tuple]:
    got = df.collect()
    return sorted((r["feature_id"], r["feature_type"], r["plate"], r["begin_time"], r["end_time"], r["kind"], r["part"], tuple(map(tuple, r["points"]))) for r in got)


WANT = sorted([
    ("GPlates-1", "SubductionZone", 801, 230.5, None, "LineString", 0, ((2.0, 1.0), (4.0, 3.5), (6.0, -5.0))),
    ("GPlates-2", "Coastline", None, None, 0.0, "Point", 0, ((20.0, -10.0),)),
    ("GPlates-2", "Coastline", None, None, 0.0, "Polygon", 1, ((0.0, 0.0), (9.0, 0.0), (9.0, 9.0))),
    ("GPlates-2", "Coastline", None, None, 0.0, "Polygon", 2, ((1.0, 1.0), (2.0, 1.0), (2.0, 2.0))),
    ("GPlates-3", "HotSpot", 3, 10.0, -999.0, "Point", 0, ((2.0, 1.0),)),
    ("GPlates-3", "HotSpot", 3, 10.0, -999.0, "Point", 1, ((4.0, 3.0),)),
])


def test_files_plain_and_zipped(spark, tmp_path):
    a, b, none = tmp_path / "a.gpml", tmp_path / "b.GPMLZ", tmp_path / "none.gpml"
    a.write_text(gpml.HEADER + ONE + EMPTY + gpml.FOOTER)
    data = (gpml.HEADER + TWO + THREE + gpml.FOOTER).encode()
    b.write_bytes(gzip.compress(data[:900]) + gzip.compress(data[900:]))
    none.write_text(gpml.HEADER + gpml.FOOTER)
    assert rows(gpml.read_gpml(spark, [str(a), str(b), str(none)])) == WANT
    assert rows(gpml.read_gpml(spark, str(none))) == []
    b.write_bytes(gzip.compress(data)[:-40])
    with pytest.raises(Exception, match="ends too early"):
        gpml.read_gpml(spark, str(b)).collect()


def test_round_trip(spark, tmp_path):
    a = tmp_path / "a.gpml"
    a.write_text(gpml.HEADER + ONE + TWO + THREE + gpml.FOOTER)
    read = gpml.read_gpml(spark, str(a)).withColumn("feature_id", F.concat("feature_id", F.lit(" <&>")))
    for zipped in (False, True):
        gpml.write_gpml(read.repartition(3), str(tmp_path / f"out{zipped}"), zipped)
        got = rows(gpml.read_gpml(spark, str(tmp_path / f"out{zipped}")))
        assert got == [(r[0] + " <&>", *r[1:]) for r in WANT]


def test_one_file_feeds_many_tasks(spark, tmp_path):
    (tmp_path / "big.gpml").write_text(gpml.HEADER + "".join(ONE.replace("GPlates-1", f"g{i}") for i in range(3000)) + gpml.FOOTER)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        read = gpml.read_gpml(spark, str(tmp_path / "big.gpml"))
        assert read.rdd.getNumPartitions() > 3 and read.select("feature_id").distinct().count() == read.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
