"""The driver's tables as places, raster nodes and lines, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from . import sphere_sql as S
from .registry import table


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * asin(least(1.0, sqrt(sin((radians({lat2}) - radians({lat1})) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin((radians({lon2}) - radians({lon1})) / 2) ** 2))))"


PLACE = "(({k} * 37) % 3600) / 10.0 - 180 + 0.03 AS lon, (({k} * 53) % 1780) / 10.0 - 89 + 0.01 AS lat"


def place(key: str) -> list[Column]:
    k = F.col(key)
    return [(((k * 37) % 3600) / 10.0 - 180 + 0.03).alias("lon"), (((k * 53) % 1780) / 10.0 - 89 + 0.01).alias("lat")]


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), *place("c_custkey"))


def suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), *place("s_suppkey"), F.col("s_acctbal").alias("z"))


CUSTOMERS = f"q AS (SELECT c_custkey AS query_id, {PLACE.format(k='c_custkey')} FROM customer)"
SUPPLIERS = f"s AS (SELECT s_suppkey AS node_id, {PLACE.format(k='s_suppkey')}, s_acctbal AS z FROM supplier)"


def arcs(spark, sf_dir) -> DataFrame:
    """A short arc for each supplier; some have no length."""
    k = F.col("s_suppkey")
    a = sphere.from_lon_lat(((k * 37) % 360 - 180).cast("double"), ((k * 13) % 120 - 60).cast("double"))
    b = sphere.from_lon_lat(((k * 37) % 360 - 180 + k % 9).cast("double"), ((k * 13) % 120 - 60 + k % 4).cast("double"))
    return table(spark, sf_dir, "supplier").select(k.alias("geom_id"), a.alias("a"), b.alias("b"))


_K = "((s_suppkey * 37) % 360 - 180", "((s_suppkey * 13) % 120 - 60"
ARCS = f"""arcs AS (SELECT *, CASE WHEN geom_id % 9 = 0 AND geom_id % 4 = 0 THEN 0 ELSE {S.angle(S.named("a"), S.named("e"))} END AS len
  FROM (SELECT s_suppkey AS geom_id, {S.as_(S.from_lon_lat(_K[0] + ")", _K[1] + ")"), "a")}, {S.as_(S.from_lon_lat(_K[0] + " + s_suppkey % 9)", _K[1] + " + s_suppkey % 4)"), "e")} FROM supplier))"""
