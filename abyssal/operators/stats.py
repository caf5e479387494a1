"""Aggregates over time, features and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MEAN_RADIUS_KM, normal_velocity


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def weighted_std(x: Column, w: Column) -> Column:
    """Population deviation, 0 where rounding makes the variance negative."""
    mean = weighted_mean(x, w)
    return F.sqrt(F.greatest(F.lit(0.0), F.sum(w * x * x) / F.sum(w) - mean * mean))


def subducted(arcs: DataFrame) -> DataFrame:
    """By time: length-weighted mean and deviation of thickness, length and yearly volume of sediment.

    ``arcs`` has time, thickness (m), arc_len_deg, conv_cm_yr, conv_obliq_deg; arcs without thickness
    don't count, diverging ones add a negative volume, and a time without arcs has no row.
    """
    length = F.radians("arc_len_deg") * 1e3 * MEAN_RADIUS_KM
    rows = arcs.where(~F.isnan("thickness") & F.col("thickness").isNotNull()).withColumn("length_m", length)
    volume = normal_velocity(F.col("conv_cm_yr"), F.col("conv_obliq_deg")) * F.col("thickness") * F.col("length_m")
    return rows.groupBy("time").agg(
        weighted_mean(F.col("thickness"), F.col("length_m")).alias("mean_thickness"),
        weighted_std(F.col("thickness"), F.col("length_m")).alias("std_thickness"),
        F.sum("length_m").alias("length_m"),
        F.sum(volume).alias("volume_m3_yr"),
        (F.sum(volume) / F.sum("length_m")).alias("volume_per_m"),
    )


def margin_lengths(geometries: DataFrame, dedupe: bool = True) -> DataFrame:
    """Kilometres of lines by time from rows (time, geom_id, kind, geom_key, length_rad); points have no
    length. Exact duplicates at a time (one geom_key) count once if ``dedupe``."""
    lines = geometries.where(F.col("kind").isin("polyline", "polygon"))
    if dedupe:
        lines = lines.groupBy("time", "geom_key").agg(F.min(F.struct("geom_id", "length_rad")).alias("g")).select("time", F.col("g.length_rad").alias("length_rad"))
    return lines.groupBy("time").agg((F.sum("length_rad") * MEAN_RADIUS_KM).alias("length_km"))


def first_of_equal(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row of each set of rows equal in ``columns``."""
    return rows.groupBy(*columns).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def last_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last in ``order``, as a dictionary built in that order would keep."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def r_squared(y: Column, p: Column) -> Column:
    return 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))


def median(rows: DataFrame, column: str, bins: int = 4096, few: int = 10_000) -> float | None:
    """Exact median, the mean of both middle values for an even number, without gathering the values in one task.

    Values are counted in ``bins`` equal bins of their range, then only those of the bin that holds the middle, until that has few distinct
    values or one. No task nor the driver holds more than the bins or the few. Nulls don't count; NaN is above all numbers; None without values.
    """
    x = rows.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    s = x.agg(F.count("*").alias("n"), F.count(F.when(~F.isnan("x"), 1)).alias("m"), F.min("x").alias("lo"), F.max(F.when(~F.isnan("x"), F.col("x"))).alias("hi")).first()
    if not s["n"]:
        return None
    ranks, below, lo, hi = [(s["n"] - 1) // 2, s["n"] // 2], 0, s["lo"], s["hi"]
    found = {r: float("nan") for r in ranks if r >= s["m"]}
    n, x = s["m"], x.where(~F.isnan("x"))
    while len(found) < len(set(ranks)):
        if n <= few or lo == hi or not (hi - lo < float("inf")):
            values = x.where(F.col("x").between(lo, hi)).groupBy("x").count().orderBy("x")
            for r in values.toLocalIterator() if lo != hi else [{"x": lo, "count": n}]:
                found |= {k: r["x"] for k in ranks if below <= k < below + r["count"]}
                below += r["count"]
            continue
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / ((hi - lo) / bins)))
        counts = sorted(x.where(F.col("x").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        left = [k for k in ranks if k not in found]
        for r in counts:
            inside = [k for k in left if below <= k < below + r["n"]]
            if len(inside) < len(set(left)) and inside or r["n"] == 1 and inside:  # the middle lies between two bins
                found |= {k: r["hi"] if k == below + r["n"] - 1 else r["lo"] for k in inside}
            elif inside:
                n, lo, hi = r["n"], r["lo"], r["hi"]
                break
            below += r["n"]
    return (found[ranks[0]] + found[ranks[1]]) / 2


def compared(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Means and medians of what is observed and predicted, the mean difference and R squared. The medians are found first (``median``)."""
    middle = {c: F.lit(median(rows, c)).cast("double") for c in {y, p}}
    return rows.agg(
        F.avg(y).alias("mean_observed"), F.avg(p).alias("mean_predicted"), F.max(middle[y]).alias("median_observed"), F.max(middle[p]).alias("median_predicted"),
        F.avg(F.col(p) - F.col(y)).alias("mean_difference"), r_squared(F.col(y), F.col(p)).alias("r2"),
    )


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value, which the last bin includes."""
    bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.when(width != 0, width))))
    return rows.select(value).crossJoin(F.broadcast(bounds)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population variance, smallest and largest of each column."""
    return rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))))


def near_best(pairs: DataFrame, key: str, distance: str, slack: float) -> DataFrame:
    """Of each key's pairs those no farther than its nearest plus ``slack``."""
    return pairs.withColumn("_best", F.min(distance).over(Window.partitionBy(key))).where(F.col(distance) <= F.col("_best") + slack).drop("_best")


def inverse_distance_mean(pairs: DataFrame, key: str, distance: str, value: str) -> DataFrame:
    """Mean weighted by 1/d; a pair at distance 0 gives its value alone. Pairs without a value don't count."""
    d = F.col(distance)
    w = F.when(d != 0, 1.0 / F.when(d != 0, d))
    exact = F.min(F.when(d == 0, F.col(value)))
    return pairs.where(F.col(value).isNotNull()).groupBy(key).agg(F.coalesce(exact, F.sum(w * F.col(value)) / F.sum(w)).alias(value))
