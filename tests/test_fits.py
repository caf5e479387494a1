"""Fits from sums by fold, folds of longitudes and medians without a task for all values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal.operators import calibrate, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 600
    age, dist, lon = rng.gamma(2, 30, n), rng.gamma(3, 200, n), rng.integers(-180, 180, n)
    y = np.exp(1 + 0.4 * np.tanh(age / 60 - 1) - 0.3 * dist / 600 + 0.1 * rng.normal(size=n) + lon / 900)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(age, dist, lon, y))], "id int, age double, dist double, lon double, rate double").cache()


def test_fits_meet_the_conditions_of_the_least(spark, rows):
    """At each fit the slope of the squared error is within alpha, and equal to it where the coefficient isn't 0; folds are left out."""
    out, models = calibrate.out_of_fold(rows, ["age", "dist"], "rate", 3)
    folds = {r["id"]: r["fold"] for r in out.select("id", "fold").collect()}
    table = rows.collect()
    for i, model in [(None, calibrate.fit(rows, ["age", "dist"], "rate")), *enumerate(models)]:
        own = [r for r in table if folds[r["id"]] != i]
        x = np.array([[r["age"], r["dist"]] for r in own])
        assert np.allclose(x.mean(0), model.means) and np.allclose(x.var(0), model.variances) and np.allclose(x.max(0), model.maxima)
        a, d = ((x - x.mean(0)) / x.std(0)).T
        t = np.stack([a, d, a * a, a * d, d * d, a**3, a * a * d, a * d * d, d**3], axis=1)
        w, y = np.array(model.coefficients[1:]), np.log([r["rate"] for r in own])
        left = y - model.coefficients[0] - t @ w
        slope = t.T @ left / len(y)
        assert abs(left.mean()) < 1e-8 and (np.abs(slope) <= 0.01 + 1e-8).all() and np.allclose(slope[w != 0], 0.01 * np.sign(w[w != 0]), atol=1e-7)
    own = {r["id"]: r["predicted"] for r in out.collect()}
    for r in table[:20]:
        m = models[folds[r["id"]]]
        a, d = ((v - u) / s**0.5 for v, u, s in zip((r["age"], r["dist"]), m.means, m.variances))
        assert own[r["id"]] == pytest.approx(np.dot(m.coefficients, [1, a, d, a * a, a * d, d * d, a**3, a * a * d, a * d * d, d**3]))


def test_a_constant_feature_has_no_part(spark, rows):
    model = calibrate.fit(rows.withColumn("one", F.lit(5.0)), ["age", "one"], "rate")
    assert model.variances[1] == 0 and all(math.isfinite(c) for c in model.coefficients)
    assert math.isfinite(rows.withColumn("one", F.lit(5.0)).select(F.avg(model.predict())).first()[0])


def test_folds_of_measured_longitudes(spark):
    rng = random.Random(2)
    for n, k in ((7, 3), (2, 3), (50, 4), (1, 1)):
        values = [rng.uniform(-180, 180) for _ in range(n)]
        given = spark.createDataFrame([(v,) for v in values + values[: n // 2]], "lon double")
        got = {r["lon"]: r["fold"] for r in calibrate.longitude_folds(given, "lon", k).collect()}
        want = {v: i for i, part in enumerate(np.array_split(sorted(values), k)) for v in part}
        assert got == want


def test_medians_are_exact(spark):
    rng = np.random.default_rng(4)
    nan = float("nan")
    cases = [[], [3.0], [1.0, 2.0], [1.0, 2.0, nan], [1.0, nan], [nan, nan], [5.0] * 9, [0.0, 1e9, 1e9 + 1, 2.0], [-1e308, 1e308, 0.0, 1.0], rng.normal(size=501).tolist(), rng.normal(size=1000).tolist(), np.round(rng.exponential(size=2000), 2).tolist()]
    for values in cases:
        given = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        want = given.agg(F.median("v")).first()[0]
        for bins, few in ((4096, 10_000), (8, 3), (2, 1)):
            got = stats.median(given, "v", bins, few)
            assert got == want or got != got and want != want or got == pytest.approx(want, rel=1e-15), (values[:5], bins, got, want)
