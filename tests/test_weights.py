"""Scores of weight vectors from one scan against fits one by one, and planted weights found again."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal.operators import calibrate, weights

PLANTED = [1.0, 0.2, 2.5, 0.6]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 1500
    age, dist, lon, r = rng.gamma(2, 30, n), rng.gamma(3, 200, n), rng.integers(-180, 180, n), rng.gamma(1.0, 0.01, (n, 4))
    s = r @ PLANTED
    y = np.exp(1 - age / 90 - 0.2 * dist / 600 + 0.8 * np.tanh((s - s.mean()) / s.std()) + 0.05 * rng.normal(size=n))
    return spark.createDataFrame([(*map(float, x),) for x in zip(age, dist, lon, y, *r.T)], "age double, dist double, lon double, rate double, a double, b double, c double, d double").cache()


@pytest.fixture(scope="module")
def training(rows):
    return weights.prepared(rows, [F.col(c) for c in "abcd"], ["age", "dist"], F.log("rate"), 3)


def test_scores_are_those_of_single_fits(rows, training):
    tried = np.array([PLANTED, [1.0, 1.0, 1.0, 1.0], [0.0, 0.0, 0.0, 3.0], [0.0, 0.0, 0.0, 0.0]])
    got = weights.objectives(training, tried)
    for w, score in zip(tried.tolist(), got):
        one = calibrate.objective(rows, lambda v: sum(F.col(c) * x for c, x in zip("abcd", v)), w, ["age", "dist"], "rate", 3)
        assert abs(one - score) < 1e-6
    assert got[0] < got[1] < got[3]
    assert np.allclose(weights.objectives(training, 7 * tried), got)  # ratios alone matter


def test_planted_weights_are_found(training):
    planted = float(weights.objectives(training, np.array([PLANTED]))[0])
    found, score = weights.search(training, [1.0] * 4)
    assert score <= planted + 1e-3 and all(0 <= w <= 4 for w in found)
    assert np.corrcoef(found, PLANTED)[0, 1] > 0.97


def test_what_cannot_be_fitted(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        weights.prepared(rows.where("false"), [F.col("a")], ["age"], F.log("rate"), 3)
    with pytest.raises(ValueError, match="not finite"):
        weights.prepared(rows, [F.when(F.col("lon") > 0, F.lit(float("inf"))).otherwise(F.col("a"))], ["age"], F.log("rate"), 3)
    with pytest.raises(ValueError, match="two folds"):
        weights.objectives(weights.prepared(rows, [F.col("a")], ["age"], F.log("rate"), 1), np.array([[1.0]]))


def test_search_goes_on_until_no_move_helps(spark, monkeypatch):
    """Neither the search nor its query ends at a number of rounds: along a narrow valley it goes on while single moves help."""
    from abyssal.plans import catalog

    def valley(training, candidates, alpha=0.01):
        return 0.01 * (candidates[:, 0] - 3.5) ** 2 + 50 * ((candidates[:, 1:] - candidates[:, :1]) ** 2).sum(axis=1)

    def helped(found):
        best = np.array(found)
        moves = np.concatenate([np.diag(s * 0.03125 * (best + 0.5)) for s in (1.0, -1.0)])
        return float((valley(None, best[None])[0] - valley(None, np.clip(best + moves, 0, 4))).max())

    monkeypatch.setattr(weights, "objectives", valley)
    found, score = weights.search(None, [0.0] * 2, step=0.04)
    assert helped(found) <= 1e-7 and score == valley(None, np.array([found]))[0]
    monkeypatch.setattr(catalog, "_river_training", lambda *_: None)
    rows = catalog.queries()["river_weight_search"](spark, "").orderBy("river").collect()
    assert rows[0]["objective"] < rows[0]["objective_before"] and helped([r["weight"] for r in rows]) <= 1e-7
