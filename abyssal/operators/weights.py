"""Search of the rivers' weights: many weight vectors scored by one scan of the training rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .calibrate import longitude_folds

#: Degree of the polynomial of a fit; its moments go to twice that.
DEGREE = 3


def products(n: int, degree: int) -> list[tuple[int, ...]]:
    return [c for d in range(degree + 1) for c in combinations_with_replacement(range(n), d)]


@dataclass(frozen=True)
class Training:
    """Sums by fold and river terms r0.. of the rows that share them, written, with means and covariances of the rivers: n, a0.. of the products of up
    to six of the features standardised over all rows, b0.. of y with products of up to three, and yy of the square of y."""

    rows: DataFrame
    n_features: int
    means: np.ndarray
    covariances: np.ndarray

    @property
    def n_rivers(self) -> int:
        return len(self.means)


def prepared(rows: DataFrame, rivers: list[Column], features: list[str], target: Column, k: int, lon: str = "lon") -> Training:
    """The rows of a search: k folds of longitudes, the river terms that weights multiply, and the target.

    Rows with equal river terms are summed once, since weights tell them apart no more; a scan then reads at most as many rows as there are.
    The columns must be numbers; an infinite river term (a river's own mouth) is an error, since no weight makes it a feature.
    """
    folded = longitude_folds(rows.select(lon, *(c.cast("double").alias(f"r{i}") for i, c in enumerate(rivers)), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)), target.alias("y")), lon, k)
    names, n = [f"f{i}" for i in range(len(features))], len(rivers)
    pairs = list(combinations_with_replacement(range(n), 2))
    s = folded.agg(
        F.count("*").alias("n"), *(f(c).alias(f"{m}_{c}") for c in names for m, f in (("m", F.avg), ("v", F.var_pop))),
        *(F.avg(f"r{i}").alias(f"m{i}") for i in range(n)), *(F.covar_pop(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs),
    ).first()
    if not s["n"]:
        raise ValueError("no rows to fit")
    means, covariances = np.array([s[f"m{i}"] for i in range(n)], dtype=float), np.zeros((n, n))
    for i, j in pairs:
        covariances[i, j] = covariances[j, i] = s[f"c{i}_{j}"]
    if not np.isfinite(means).all() or not np.isfinite(covariances).all():
        raise ValueError("a river term is not finite")
    standard = [((F.col(c) - s[f"m_{c}"]) / (s[f"v_{c}"] ** 0.5 or 1.0)).alias(c) for c in names]
    product = lambda c: reduce(lambda a, b: a * b, (F.col(f"f{i}") for i in c), F.lit(1.0))
    sums = [F.sum(product(c)).alias(f"a{i}") for i, c in enumerate(products(len(features), 2 * DEGREE))]
    cross = [F.sum(F.col("y") * product(c)).alias(f"b{i}") for i, c in enumerate(products(len(features), DEGREE))]
    each = F.explode(F.array(F.struct("fold", *(f"r{i}" for i in range(n)), *standard, "y"))).alias("_e")
    rows = folded.select(each).select("_e.*").groupBy("fold", *(f"r{i}" for i in range(n)))
    rows = rows.agg(F.count("*").alias("n"), *sums, *cross, F.sum(F.col("y") * F.col("y")).alias("yy"))
    return Training(stored(rows, "weights"), len(features), means, covariances)


def moments(training: Training, candidates: np.ndarray) -> DataFrame:
    """Rows (candidate, fold, n, p0.., q0.., yy): sums of the products of up to six of the features and the weighted river sum, of y with
    products of up to three, and of the square of y.

    The river sum is standardised by its mean and variance over all rows, which follow from those of the rivers. A row is multiplied by the
    candidates within its task and summed there, so the shuffle holds one row a task, candidate and fold.
    """
    n, f = training.n_rivers, training.n_features
    wide = np.sqrt(np.maximum(0.0, np.einsum("ci,ij,cj->c", candidates, training.covariances, candidates)))
    wide[wide == 0] = 1.0
    scaled = candidates / wide[:, None]
    each = F.lit([[float(c), float(s @ training.means), *map(float, s)] for c, s in enumerate(scaled)]).cast("array<array<double>>")
    rows = training.rows.select("*", F.explode(each).alias("w"))
    rivers = reduce(lambda a, b: a + b, (F.get("w", F.lit(i + 2)) * F.col(f"r{i}") for i in range(n))) - F.get("w", F.lit(1))
    few, own = ({c: i for i, c in enumerate(products(f, d))} for d in (DEGREE, 2 * DEGREE))
    names = [*(f"a{i}" for i in own.values()), *(f"b{i}" for i in few.values())]
    data = rows.select(F.get("w", F.lit(0)).cast("int").alias("candidate"), "fold", "n", *names, "yy", rivers.alias("s"))
    # Powers of the river sum times the sums of the features' products with which they make up each product.
    part = lambda name, of, c: reduce(lambda a, b: a * b, [F.col("s")] * c.count(f), F.col(f"{name}{of[tuple(i for i in c if i < f)]}"))
    sums = [F.sum(part("a", own, c)).alias(f"p{i}") for i, c in enumerate(products(f + 1, 2 * DEGREE))]
    cross = [F.sum(part("b", few, c)).alias(f"q{i}") for i, c in enumerate(products(f + 1, DEGREE))]
    return data.groupBy("candidate", "fold").agg(F.sum("n").alias("n"), *sums, *cross, F.sum("yy").alias("yy"))


def _descend(q: np.ndarray, b: np.ndarray, alpha: float, rounds: int = 20_000) -> np.ndarray:
    """Lasso coefficients of many fits at once by coordinate descent on their matrices (fit, term, term)."""
    w = np.zeros_like(b)
    size = b.shape[1]
    own = np.stack([q[:, j, j] for j in range(size)], axis=1)
    for _ in range(rounds):
        step = 0.0
        for j in range(size):
            r = b[:, j] - np.einsum("mi,mi->m", q[:, j], w) + own[:, j] * w[:, j]
            new = np.where(own[:, j] > 1e-14, np.sign(r) * np.maximum(np.abs(r) - alpha, 0.0) / np.maximum(own[:, j], 1e-14), 0.0)
            step = max(step, float(np.abs(new - w[:, j]).max()))
            w[:, j] = new
        if step < 1e-9:
            break
    return w


def _standardising(gram: np.ndarray, features: int) -> np.ndarray:
    """Each term of features standardised over the rows that ``gram`` sums up, as a sum of terms of the features as they are."""
    terms = products(features, DEGREE)
    places = {c: i for i, c in enumerate(terms)}
    u = [gram[0, places[f,]] / gram[0, 0] for f in range(features)]
    wide = [max(0.0, gram[places[f,], places[f,]] / gram[0, 0] - u[f] ** 2) ** 0.5 or 1.0 for f in range(features)]
    way = np.zeros((len(terms), len(terms)))
    for row, c in enumerate(terms):
        parts = {(): 1.0}
        for f in c:
            more: dict[tuple[int, ...], float] = {}
            for known, x in parts.items():
                for to, y in ((tuple(sorted((*known, f))), x / wide[f]), (known, -x * u[f] / wide[f])):
                    more[to] = more.get(to, 0.0) + y
            parts = more
        for to, x in parts.items():
            way[row, places[to]] = x
    return way


def objectives(training: Training, candidates: np.ndarray, alpha: float = 0.01) -> np.ndarray:
    """Minus R squared of the out-of-fold predictions with each weight vector's river sum as a feature, from one scan.

    The driver gets a fixed number of sums a candidate and fold. A fold's error is a quadratic form of its own sums, so
    predictions are never made row by row.
    """
    features = training.n_features + 1
    terms, powers = products(features, DEGREE), {c: i for i, c in enumerate(products(features, 2 * DEGREE))}
    size, count = len(terms), len(candidates)
    at = np.array([[powers[tuple(sorted(a + b))] for b in terms] for a in terms])
    grams: dict[tuple[int, int], np.ndarray] = {}
    for r in moments(training, candidates).collect():
        g = np.zeros((size + 1, size + 1))
        g[:size, :size] = np.array([r[f"p{i}"] for i in range(len(powers))], dtype=float)[at]
        g[size, :size] = g[:size, size] = [r[f"q{i}"] for i in range(size)]
        g[size, size] = r["yy"]
        grams[r["candidate"], r["fold"]] = g
    folds = sorted({f for _, f in grams})
    if len(folds) < 2:
        raise ValueError("out-of-fold predictions need two folds")
    keys, ways, fits = [(c, f) for c in range(count) for f in folds], [], []
    whole = [sum(grams[c, f] for f in folds) for c in range(count)]
    for c, f in keys:
        gram = whole[c] - grams[c, f]
        way = np.eye(size + 1)
        way[:size, :size] = _standardising(gram, features)
        ways.append(way[:size, :size])
        fits.append(way @ gram @ way.T / gram[0, 0])
    g = np.stack(fits)
    mean = g[:, 0]
    centred = g - np.einsum("mi,mj->mij", mean, mean)
    w = _descend(centred[:, 1:size, 1:size], centred[:, 1:size, size], alpha)
    first = mean[:, size] - np.einsum("mi,mi->m", mean[:, 1:size], w)
    error = np.zeros(count)
    for (c, f), way, b, v in zip(keys, ways, first, w):
        form = np.append(-np.append(b, v) @ way, 1.0)
        error[c] += form @ grams[c, f] @ form
    total = np.array([g[size, size] - g[0, size] ** 2 / g[0, 0] for g in whole])
    return error / total - 1.0


def search(training: Training, start: list[float], low: float = 0.0, high: float = 4.0, step: float = 0.5, least: float = 0.02, alpha: float = 0.01) -> tuple[list[float], float]:
    """Weights within bounds with a small objective, and that objective, by a search that needs no derivatives.

    A round scores every weight moved up and down by ``step`` times itself and a half in one scan, then all moves that helped put together, at half, one and two times
    their length, in another. Where nothing helps, ``step`` halves, and below ``least`` the search ends; no number of rounds ends it before. Only ratios of weights matter
    to the fits, so many weight vectors do equally well.
    """
    best = np.clip(np.array(start, dtype=float), low, high)
    score = float(objectives(training, best[None], alpha)[0])
    while step >= least:
        moves = np.concatenate([np.diag(s * step * (best + 0.5)) for s in (1.0, -1.0)])
        tried = np.clip(best + moves, low, high)
        got = objectives(training, tried, alpha)
        gains = np.where(got < score, score - got, 0.0)
        if gains.max() <= 1e-7:
            step /= 2
            continue
        joint = ((tried - best) * (gains / gains.max())[:, None]).sum(axis=0)
        more = np.clip(best + np.array([0.5, 1.0, 2.0])[:, None] * joint, low, high)
        tried, got = np.concatenate([tried, more]), np.concatenate([got, objectives(training, more, alpha)])
        best, score = tried[got.argmin()], float(got.min())
    return best.tolist(), score
