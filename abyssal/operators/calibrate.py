"""Calibrating the cubic models: filters, longitude folds, Lasso fits, predictions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import numbered
from .stats import compared


def number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def rate_rows(rows: DataFrame) -> DataFrame:
    """Rows for the rate fit: thickness not 0 (one that isn't a number passes), age, distance and rate numbers, rate not 0."""
    thick = F.coalesce(F.col("sedthick"), F.lit(float("nan")))
    return rows.where((thick != 0) & number(F.col("age")) & number(F.col("pcb_mean_dist")) & number(F.col("sedrate")) & (F.col("sedrate") != 0))


def thickness_rows(rows: DataFrame) -> DataFrame:
    """Rows for the thickness fit: thickness must be a number too."""
    return rate_rows(rows).where(number(F.col("sedthick")))


def replaced(rows: DataFrame, others: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` of the training rows taken from ``others`` by ``keys``; a row without a partner there is an error."""
    found = others.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_found"))
    missing = F.raise_error(F.concat(F.lit("no value for "), F.to_json(F.struct(*keys)))).cast(others.schema[column].dataType)
    joined = rows.join(found, keys, "left").withColumn(column, F.when(F.col("_found"), F.col("_new")).otherwise(missing))
    return joined.select(*rows.columns)


def longitude_folds(rows: DataFrame, lon: str, k: int, name: str = "fold") -> DataFrame:
    """Folds 0 to k - 1 of nearly equally many distinct longitudes, in their order; larger folds come first.

    Distinct longitudes are numbered by range partitions, so measured ones, nearly as many as rows, need no task of their own. Rows
    without a longitude are in the fold of the smallest ones.
    """
    order = numbered(rows.select(lon).distinct(), [lon], "longitudes", "_n")
    whole, more = divmod(order.count(), k)
    n = F.col("_n")
    at = F.when(n < more * (whole + 1), F.floor(n / (whole + 1))).otherwise(more + F.floor((n - more * (whole + 1)) / max(1, whole)))
    folds = order.select(F.col(lon).alias("_lon"), at.cast("int").alias(name))
    return rows.join(folds, F.col(lon).eqNullSafe(F.col("_lon"))).drop("_lon")


def polynomial(columns: list[Column], degree: int = 3) -> list[Column]:
    """All products of up to ``degree`` of the columns but the constant, by degree, then in order of the columns."""
    return [reduce(lambda a, b: a * b, c) for d in range(1, degree + 1) for c in combinations_with_replacement(columns, d)]


@dataclass(frozen=True)
class Lasso:
    """Means and population variances of the features, and ten (or more) coefficients, the constant first."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    variances: tuple[float, ...]
    maxima: tuple[float, ...]
    coefficients: tuple[float, ...]

    def terms(self) -> list[Column]:
        return polynomial([(F.col(f) - m) / (v**0.5 or 1.0) for f, m, v in zip(self.features, self.means, self.variances)])

    def predict(self) -> Column:
        """Log of the target."""
        return sum((F.lit(c) * t for c, t in zip(self.coefficients[1:], self.terms())), F.lit(self.coefficients[0]))


def _combinations(n: int, degree: int = 3) -> list[tuple[int, ...]]:
    return [c for d in range(degree + 1) for c in combinations_with_replacement(range(n), d)]


def moments(rows: DataFrame, features: list[str], target: Column, fold: str | None = None) -> tuple[Lasso, DataFrame]:
    """Sums over which every fit is solved: rows (fold, i, j, total, and n and the largest features of the fold once more on each).

    Terms are the cubic ones of the features standardised over all rows (the first result), the constant first and the target last;
    ``total`` is the sum of the product of terms i and j, i not above j. One aggregation of a fixed number of sums.
    """
    s = rows.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("v", F.var_pop), ("x", F.max)))).first()
    if s[f"m_{features[0]}"] is None:
        raise ValueError("no rows to fit")
    base = Lasso(tuple(features), *(tuple(float(s[f"{n}_{c}"]) for c in features) for n in "mvx"), coefficients=())
    terms = [F.lit(1.0), *base.terms(), target]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    data = rows.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), *(t.alias(f"t{i}") for i, t in enumerate(terms)), *(F.col(c).alias(f"x{i}") for i, c in enumerate(features)))
    sums = data.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s{i}_{j}") for i, j in pairs), *(F.max(f"x{i}").alias(f"x{i}") for i in range(len(features))))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("total")) for i, j in pairs))).alias("m")
    return base, sums.select("fold", "n", F.array(*(f"x{i}" for i in range(len(features)))).alias("largest"), each).select("fold", "m.*", "n", "largest")


def _solved(base: Lasso, gram: np.ndarray, largest: np.ndarray, alpha: float) -> Lasso:
    """The Lasso of the rows that ``gram`` sums up, over features standardised by these rows' own means and variances."""
    n, k = gram[0, 0], len(base.features)
    places, terms = {c: i for i, c in enumerate(_combinations(k))}, _combinations(k)
    scale, shift, means, variances = [], [], [], []
    for f, (m, v) in enumerate(zip(base.means, base.variances)):
        wide, u = v**0.5 or 1.0, gram[0, places[f,]] / n
        own = max(0.0, gram[places[f,], places[f,]] / n - u * u) if v else 0.0
        means.append(m + u * wide)
        variances.append(own * wide * wide)
        narrow = own**0.5 if own > 0 else 1.0 / wide
        scale.append(1.0 / narrow)
        shift.append(-u / narrow)
    way = np.zeros((len(terms) + 1, len(terms) + 1))  # each term of these features as a sum of terms of the common ones
    way[-1, -1] = 1.0
    for row, c in enumerate(terms):
        parts = {(): 1.0}
        for f in c:
            more: dict[tuple[int, ...], float] = {}
            for known, x in parts.items():
                for to, y in ((tuple(sorted((*known, f))), x * scale[f]), (known, x * shift[f])):
                    more[to] = more.get(to, 0.0) + y
            parts = more
        for to, x in parts.items():
            way[row, places[to]] = x
    g = way @ gram @ way.T / n
    mean = g[0]
    c = g - np.outer(mean, mean)
    size = len(terms)
    q, b, w = c[1:size, 1:size], c[1:size, -1], np.zeros(size - 1)
    for _ in range(200_000):
        step = 0.0
        for j in range(size - 1):
            if q[j, j] > 1e-14:
                r = b[j] - q[j] @ w + q[j, j] * w[j]
                new = math.copysign(max(abs(r) - alpha, 0.0), r) / q[j, j]
                step, w[j] = max(step, abs(new - w[j])), new
        if step < 1e-12:
            break
    return Lasso(base.features, tuple(means), tuple(variances), tuple(map(float, largest)), (float(mean[-1] - mean[1:size] @ w), *map(float, w)))


def fits(rows: DataFrame, features: list[str], target: str, alpha: float = 0.01, log: bool = True, fold: str | None = None) -> dict[int | None, Lasso]:
    """Lasso fits of the (log) target on a cubic in the standardised features: of all rows (None) and, given a ``fold`` column, of the rows outside each fold.

    Objective: mean squared error over two plus ``alpha`` times the absolute coefficients. The rows are read twice, whatever the number of
    fits: for the means and variances, and for the sums by fold. A fold is left out by subtracting its sums; each
    fit's own standardisation is a change of basis of these sums, and coordinate descent runs on the small matrix.
    """
    base, sums = moments(rows, features, F.log(F.col(target)) if log else F.col(target).cast("double"), fold)
    size = len(_combinations(len(features))) + 1
    grams: dict[int, np.ndarray] = {}
    largest: dict[int, np.ndarray] = {}
    for r in sums.collect():  # a fixed number of sums a fold
        g = grams.setdefault(r["fold"], np.zeros((size, size)))
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["total"]
        largest[r["fold"]] = np.array(r["largest"], dtype=float)
    whole = sum(grams.values())
    out: dict[int | None, Lasso] = {None: _solved(base, whole, np.max(list(largest.values()), axis=0), alpha)}
    for f in sorted(grams) if fold else ():
        if len(grams) > 1:
            out[f] = _solved(base, whole - grams[f], np.max([x for k, x in largest.items() if k != f], axis=0), alpha)
    return out


def fit(rows: DataFrame, features: list[str], target: str, alpha: float = 0.01, log: bool = True) -> Lasso:
    """The fit of all rows."""
    return fits(rows, features, target, alpha, log)[None]


def out_of_fold(rows: DataFrame, features: list[str], target: str, k: int, lon: str = "lon", alpha: float = 0.01) -> tuple[DataFrame, list[Lasso]]:
    """Predicted log of the target for each row by the fit on the other folds, and the k fits, all from one pass of sums."""
    folded = longitude_folds(rows, lon, k)
    found = fits(folded, features, target, alpha, fold="fold")
    own = [found[i] for i in sorted(f for f in found if f is not None)]
    numbers = sorted(f for f in found if f is not None)
    predicted = F.lit(None).cast("double")
    for i, model in zip(numbers, own):
        predicted = F.when(F.col("fold") == i, model.predict()).otherwise(predicted)
    return folded.withColumn("predicted", predicted), own


def objective(rows: DataFrame, with_weights: Callable[[list[float]], Column], weights: list[float], features: list[str], target: str, k: int) -> float:
    """Minus R squared of out-of-fold predictions, with the weighted river sum as a feature; for an outer search over weights."""
    table = rows.withColumn("rivers", with_weights(weights))
    out, _ = out_of_fold(table, [*features, "rivers"], target, k)
    return -float(compared(out.withColumn("y", F.log(target)), "y", "predicted").first()["r2"])


def mesh(spark: SparkSession, model: Lasso, n: int = 20) -> DataFrame:
    """Predictions over an n by n mesh from 0 to the largest age and distance."""
    (a, d), (x, y) = model.features[:2], model.maxima[:2]
    i, j = F.expr(f"id div {n}"), F.col("id") % n
    grid = spark.range(n * n).select((i * x / (n - 1)).alias(a), (j * y / (n - 1)).alias(d))
    return grid.withColumn("predicted", F.exp(model.predict()))


def curve(spark: SparkSession, model: Lasso, low: float, n: int = 20) -> DataFrame:
    """Predictions of a one-feature fit along n even steps from ``low`` to its largest value."""
    f, x = model.features[0], model.maxima[0]
    return spark.range(n).select((low + F.col("id") * (x - low) / (n - 1)).alias(f)).withColumn("predicted", F.exp(model.predict()))


def with_and_without(rows: DataFrame, full: Lasso, plain: Lasso) -> DataFrame:
    """Both fits' predictions of the target and their difference, for rows of positive age."""
    return rows.where("age > 0").withColumns({"with_rivers": F.exp(full.predict()), "without_rivers": F.exp(plain.predict())}).withColumn("difference", F.col("with_rivers") - F.col("without_rivers"))
