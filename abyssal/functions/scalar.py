"""Scalar formulas as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii of the Earth in kilometres and the compaction of shale.
MEAN_RADIUS_KM = 6371.009
EQUATORIAL_RADIUS_KM = 6378.137
SHALE_POROSITY = 0.63
SHALE_DECAY = 5.71e-4


@dataclass(frozen=True)
class CubicModel:
    """A cubic in standardised age and distance that gives the log of its target."""

    mean_age: float
    mean_distance: float
    variance_age: float
    variance_distance: float
    coefficients: tuple[float, ...]
    max_age: float | None = 191.87276
    max_distance: float | None = 3000.0
    scale: float = 1.0


#: The published fits. The rate's unit is metres per million years; ``RATE_TIMES_TEN`` scales as the published driver does.
THICKNESS = CubicModel(
    61.18406823, 1835.28118479, 1934.6999014, 1207521.8995806,
    (5.441401190368497, 0.46893096, -0.07320928, -0.24077496, -0.10840657, 0.00381672, 0.06831728, 0.01179914, 0.01158149, -0.39880562),
)
RATE = CubicModel(
    61.17716597, 1835.10750592, 1934.78513885, 1207587.8548734,
    (1.350082937086441, -0.26385415, -0.07516542, 0.39197707, -0.15475392, 0.0, -0.13196083, 0.02481208, -0.0, -0.47570021),
)
RATE_TIMES_TEN = CubicModel(RATE.mean_age, RATE.mean_distance, RATE.variance_age, RATE.variance_distance, RATE.coefficients, scale=10.0)


def cubic_terms(a: Column, d: Column) -> list[Column]:
    """The ten terms of a cubic in two variables, by degree, then by falling power of the first."""
    return [F.lit(1.0), a, d, a * a, a * d, d * d, a * a * a, a * a * d, a * d * d, d * d * d]


def predict(age: Column, distance: Column, model: CubicModel) -> Column:
    """The model's target; ages and distances are expected clamped and not NaN."""
    a = (age - model.mean_age) / F.sqrt(F.lit(model.variance_age))
    d = (distance - model.mean_distance) / F.sqrt(F.lit(model.variance_distance))
    log = sum((F.lit(c) * t for c, t in zip(model.coefficients, cubic_terms(a, d))), F.lit(0.0))
    return F.exp(log) * model.scale


def clamp(value: Column, most: float | None) -> Column:
    return value if most is None else F.least(value, F.lit(most))


def decompacted(thickness: Column, porosity: float = SHALE_POROSITY, decay: float = SHALE_DECAY) -> Column:
    """Thickness that the solid part would have uncompacted at the surface porosity."""
    return (thickness + porosity / decay * F.expm1(-decay * thickness)) / (1 - porosity)


def average_rate(thickness: Column, age: Column) -> Column:
    """Decompacted thickness over age, which counts as one at least."""
    return decompacted(thickness) / F.greatest(age, F.lit(1.0))


def inverse_or_zero(distance: Column, most: float = 1500.0) -> Column:
    """1/d for distances up to ``most``; farther or missing ones give 0, a distance of 0 infinity."""
    far = F.isnan(distance) | (distance > most)
    return F.when(far, F.lit(0.0)).when(distance == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.when(distance != 0, distance))


def weighted_inverse_sum(distances: Column, weights: list[float], most: float = 1500.0) -> Column:
    """Sum of weight over distance, element by element."""
    terms = F.zip_with(distances, F.lit(weights).cast("array<double>"), lambda d, w: inverse_or_zero(d.cast("double"), most) * w)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


#: Weights of the thirteen rivers in the rate and thickness fits.
RIVER_WEIGHTS_RATE = [0.414269, 0.481972, 0.434731, 0.587118, 0.0604029, 0.490885, 0.333003, 1.28889, 3.86078, 0.230872, 0.681036, 0.185918, 0.270061]
RIVER_WEIGHTS_THICKNESS = [0.328132, 0.304746, 3.15865, 0.850226, 0.152214, 0.830894, 0.14374, 0.876985, 0.666173, 0.150999, 0.576572, 0.325158, 0.660374]


def normal_velocity(speed_cm: Column, obliquity_deg: Column) -> Column:
    """Convergence along the trench normal in metres a year; diverging is negative."""
    return 0.01 * F.abs(speed_cm) * F.cos(F.radians(obliquity_deg))


def signed_obliquity(angle_deg: Column, along_clockwise: Column) -> Column:
    """Angle between velocity and normal, negative for the anticlockwise side."""
    return F.when(along_clockwise < 0, -angle_deg).otherwise(angle_deg)


def signed_speed(speed: Column, obliquity_deg: Column, absolute: bool) -> Column:
    """Convergence is negative beyond 90 degrees, absolute motion below them."""
    flip = F.abs(obliquity_deg) < 90 if absolute else F.abs(obliquity_deg) > 90
    return F.when(speed == 0, F.lit(0.0)).when(flip, -speed).otherwise(speed)


def normal_sign(polarity: Column) -> Column:
    return F.when(polarity == "Left", F.lit(1.0)).otherwise(F.lit(-1.0))
