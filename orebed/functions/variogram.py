"""Variogram models as column expressions; ``sill`` is the partial sill everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def spherical(h: Column, range_, sill, nugget=0.0) -> Column:
    r = h / _lit(range_)
    body = F.when(r >= 1, F.lit(1.0)).otherwise(1.5 * r - 0.5 * r * r * r)
    return F.when(h <= 0, F.lit(0.0)).otherwise(_lit(nugget) + _lit(sill) * body)


def exponential(h: Column, range_, sill, nugget=0.0) -> Column:
    return F.when(h <= 0, F.lit(0.0)).otherwise(_lit(nugget) + _lit(sill) * (1 - F.exp(-3 * h / _lit(range_))))


def gaussian(h: Column, range_, sill, nugget=0.0) -> Column:
    r = h / _lit(range_)
    return F.when(h <= 0, F.lit(0.0)).otherwise(_lit(nugget) + _lit(sill) * (1 - F.exp(-3 * r * r)))


def linear(h: Column, range_, sill, nugget=0.0) -> Column:
    return F.when(h <= 0, F.lit(0.0)).otherwise(_lit(nugget) + _lit(sill) * F.least(h / _lit(range_), F.lit(1.0)))


def pure_nugget(h: Column, nugget) -> Column:
    return F.when(h <= 0, F.lit(0.0)).otherwise(_lit(nugget))


def power(h: Column, coefficient, exponent, nugget=0.0) -> Column:
    return F.when(h <= 0, F.lit(0.0)).otherwise(_lit(nugget) + _lit(coefficient) * F.pow(h, _lit(exponent)))


MODELS = {"spherical": spherical, "exponential": exponential, "gaussian": gaussian, "linear": linear}


def covariance(h: Column, model: str, range_, sill, nugget=0.0) -> Column:
    """C(h) = C(0) - gamma(h); C(0) is nugget + sill."""
    return _lit(nugget) + _lit(sill) - MODELS[model](h, range_, sill, nugget)


def anisotropic_distance(dx: Column, dy: Column, dz: Column, range_x, range_y, range_z) -> Column:
    """Distance in units of the ranges."""
    return F.sqrt(F.pow(dx / _lit(range_x), 2) + F.pow(dy / _lit(range_y), 2) + F.pow(dz / _lit(range_z), 2))
