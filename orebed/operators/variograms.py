"""Experimental variograms from bucketed pairs, and model fits.

Pairs of points are compared as matrices of bounded size, and only sums by lag
leave a group (:func:`spatial.tallied`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import table_hash
from .spatial import AXES, tallied


def _lagged(near: DataFrame, lags: int, width: float, tolerance: float | None) -> DataFrame:
    """Pairs with their lag: equal-width classes (0, w], (w, 2w], ... or, with a tolerance, centres k * width +- tolerance * width, to several of which a pair may belong."""
    if tolerance is None:
        return near.where("distance > 0").withColumn("lag", F.ceil(F.col("distance") / width)).where(F.col("lag") <= lags)
    low = F.greatest(F.ceil(F.col("distance") / width - tolerance), F.lit(1))
    high = F.least(F.floor(F.col("distance") / width + tolerance), F.lit(lags))
    return near.where(high >= low).withColumn("lag", F.explode(F.sequence(low, high)))


def _in_lags(distance: np.ndarray, lags: int, width: float, tolerance: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As :func:`_lagged`, of an array: places of pairs and their lags, in several parts where a pair may belong to several lags."""
    if tolerance is None:
        lag = np.ceil(distance / width)
        some = np.flatnonzero((distance > 0) & (lag <= lags))
        yield some, lag[some].astype(np.int64)
        return
    low = np.maximum(np.ceil(distance / width - tolerance), 1).astype(np.int64)
    high = np.minimum(np.floor(distance / width + tolerance), lags).astype(np.int64)
    for more in range(int((high - low).max(initial=-1)) + 1):
        some = np.flatnonzero(low + more <= high)
        yield some, low[some] + more


def _curve(points: DataFrame, point_id: str, values: list[str], lags: int, width: float, tolerance: float | None, gammas: Callable, names: list[str], inside: Callable | None = None, axes=AXES) -> DataFrame:
    """lag, pairs, distance (mean) and the means ``names`` of what ``gammas(first, second)`` gives for the two ends of pairs (arrays of each value)."""
    reach = lags * width if tolerance is None else (lags + tolerance) * width

    def tally(first: list, second: list, off: list, distance: np.ndarray, copies: np.ndarray) -> np.ndarray:
        if inside is not None:
            copies = np.where(inside(off, distance), copies, 0.0)
        rows = np.stack([np.ones(len(distance)), distance, *gammas(first, second)])
        sums = np.zeros((len(rows), lags + 1))
        for some, lag in _in_lags(distance, lags, width, tolerance):
            some, lag = (x[copies[some] > 0] for x in (some, lag))
            sums += [np.bincount(lag, row[some] * copies[some], lags + 1) for row in rows]
        return sums

    known = points.where(" and ".join(f"`{v}` is not null" for v in values))
    sums = tallied(known, reach, point_id, values, tally, ["_n", "_d", *names], axes)
    return sums.select("lag", F.col("_n").cast("long").alias("pairs"), (F.col("_d") / F.col("_n")).alias("distance"), *((F.col(n) / F.col("_n")).alias(n) for n in names))


def experimental(points: DataFrame, point_id: str, value: str, lags: int, width: float, tolerance: float | None = None, inside: Callable | None = None, axes=AXES) -> DataFrame:
    """lag, distance (mean), gamma (half the mean squared difference), pairs.

    ``inside(off, distance)`` may tell which pairs count, from arrays of their
    components along the axes and of their distances.
    """
    half = lambda first, second: [(first[0] - second[0]) ** 2 / 2]
    return _curve(points, point_id, [value], lags, width, tolerance, half, ["gamma"], inside, axes).select("lag", "distance", "gamma", "pairs")


def cone(azimuth: float, dip: float, tolerance: float, bandwidth: float | None = None) -> Callable:
    """Which pairs lie along a direction, either way: within an angle and, if given, a distance of the axis."""
    a, d = math.radians(azimuth), math.radians(dip)
    axis = (math.sin(a) * math.cos(d), math.cos(a) * math.cos(d), math.sin(d))

    def inside(off: list, distance: np.ndarray) -> np.ndarray:
        along = np.abs(sum(c * v for c, v in zip(off, axis)))
        out = along >= distance * math.cos(math.radians(tolerance))
        if bandwidth is not None:
            out &= np.sqrt(np.maximum(distance * distance - along * along, 0.0)) <= bandwidth
        return out

    return inside


def directional(points: DataFrame, point_id: str, value: str, lags: int, width: float, azimuth: float, dip: float = 0.0, angle: float = 22.5, bandwidth: float | None = None) -> DataFrame:
    return experimental(points, point_id, value, lags, width, inside=cone(azimuth, dip, angle, bandwidth))


def cross(points: DataFrame, point_id: str, one: str, two: str, lags: int, width: float) -> DataFrame:
    """Half the mean product of the two variables' differences."""
    product = lambda first, second: [(first[0] - second[0]) * (first[1] - second[1]) / 2]
    return _curve(points, point_id, [one, two], lags, width, None, product, ["gamma"]).select("lag", "distance", "gamma", "pairs")


def indicator(points: DataFrame, point_id: str, value: str, cutoffs: list[float], lags: int, width: float) -> DataFrame:
    """A variogram of value <= cutoff for each cutoff, from one pass over the pairs."""
    half = lambda first, second: [((first[0] <= c) != (second[0] <= c)) * 0.5 for c in cutoffs]
    near = _curve(points, point_id, [value], lags, width, None, half, [f"_g{k}" for k in range(len(cutoffs))])
    table = F.array(*(F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"_g{k}").alias("gamma")) for k, c in enumerate(cutoffs)))
    return near.select("lag", "pairs", F.inline(table))


def downhole(intervals: DataFrame, value: str, lags: int, width: float) -> DataFrame:
    """Pairs inside a hole by the distance of their middles; joined on hole and depth class, so a long hole does not meet itself whole."""
    mid = (F.col("depth_from") + F.col("depth_to")) / 2
    reach = lags * width
    rows = intervals.where(F.col(value).isNotNull()).select("hole_id", mid.alias("m"), "depth_from", "depth_to", F.col(value).alias("v")).withColumn("c", F.floor(F.col("m") / reach))
    left = rows.withColumn("c", F.explode(F.array(F.col("c"), F.col("c") + 1))).withColumnsRenamed({"m": "m_i", "v": "v_i", "depth_from": "f_i", "depth_to": "t_i"})
    near = left.join(rows, ["hole_id", "c"]).where((F.col("m_i") < F.col("m"))).withColumn("distance", F.col("m") - F.col("m_i")).where(F.col("distance") <= reach)
    half = (F.col("v_i") - F.col("v")) * (F.col("v_i") - F.col("v")) / 2
    return _lagged(near, lags, width, None).groupBy("lag").agg(F.avg("distance").alias("distance"), F.avg(half).alias("gamma"), F.count(F.lit(1)).alias("pairs"))


def fitted(curve: DataFrame, model: str = "spherical", ranges: int = 60) -> dict[str, float]:
    """nugget, sill (partial), range by weighted least squares: a search over ranges, the other two solved from the normal equations.

    ``curve`` has one row a lag; the sums for all ranges are one aggregation.
    """
    from ..functions.variogram import MODELS

    longest = curve.agg(F.max("distance")).first()[0]
    if longest is None:
        return {}
    tries = [longest * (k + 1) / ranges * 1.5 for k in range(ranges)]
    shape = lambda r: MODELS[model](F.col("distance"), r, 1.0)
    w, g = F.col("pairs").cast("double"), F.col("gamma")
    sums = curve.agg(*(F.sum(e).alias(f"{n}{k}") for k, r in enumerate(tries) for n, e in (("w", w), ("s", w * shape(r)), ("q", w * shape(r) * shape(r)), ("g", w * g), ("t", w * g * shape(r)), ("y", w * g * g)))).first()
    best = None
    for k, r in enumerate(tries):
        s0, s1, s2, g0, g1, gg = (sums[f"{n}{k}"] for n in "wsqgty")
        det = s0 * s2 - s1 * s1
        sill = (s0 * g1 - s1 * g0) / det if det > 1e-12 * s0 * s2 else g1 / max(s2, 1e-300)
        nugget = (g0 - sill * s1) / s0
        if nugget < 0:
            nugget, sill = 0.0, g1 / s2
        if sill < 0:
            nugget, sill = g0 / s0, 0.0
        error = gg - 2 * nugget * g0 - 2 * sill * g1 + nugget * nugget * s0 + 2 * nugget * sill * s1 + sill * sill * s2
        if best is None or error < best[0]:
            best = (error, nugget, sill, r)
    return {"nugget": best[1], "sill": best[2], "range": best[3]}


#: Models of sill 1 by distance over range.
SHAPES = {
    "spherical": lambda r: np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0),
    "exponential": lambda r: 1 - np.exp(-3 * r),
    "gaussian": lambda r: 1 - np.exp(-3 * r * r),
    "linear": lambda r: np.minimum(r, 1.0),
}


def _least(moments: np.ndarray, right: np.ndarray, square: float) -> tuple[float, np.ndarray]:
    """Least weighted squares with no negative coefficient: the error and the coefficients of the best of all sets of columns that come out positive."""
    best, n = (square, np.zeros(len(right))), len(right)
    for size in range(1, n + 1):
        for some in combinations(range(n), size):
            own = moments[np.ix_(some, some)]
            if np.linalg.det(own) <= 1e-10 * np.prod(np.diag(own)):
                continue
            found = np.linalg.solve(own, right[list(some)])
            error = square - right[list(some)] @ found
            if (found >= 0).all() and error < best[0] - 1e-9 * abs(square):
                full = np.zeros(n)
                full[list(some)] = found
                best = (error, full)
    return best


def nested_ranges(longest: float, tries: int) -> list[float]:
    """The grid of ranges: equal steps to one and a half times the longest lag."""
    return [1.5 * longest * (k + 1) / tries for k in range(tries)]


def fitted_nested(curve: DataFrame, models: tuple[str, ...] = ("spherical", "spherical"), tries: int = 12, nugget: float | None = None) -> list[dict]:
    """A nugget and one structure a model, the ranges increasing: dictionaries of structure (0: the nugget), model, range and sill.

    Weighted (by pairs) least squares of the experimental curve: ranges on a
    grid, and for each combination of ranges the non-negative sills in closed
    form.  The moments of all combinations come from one aggregation of the curve
    (columns distance, gamma, pairs); what is compared on the driver are
    (models * tries) squared numbers, however long the curve is.  Errors that
    agree to 1e-9 of the whole count as equal; the smaller ranges win then.  A
    given ``nugget`` is held; fewer lags than coefficients leave sills at 0; an
    empty curve gives an empty list.
    """
    rows = curve.where(F.col("distance").isNotNull() & F.col("gamma").isNotNull() & (F.col("pairs") > 0))
    longest = rows.agg(F.max("distance")).first()[0]
    if not longest:
        return []
    ranges = nested_ranges(float(longest), tries)
    held, n = nugget or 0.0, 1 + len(models) * tries

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            h, w, g = (part[c].to_numpy(float) for c in ("distance", "pairs", "gamma"))
            columns = np.stack([g - held, np.ones(len(h)), *(SHAPES[m](h / a) for m in models for a in ranges)])
            yield pd.DataFrame({"at": np.arange((n + 1) ** 2), "v": ((columns * w) @ columns.T).ravel()})

    sums = np.zeros((n + 1) ** 2)
    for r in rows.select("distance", "gamma", "pairs").mapInPandas(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r["v"]
    sums = sums.reshape(n + 1, n + 1)
    square, right, moments = sums[0, 0], sums[0, 1:], sums[1:, 1:]
    best = None
    for chosen in combinations(range(tries), len(models)):
        at = [*([0] if nugget is None else []), *(1 + m * tries + a for m, a in enumerate(chosen))]
        error, found = _least(moments[np.ix_(at, at)], right[at], square)
        if best is None or error < best[0] - 1e-9 * square:
            best = (error, found, chosen)
    sills = [float(v) for v in best[1]] if nugget is None else [float(nugget), *map(float, best[1])]
    return [{"structure": 0, "model": "nugget", "range": 0.0, "sill": sills[0]}, *({"structure": k + 1, "model": m, "range": ranges[a], "sill": s} for k, (m, a, s) in enumerate(zip(models, best[2], sills[1:])))]


def short_nuggets(intervals: DataFrame, value: str, by: list[str], hole: str = "hole_id") -> DataFrame:
    """by, nugget, pairs: half the mean squared difference of a hole's neighbouring intervals of one group, the shortest lag there is."""
    order = Window.partitionBy(hole, *by).orderBy("depth_from", "depth_to")
    step = F.col(value) - F.lag(value).over(order)
    rows = intervals.where(F.col(value).isNotNull()).select(*by, step.cast("double").alias("_d")).where("_d is not null")
    return rows.groupBy(*by).agg((F.avg(F.col("_d") * F.col("_d")) / 2).alias("nugget"), F.count(F.lit(1)).alias("pairs"))


def gates(fits: DataFrame, data: DataFrame, columns: list[str], source: DataFrame | None = None, nugget: float | None = None, tolerance: float = 3.0) -> DataFrame:
    """One row that tells whether a variogram may be used on data.

    ``fits`` has the nugget of each direction or domain.  nuggets, least,
    greatest, median and ratio are over those known (0, and a ratio of 1, where
    there are none); ``consistent`` asks that the greatest be at most
    ``tolerance`` times the least, and is false where the least is 0.  ``lineage``
    compares the rows that have all ``columns`` with ``source``, the
    :func:`selection.table_hash` of those of which the variogram was made, in any
    order of rows; without it there is nothing to compare, which passes.
    ``nugget`` is the given one, else the median.
    """
    known = F.when(~F.isnan("nugget"), F.col("nugget").cast("double"))
    found = fits.agg(F.count(known).alias("nuggets"), F.coalesce(F.min(known), F.lit(0.0)).alias("least"), F.coalesce(F.max(known), F.lit(0.0)).alias("greatest"), F.coalesce(F.median(known), F.lit(0.0)).alias("median"))
    ratio = F.when(F.col("nuggets") == 0, 1.0).when(F.col("least") > 1e-9, F.col("greatest") / F.col("least")).otherwise(float("inf"))
    found = found.withColumn("ratio", ratio).withColumn("consistent", F.col("ratio") <= tolerance)
    if source is None:
        found = found.withColumn("lineage", F.lit(True))
    else:
        own = table_hash(data.dropna(subset=columns), columns).select(F.struct("n", "hash").alias("_own"))
        made = source.select(F.struct("n", "hash").alias("_made"))
        found = found.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(made)).withColumn("lineage", F.col("_own").eqNullSafe(F.col("_made"))).drop("_own", "_made")
    chosen = F.col("median") if nugget is None else F.lit(float(nugget))
    return found.withColumns({"nugget": chosen, "passed": F.col("consistent") & F.col("lineage")})
