"""Kriging: neighbours by cells, the small systems of a group solved together by numpy.

Spark brings the targets of a cell and the samples around it together; the
kernel solves all systems of equal size of a group at once, so neighbours never
leave the task that found them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import AXES, searched


def covariance(h: np.ndarray, model: dict) -> np.ndarray:
    """nugget + sill at 0, then the model's covariance; ``sill`` is partial."""
    r = h / model["range"]
    shape = {"spherical": lambda: np.where(r < 1, 1 - 1.5 * r + 0.5 * r**3, 0.0), "exponential": lambda: np.exp(-3 * r), "gaussian": lambda: np.exp(-3 * r * r)}[model.get("model", "spherical")]()
    return np.where(h <= 1e-12, model["nugget"] + model["sill"], model["sill"] * shape)


def _drift(points: np.ndarray, centre: np.ndarray, kind: str) -> np.ndarray:
    d = (points - centre) / np.maximum(np.abs(points - centre).max((-2, -3), keepdims=True), 1e-9) if kind != "none" else points
    one = np.ones((*points.shape[:-1], 1))
    if kind == "none":
        return one
    columns = [one, d]
    if kind == "quadratic":
        columns += [d * d, d[..., [0]] * d[..., [1]], d[..., [0]] * d[..., [2]], d[..., [1]] * d[..., [2]]]
    return np.concatenate(columns, -1)


def weights(targets: np.ndarray, points: np.ndarray, model: dict, kind: str, errors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and variances of m targets with n points each (m x n x 3)."""
    m, n, _ = points.shape
    between = covariance(np.linalg.norm(points[:, :, None] - points[:, None], axis=-1), model)
    between[:, np.arange(n), np.arange(n)] += 1e-10 * (model["nugget"] + model["sill"]) + (errors if errors is not None else 0.0)
    to = covariance(np.linalg.norm(points - targets[:, None], axis=-1), model)
    total = model["nugget"] + model["sill"]
    if kind == "simple":
        w = np.linalg.solve(between, to[..., None])[..., 0]
        return w, np.maximum(total - (w * to).sum(1), 0.0)
    base = _drift(np.concatenate([points, targets[:, None]], 1), targets[:, None], {"ordinary": "none", "universal": "linear", "quadratic": "quadratic"}[kind])
    p = base.shape[-1]
    left = np.zeros((m, n + p, n + p))
    left[:, :n, :n], left[:, :n, n:] = between, base[:, :n]
    left[:, n:, :n] = base[:, :n].transpose(0, 2, 1)
    right = np.concatenate([to, base[:, n]], 1)
    w = np.linalg.lstsq(left[0], right[0], rcond=None)[0][None] if m == 1 else None
    if w is None:
        try:
            w = np.linalg.solve(left, right[..., None])[..., 0]
        except np.linalg.LinAlgError:
            w = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(left, right)])
    return w[:, :n], np.maximum(total - (w * right).sum(1), 0.0)


def solve(targets: np.ndarray, points: np.ndarray, values: np.ndarray, model: dict, kind: str, mean: float | None, errors: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and variances of m targets from n points each."""
    w, variance = weights(targets, points, model, kind, errors)
    return (mean + (w * (values - mean)).sum(1) if kind == "simple" else (w * values).sum(1)), variance


def krige(targets: DataFrame, samples: DataFrame, value: str, model: dict, k: int = 12, target_id: str = "block_id", sample_id: str = "sample_id", kind: str = "ordinary", mean: float | None = None, start_radius: float | None = None, max_radius: float | None = None, least: int = 3, error: str | None = None, leave_out: bool = False, cutoffs: list[float] | None = None) -> DataFrame:
    """target_id, estimate, variance, n of every target; fewer than ``least`` neighbours give nulls.

    With ``cutoffs`` there is an estimate of value <= cutoff for each (p0, p1, ...)
    in place of one, from the same weights.

    kind: ordinary, simple (about ``mean``), universal (linear drift), quadratic.
    ``error`` names a column of measurement-error variances (soft data);
    ``leave_out`` leaves a sample of the target's id out (cross validation).
    """
    extra = [error] if error else []
    names = [f"p{i}" for i in range(len(cutoffs))] if cutoffs else ["estimate"]
    fine = samples.where(F.col(value).isNotNull())
    kind_of = targets.schema[target_id].dataType.simpleString()

    def emit(part, near, at, distance, found):
        place = near[list(AXES)].to_numpy(float)
        v, e = near[value].to_numpy(float), near[error].to_numpy(float) if error else None
        size = found.copy()
        if leave_out and len(part):  # the target's own sample, and else the one beyond k, goes
            own = (near["point"].to_numpy()[at] == part["target"].to_numpy()[:, None]) & np.isfinite(distance) if len(near) else np.zeros(at.shape, bool)
            at = np.take_along_axis(at, np.argsort(own, axis=1, kind="stable"), 1)[:, : k if at.shape[1] > k else at.shape[1]]
            size = np.minimum(found - own.any(1), k)
        where = part[list(AXES)].to_numpy(float)
        estimate, variance = np.full((len(names), len(part)), np.nan), np.full(len(part), np.nan)
        for n in np.unique(size[size >= least]):
            for some in np.array_split(np.flatnonzero(size == n), 1 + (size == n).sum() // 4096):
                pick = at[some, :n]
                w, variance[some] = weights(where[some], place[pick], model, kind, e[pick] if error else None)
                for row, c in zip(estimate, cutoffs or [None]):
                    known = v[pick] if c is None else (v[pick] <= c).astype(float)
                    row[some] = (mean + (w * (known - mean)).sum(1)) if kind == "simple" else (w * known).sum(1)
        return pd.DataFrame({"target": part["target"].to_numpy(), **dict(zip(names, estimate)), "variance": variance, "n": size.astype(np.int32)})

    done = searched(targets, fine, k + int(leave_out), start_radius, target_id, sample_id, [value, *extra], emit, f"target {kind_of}, {', '.join(f'{c} double' for c in names)}, variance double, n int", max_radius)
    value_or_null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    done = done.select(F.col("target").alias(target_id), *map(value_or_null, (*names, "variance")), "n")
    return targets.select(target_id).join(done, target_id, "left").fillna(0, ["n"])


def multi_pass(targets: DataFrame, samples: DataFrame, value: str, model: dict, passes: list[dict], target_id: str = "block_id", **settings) -> DataFrame:
    """Passes of search settings; each one takes the targets that the ones before left without an estimate."""
    left, out = targets, None
    for number, extra in enumerate(passes, 1):
        found = krige(left, samples, value, model, target_id=target_id, **{**settings, **extra}).withColumn("pass", F.lit(number))
        done = found.where("estimate is not null")
        out = done if out is None else out.unionByName(done)
        left = left.join(done.select(target_id), target_id, "left_anti")
    return targets.select(target_id).join(out, target_id, "left")


def indicator_kriging(targets: DataFrame, samples: DataFrame, value: str, cutoffs: list[float], model: dict, target_id: str = "block_id", **settings) -> DataFrame:
    """P(value <= cutoff) of every target and cutoff, order relations corrected (the mean of the running maximum and the reverse running minimum), and the mean of the distribution."""
    probabilities = krige(targets, samples, value, model, target_id=target_id, cutoffs=cutoffs, **settings)
    probabilities = probabilities.withColumns({f"p{k}": F.greatest(F.least(f"p{k}", F.lit(1.0)), F.lit(0.0)) for k in range(len(cutoffs))})
    p = [F.col(f"p{k}") for k in range(len(cutoffs))]
    up = [F.greatest(*p[: k + 1]) if k else p[0] for k in range(len(p))]
    down = [F.least(*p[k:]) if k < len(p) - 1 else p[k] for k in range(len(p))]
    fixed = [(u + d) / 2 for u, d in zip(up, down)]
    low, high = min(cutoffs), max(cutoffs)
    middles = [low, *((a + b) / 2 for a, b in zip(cutoffs, cutoffs[1:])), high]
    share = [fixed[0], *(b - a for a, b in zip(fixed, fixed[1:])), 1 - fixed[-1]]
    return probabilities.select(target_id, *(f.alias(f"p{k}") for k, f in enumerate(fixed)), sum((s * m for s, m in zip(share, middles)), F.lit(0.0)).alias("mean"))


def cross_validated(samples: DataFrame, value: str, model: dict, sample_id: str = "sample_id", **settings) -> DataFrame:
    """Leave-one-out: sample, actual, estimate, variance."""
    rows = krige(samples, samples.withColumnRenamed(sample_id, "_s"), value, model, target_id=sample_id, sample_id="_s", leave_out=True, **settings)
    return rows.join(samples.select(sample_id, F.col(value).alias("actual")), sample_id)


def collocated(targets: DataFrame, samples: DataFrame, value: str, secondary: str, model: dict, correlation: float, moments: tuple[float, float, float, float], k: int = 12, target_id: str = "block_id", sample_id: str = "sample_id", **search) -> DataFrame:
    """Collocated co-kriging (Markov model): standardised simple kriging of ``value`` with the target's own ``secondary``.

    ``moments`` are mean and deviation of the value and of the secondary.  The
    cross covariance is ``correlation`` times the correlogram, so a target's
    weights come from its neighbours alone and its secondary is joined after.
    """
    m1, s1, m2, s2 = moments
    sill = model["nugget"] + model["sill"]

    def emit(part, near, at, distance, found):
        place, v = near[list(AXES)].to_numpy(float), (near[value].to_numpy(float) - m1) / s1
        where, base, own = part[list(AXES)].to_numpy(float), np.zeros(len(part)), np.full(len(part), float(correlation))
        variance = np.full(len(part), 1 - correlation**2)
        for n in np.unique(found[found > 0]):
            for some in np.array_split(np.flatnonzero(found == n), 1 + (found == n).sum() // 4096):
                pick = at[some, :n]
                points = place[pick]
                left = np.ones((len(some), n + 1, n + 1))
                left[:, :n, :n] = covariance(np.linalg.norm(points[:, :, None] - points[:, None], axis=-1), model) / sill
                left[:, np.arange(n), np.arange(n)] += 1e-10
                to = covariance(np.linalg.norm(points - where[some][:, None], axis=-1), model) / sill
                left[:, :n, n] = left[:, n, :n] = correlation * to
                right = np.concatenate([to, np.full((len(some), 1), correlation)], 1)
                w = np.linalg.solve(left, right[..., None])[..., 0]
                base[some], own[some] = (w[:, :n] * v[pick]).sum(1), w[:, n]
                variance[some] = np.maximum(1 - (w * right).sum(1), 0.0)
        return pd.DataFrame({"target": part["target"].to_numpy(), "base": base, "own": own, "variance": variance * s1 * s1, "n": found.astype(np.int32)})

    kind = targets.schema[target_id].dataType.simpleString()
    done = searched(targets, samples.where(F.col(value).isNotNull()), k, search.get("start_radius"), target_id, sample_id, [value], emit, f"target {kind}, base double, own double, variance double, n int", search.get("max_radius"))
    both = targets.select(F.col(target_id).alias("target"), ((F.col(secondary) - m2) / s2).alias("_s")).join(done, "target")
    return both.select(F.col("target").alias(target_id), (m1 + s1 * (F.col("base") + F.col("own") * F.col("_s"))).alias("estimate"), "variance", "n")


#: Radial functions of distance and shape.
RADIAL = {"linear": lambda r, e: r, "cubic": lambda r, e: r**3, "gaussian": lambda r, e: np.exp(-((e * r) ** 2)), "multiquadric": lambda r, e: np.sqrt(1 + (e * r) ** 2)}


def radial(targets: DataFrame, samples: DataFrame, value: str, k: int = 20, function: str = "linear", shape: float = 1.0, smoothing: float = 0.0, target_id: str = "block_id", sample_id: str = "sample_id") -> DataFrame:
    """Local radial basis functions: each target's k nearest samples are interpolated exactly (but for the smoothing) and read at the target."""
    f = RADIAL[function]

    def emit(part, near, at, distance, found):
        place, v = near[list(AXES)].to_numpy(float), near[value].to_numpy(float)
        estimate = np.full(len(part), np.nan)
        for n in np.unique(found[found > 0]):
            for some in np.array_split(np.flatnonzero(found == n), 1 + (found == n).sum() // 4096):
                pick = at[some, :n]
                left = f(np.linalg.norm(place[pick][:, :, None] - place[pick][:, None], axis=-1), shape)
                left[:, np.arange(n), np.arange(n)] += smoothing
                try:
                    w = np.linalg.solve(left, v[pick][..., None])[..., 0]
                except np.linalg.LinAlgError:
                    w = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(left, v[pick])])
                estimate[some] = (w * f(distance[some, :n], shape)).sum(1)
        return pd.DataFrame({"target": part["target"].to_numpy(), "estimate": estimate, "n": found.astype(np.int32)})

    kind = targets.schema[target_id].dataType.simpleString()
    done = searched(targets, samples.where(F.col(value).isNotNull()), k, None, target_id, sample_id, [value], emit, f"target {kind}, estimate double, n int")
    return done.withColumnRenamed("target", target_id)
