"""Planes through points: contacts of formations, neighbourhoods of contacts, clusters of residuals.

The plane of a group comes from the covariances of its coordinates, one
aggregation; the small matrices are solved in batches.  Neighbourhoods are solved
where the neighbour search finds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import density_clusters
from .spatial import AXES, searched
from .stored import written

#: Planarity of what counts as a plane, and the discount of planes through holes' means.
CONFIDENCE, CROSS_HOLE, CROSS_LEAST, LOCAL = 0.25, 0.8, 0.2, 0.6


def smallest_axes(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each symmetric 3 x 3 matrix the eigenvector of the smallest eigenvalue (upward) and the planarity 1 - smallest / middle, 0 to 1; planarity 0 where the points lie on a line or a spot."""
    values, vectors = np.linalg.eigh(matrices)
    normal = vectors[:, :, 0] * np.where(vectors[:, 2, 0] < 0, -1.0, 1.0)[:, None]
    flat = values[:, 1] > 1e-10 * values.sum(1)
    return normal, np.where(flat, np.clip(1 - values[:, 0] / np.where(flat, values[:, 1], 1.0), 0, 1), 0.0)


def dip_of(gx: Column, gy: Column, gz: Column) -> list[Column]:
    """Dip and dip direction of an upward normal."""
    return [F.degrees(F.acos(F.greatest(F.least(gz, F.lit(1.0)), F.lit(-1.0)))), F.pmod(F.degrees(F.atan2(gx, gy)), F.lit(360.0))]


def fitted_planes(points: DataFrame, by: list[str], least: int = 3, *more: Column) -> DataFrame:
    """by, n, cx, cy, cz (centre), gx, gy, gz (upward unit normal), confidence of each group of at least ``least`` points; further aggregates are kept."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = points.where(" and ".join(f"{a} is not null" for a in AXES)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"c{a}") for a in AXES), *more, *(F.covar_pop(AXES[i], AXES[j]).alias(f"_{i}{j}") for i, j in pairs))
    sums = sums.where(F.col("n") >= max(3, least))
    kept = [c for c in sums.columns if c not in {f"_{i}{j}" for i, j in pairs}]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            m = np.zeros((len(rows), 3, 3))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = rows[f"_{i}{j}"]
            normal, planar = smallest_axes(m)
            yield rows[kept].assign(**{f"g{a}": v for a, v in zip(AXES, normal.T)}, confidence=planar)

    schema = ", ".join(f"`{c}` {t}" for c, t in sums.dtypes if c in kept)
    return sums.mapInPandas(solve, f"{schema}, gx double, gy double, gz double, confidence double")


def boundary_gradients(contacts: DataFrame, formation: str = "formation", least: int = 3, confidence: float = CONFIDENCE) -> DataFrame:
    """The plane of a formation's contacts, at every contact: x, y, z, gx, gy, gz, formation, confidence, source."""
    planes = fitted_planes(contacts, [formation], least).where(F.col("confidence") >= confidence)
    return contacts.select(*AXES, formation).join(F.broadcast(planes.select(formation, "gx", "gy", "gz", "confidence")), formation).select(*AXES, "gx", "gy", "gz", F.col(formation).alias("formation"), "confidence", F.lit("boundary").alias("source"))


def sequence_gradients(contacts: DataFrame, ranks: DataFrame, hole: str = "hole_id", formation: str = "formation") -> DataFrame:
    """Directions between a hole's consecutive contacts from the older to the younger formation (``ranks``: formation, rank), at both contacts and half way; confidence 0.5 for a flat hole to 1 for a vertical one."""
    order = Window.partitionBy(hole).orderBy("z", "x", "y", formation)
    rows = contacts.select(hole, *AXES, formation).join(F.broadcast(ranks.select(formation, "rank")), formation, "left")
    rows = rows.withColumns({f"n_{c}": F.lead(c).over(order) for c in (*AXES, "rank", formation)})
    step = {a: F.col(f"n_{a}") - F.col(a) for a in AXES}
    far = F.sqrt(sum((d * d for d in step.values()), F.lit(0.0)))
    rows = rows.withColumn("_far", far).where((F.col("_far") >= 1e-6) & (F.abs(F.col("n_rank") - F.col("rank")) >= 1e-10))
    sign = F.signum(F.col("n_rank") - F.col("rank"))
    spots = F.array(*(F.struct(*((F.col(a) + step[a] * t).alias(f"p{a}") for a in AXES)) for t in (0.0, 0.5, 1.0)))
    rows = rows.withColumns({**{f"g{a}": step[a] / F.col("_far") * sign for a in AXES}, "confidence": 0.5 + 0.5 * F.abs(step["z"]) / F.col("_far"), "_p": F.explode(spots)})
    return rows.select(*(F.col("_p")[f"p{a}"].alias(a) for a in AXES), "gx", "gy", "gz", F.col(f"n_{formation}").alias("formation"), "confidence", F.lit("hole").alias("source"))


def cross_hole_gradients(contacts: DataFrame, hole: str = "hole_id", formation: str = "formation", least: int = 3) -> DataFrame:
    """The plane of the mean contacts of a formation's holes, at those means; confidence at a discount."""
    means = contacts.groupBy(formation, hole).agg(*(F.avg(a).alias(a) for a in AXES))
    planes = fitted_planes(means, [formation], least).where(F.col("confidence") >= CROSS_LEAST)
    return means.join(F.broadcast(planes.select(formation, "gx", "gy", "gz", "confidence")), formation).select(*AXES, "gx", "gy", "gz", F.col(formation).alias("formation"), (F.col("confidence") * CROSS_HOLE).alias("confidence"), F.lit("cross hole").alias("source"))


def local_gradients(contacts: DataFrame, contact_id: str, k: int = 10, formation: str = "formation", least: int = 3, confidence: float = CONFIDENCE) -> DataFrame:
    """contact_id, x, y, z, gx, gy, gz, formation, confidence: the plane of the k nearest other contacts of a contact's formation.

    A formation of at most k contacts gets one plane, at its centre (contact_id
    null); one of fewer than ``least`` none.  Formations are set apart along x, so
    that one search serves all; a formation has a row in what sets them apart.
    """
    rows = contacts.select(contact_id, *(F.col(a).cast("double").alias(a) for a in AXES), formation).where(" and ".join(f"{a} is not null" for a in AXES))
    box = rows.agg(*(f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    gap = 2 * sum((box[f"hi{a}"] - box[f"lo{a}"]) ** 2 for a in AXES) ** 0.5 + 1.0 if box["lox"] is not None else 1.0
    sizes = written(rows.groupBy(formation).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k).withColumn("_turn", F.row_number().over(Window.orderBy(formation))), "formations")
    apart = rows.join(F.broadcast(sizes), formation).withColumn("x", F.col("x") + F.col("_turn") * gap)

    def emit(part, near, at, distance, found):
        out = np.full((len(part), 4), np.nan)
        if len(part) and len(near):
            own = near["point"].to_numpy()[at] == part["target"].to_numpy()[:, None]
            own[np.arange(len(at)), np.where(own.any(1), own.argmax(1), at.shape[1] - 1)] = True  # without its own among equals, the last goes
            pick = np.take_along_axis(at, np.argsort(own, axis=1, kind="stable"), 1)[:, :k]
            place = near[list(AXES)].to_numpy(float)[pick]
            off = place - place.mean(1, keepdims=True)
            out[:, :3], out[:, 3] = smallest_axes(np.einsum("mki,mkj->mij", off, off) / k)
        return pd.DataFrame({"target": part["target"].to_numpy(), **dict(zip(("gx", "gy", "gz", "confidence"), out.T))})

    kind = contacts.schema[contact_id].dataType.simpleString()
    found = searched(apart, apart.withColumnRenamed(contact_id, "_point"), k + 1, None, contact_id, "_point", [], emit, f"target {kind}, gx double, gy double, gz double, confidence double")
    local = rows.join(found.withColumnRenamed("target", contact_id), contact_id).where(F.col("confidence") >= confidence)
    small = rows.join(F.broadcast(sizes.select(formation)), formation, "left_anti")
    whole = fitted_planes(small, [formation], least).where(F.col("confidence") >= confidence)
    names = [contact_id, *AXES, "gx", "gy", "gz", F.col(formation).alias("formation"), "confidence"]
    return local.select(*names).unionByName(whole.select(F.lit(None).cast(kind).alias(contact_id), *(F.col(f"c{a}").alias(a) for a in AXES), *names[4:]))


_ORDER = ("boundary", "hole", "cross hole", "local")


def contact_gradients(contacts: DataFrame, ranks: DataFrame, contact_id: str, hole: str | None = "hole_id", formation: str = "formation", least: int = 3, confidence: float = CONFIDENCE, k: int | None = None) -> DataFrame:
    """One gradient a place: x, y, z, gx, gy, gz, formation, confidence, source.

    Planes of formations; with ``hole``, directions down holes and, from three
    holes on, planes across them; with ``k``, planes of neighbourhoods at
    confidence 0.6.  Of several at one place the most confident stays, of equally
    confident ones the source named first here, then the formation and the normal.
    """
    rows = contacts.join(F.broadcast(ranks.select(formation)), formation, "left_semi")
    parts = [boundary_gradients(rows, formation, least, confidence)]
    if hole:
        parts.append(sequence_gradients(contacts, ranks, hole, formation))
        if contacts.select(hole).distinct().limit(3).count() == 3:
            parts.append(cross_hole_gradients(rows, hole, formation, least))
    if k:
        parts.append(local_gradients(rows, contact_id, k, formation, least).drop(contact_id).withColumns({"confidence": F.lit(LOCAL), "source": F.lit("local")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    turn = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("source"))
    best = Window.partitionBy(*AXES).orderBy(F.desc("confidence"), turn, "formation", "gx", "gy", "gz")
    return out.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def potential_faults(misfits: DataFrame, point_id: str, residual: str, threshold: float, radius: float, least: int = 5, confidence: float = 0.5) -> DataFrame:
    """fault (from 1, by cluster), cluster, n, cx, cy, cz, dip, dip_direction, confidence, mean_misfit of the clusters of large residuals that lie in a plane.

    Points whose residual exceeds the threshold are clustered by density; fewer
    than ``least`` of them give no row.
    """
    high = written(misfits.where(F.col(residual) > threshold).select(point_id, *AXES, F.col(residual).cast("double").alias("_misfit")), "misfits")
    clusters = density_clusters(high, point_id, radius, least).where("cluster != -1")
    planes = fitted_planes(high.join(clusters, point_id), ["cluster"], 3, F.avg("_misfit").alias("mean_misfit")).where(F.col("confidence") >= confidence)
    dip, direction = dip_of(*(F.col(f"g{a}") for a in AXES))
    return planes.select(F.row_number().over(Window.orderBy("cluster")).alias("fault"), "cluster", "n", "cx", "cy", "cz", dip.alias("dip"), direction.alias("dip_direction"), "confidence", "mean_misfit")
