"""Structural data: rose diagrams, Fisher statistics, sets, kinematics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .stored import written


def rose(df: DataFrame, direction: Column, bins: int, is_axial: bool = False, weight: Column | None = None) -> DataFrame:
    """Counts (or weights) in equal bins of 360 degrees; axial data fill both halves alike. Empty bins stay."""
    width = 360.0 / bins
    d = F.pmod(direction, F.lit(180.0 if is_axial else 360.0))
    half = bins // 2 if is_axial else bins
    rows = df.where(direction.isNotNull()).groupBy(F.least(F.floor(d / width), F.lit(half - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight if weight is not None else F.lit(1.0)).alias("weight"))
    if is_axial:
        rows = rows.withColumn("bin", F.explode(F.array(F.col("bin"), F.col("bin") + half)))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(rows), "bin", "left").select("bin", (F.col("bin") * width).alias("from_degrees"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def circular(df: DataFrame, direction: Column, is_axial: bool = False, weight: Column | None = None) -> DataFrame:
    """Mean direction, resultant length, circular variance, Rayleigh's statistic and p (0 and 1 for fewer than two directions)."""
    k = 2.0 if is_axial else 1.0
    w = weight if weight is not None else F.lit(1.0)
    a = F.radians(direction * k)
    out = df.where(direction.isNotNull()).agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.cos(a)) / F.sum(w)).alias("_c"), (F.sum(w * F.sin(a)) / F.sum(w)).alias("_s"))
    r = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    z = F.col("n") * r * r
    n = F.col("n").cast("double")
    p = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288 * n * n))
    few = F.col("n") < 2
    return out.select("n", (F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)) / k).alias("mean"), r.alias("resultant"), (1 - r).alias("variance"), F.when(few, 0.0).otherwise(z).alias("rayleigh_z"), F.when(few, 1.0).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))).alias("rayleigh_p"))


def fisher(df: DataFrame, x: str, y: str, z: str, by: list[str] | None = None) -> DataFrame:
    """Mean unit vector (straight down without one) with its dip and dip direction, resultant length, concentration, 95 and 99 % cones, dispersion and variance of unit normals.

    The concentration is R (3 - R^2) / (1 - R^2) of the mean resultant length R,
    less 2 / n for fewer than ten; 0 for one normal or hardly any direction, 1000
    for hardly any spread.  The cone is 180 degrees for one normal or no direction.
    """
    out = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(z).alias("_z"))
    r = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    out = out.withColumn("resultant", r)
    n, big = F.col("n"), F.col("resultant")
    lost, bar = big < 1e-10, big / n
    mean = {c: F.when(lost, F.lit(-1.0 if c == "z" else 0.0)).otherwise(F.col(f"_{c}") / big) for c in "xyz"}

    def cone(outside: float) -> Column:
        angle = F.degrees(F.acos(F.greatest(F.least(1 - (n - big) / big * (F.pow(F.lit(1 / outside), 1 / (n - 1)) - 1), F.lit(1.0)), F.lit(-1.0))))
        return F.when((n < 2) | lost, F.lit(180.0)).otherwise(angle)

    likely = bar * (3 - bar * bar) / (1 - bar * bar)
    kappa = F.when((n < 2) | (bar < 0.001), 0.0).when(bar >= 0.9999, 1000.0).when(n < 10, F.greatest(likely - 2 / n, F.lit(0.0))).otherwise(likely)
    dip, direction = G.dip_and_direction(*mean.values())
    return out.select(*(by or []), "n", *(m.alias(f"mean_{c}") for c, m in mean.items()), dip.alias("mean_dip"), direction.alias("mean_dip_direction"), "resultant", kappa.alias("kappa"), cone(0.05).alias("cone_95"), cone(0.01).alias("cone_99"), F.degrees(F.acos(F.least(bar, F.lit(1.0)))).alias("dispersion"), (1 - bar).alias("variance"))


def density(poles: DataFrame, grid: DataFrame, kappa: float, steps: int | None = None) -> DataFrame:
    """Mean von Mises-Fisher kernel of poles (x, y, z) at the vectors of a grid (id, gx, gy, gz); poles are axes.

    The poles are first summed by direction to ``1 / steps`` of a component, so
    that what meets the grid is bounded by the sphere and not by their number;
    ``steps`` None keeps every pole as it is.
    """
    dot = F.abs(F.col("x") * F.col("gx") + F.col("y") * F.col("gy") + F.col("z") * F.col("gz"))
    scale = kappa / (4 * math.pi * math.sinh(kappa)) if kappa < 300 else kappa / (2 * math.pi)
    value = F.lit(scale) * F.exp(kappa * dot) if kappa < 300 else F.lit(scale) * F.exp(kappa * (dot - 1))
    near = lambda c: F.round(F.col(c) * steps) / steps if steps else F.col(c)
    rows = poles.groupBy(*(near(c).alias(c) for c in "xyz")).agg(F.count(F.lit(1)).alias("_n"))
    return rows.crossJoin(grid).groupBy("id").agg((F.sum(value * F.col("_n")) / F.sum("_n")).alias("density"))


def wedges(sets: DataFrame, key: str, slope_dip: float, slope_direction: float, friction: float) -> DataFrame:
    """Pairs of planes (rows of a table of set means) whose line of intersection daylights in the slope and is steeper than friction."""
    n = G.pole(F.col("dip"), F.col("dip_direction"))
    a = sets.select(F.col(key).alias("i"), *(c.alias(f"a{k}") for c, k in zip(n, "xyz")))
    b = sets.select(F.col(key).alias("j"), *(c.alias(f"b{k}") for c, k in zip(n, "xyz")))
    both = a.join(b, F.col("i") < F.col("j"))
    ax, ay, az, bx, by, bz = (F.col(c) for c in ("ax", "ay", "az", "bx", "by", "bz"))
    line = [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]
    both = both.withColumns(dict(zip(("_x", "_y", "_z"), line))).where("_x * _x + _y * _y + _z * _z > 1e-12")
    plunge, trend = G.plunge_and_trend(F.col("_x"), F.col("_y"), F.col("_z"))
    both = both.withColumns({"plunge": plunge, "trend": trend})
    turn = F.radians(F.col("trend") - slope_direction)
    apparent = F.degrees(F.atan(F.tan(F.lit(math.radians(slope_dip))) * F.cos(turn)))
    return both.select("i", "j", "plunge", "trend", ((F.cos(turn) > 0) & (F.col("plunge") > friction) & (F.col("plunge") < apparent)).alias("feasible"))


def stratigraphy(contacts: DataFrame, ranks: DataFrame, allowed: int = 0) -> DataFrame:
    """Holes whose units, going down, turn back up the sequence: inversions and their severity.

    The ranks, a row a unit, go to each task: joined by the unit, all contacts of
    a unit would meet in one.
    """
    order = Window.partitionBy("hole_id").orderBy("depth")
    rows = contacts.join(F.broadcast(ranks), "unit").withColumn("_next", F.lead("rank").over(order))
    out = rows.groupBy("hole_id").agg(F.count(F.when(F.col("_next") < F.col("rank"), 1)).alias("inversions"))
    return out.withColumn("severity", F.when(F.col("inversions") > allowed, "ERROR").when(F.col("inversions") > 0, "WARNING").otherwise("OK"))


_PRODUCTS = [(i, j) for i in range(3) for j in range(i, 3)]


def _axes(df: DataFrame, row_id: str, columns: tuple[str, str, str]) -> DataFrame:
    """row_id and unit vectors ax, ay, az; rows without a direction are left out."""
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    rows = df.select(row_id, *(F.col(c).cast("double").alias(c) for c in columns)).withColumn("_l", length).where((F.col("_l") > 1e-12) & (F.col("_l") < float("inf")))
    return rows.select(row_id, *((F.col(c) / F.col("_l")).alias(f"a{k}") for c, k in zip(columns, "xyz")))


def _orientation_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the products of the components: the orientation matrix of each group; a row's sign does not matter."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"a{'xyz'[i]}") * F.col(f"a{'xyz'[j]}")).alias(f"s{i}{j}") for i, j in _PRODUCTS))


def _leading(row) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first) and the leading eigenvector, pointing down, of a row of sums."""
    m = np.zeros((3, 3))
    for i, j in _PRODUCTS:
        m[i, j] = m[j, i] = row[f"s{i}{j}"]
    values, vectors = np.linalg.eigh(m)
    v = vectors[:, 2]
    return values[::-1], (-v if (v[2], v[1], v[0]) > (0, 0, 0) else v)


def axial_clusters(df: DataFrame, row_id: str, columns: tuple[str, str, str], k: int, rounds: int = 20) -> tuple[DataFrame, list[np.ndarray]]:
    """row_id, cluster and angle (degrees to the centre) of every axis, and the centres: k-means of axes, whose sign means nothing.

    An axis belongs to the centre of largest absolute cosine (of equals the
    first); a centre is the leading eigenvector of its axes' orientation matrix,
    so a round is one aggregation of six sums a cluster.  Centres start at the
    axis of the smallest id and then, one by one, at the axis furthest from all
    before.  Rounds end when no centre moves.  Null and zero vectors are left
    out; fewer axes than k give fewer centres.
    """
    rows = written(_axes(df, row_id, columns), "axes")
    cosine = lambda c: F.abs(sum((F.col(f"a{x}") * float(v) for x, v in zip("xyz", c)), F.lit(0.0)))
    first = rows.orderBy(row_id, "ax", "ay", "az").first()
    if first is None:
        return rows.select(row_id, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("angle")), []
    centres = [np.array(first[1:])]
    while len(centres) < k:
        near = F.array_max(F.array(*map(cosine, centres)))
        far = rows.agg(F.min(F.struct(F.round(near, 12).alias("near"), row_id, "ax", "ay", "az"))).first()[0]
        if far["near"] > 1 - 1e-9:
            break
        centres.append(np.array([far["ax"], far["ay"], far["az"]]))

    def assigned() -> DataFrame:
        near = F.transform(F.array(*map(cosine, centres)), lambda c: F.round(c, 12))
        return rows.withColumn("_near", near).withColumn("cluster", F.array_position("_near", F.array_max("_near")).cast("int") - 1)

    for _ in range(rounds):
        moved = 0.0
        for r in _orientation_sums(assigned(), ["cluster"]).collect():  # a row a centre
            new = _leading(r)[1]
            moved = max(moved, 1 - abs(float(new @ centres[r["cluster"]])))
            centres[r["cluster"]] = new
        if moved < 1e-14:
            break
    found = assigned()
    return found.select(row_id, "cluster", F.degrees(F.acos(F.least(F.array_max(F.array(*map(cosine, centres))), F.lit(1.0)))).alias("angle")), centres


def axial_density_clusters(df: DataFrame, row_id: str, columns: tuple[str, str, str], angle: float, least: int) -> DataFrame:
    """row_id and cluster (least id of its axes; -1: noise) of axes that have ``least`` axes within ``angle`` degrees, themselves included, and of those around them.

    Each axis stands on the sphere twice, at both its ends, and is clustered
    there in cells of the chord of the angle; the two images of a cluster count
    as one.  The angle is below 90 degrees; ids are integers.
    """
    from .clustering import density_clusters

    rows = _axes(df, row_id, columns)
    ends = rows.select((F.col(row_id) * 2).alias("_end"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z")).unionByName(rows.select((F.col(row_id) * 2 + 1).alias("_end"), (-F.col("ax")).alias("x"), (-F.col("ay")).alias("y"), (-F.col("az")).alias("z")))
    found = density_clusters(ends, "_end", 2 * math.sin(math.radians(angle) / 2), least)
    return found.groupBy(F.floor(F.col("_end") / 2).cast("long").alias(row_id)).agg(F.floor(F.min("cluster") / 2).cast("long").alias("cluster"))


def axial_sets(df: DataFrame, row_id: str, columns: tuple[str, str, str], clusters: DataFrame) -> list[dict]:
    """For every cluster (sets are few): number of axes, mean axis, its dip and dip direction as a plane's pole, the eigenvalues' shares and the mean resultant length about the axis."""
    rows = _axes(df, row_id, columns).join(clusters.select(row_id, "cluster"), row_id)
    out = []
    for r in sorted(_orientation_sums(rows, ["cluster"]).collect(), key=lambda r: r["cluster"]):
        values, axis = _leading(r)
        dip = math.degrees(math.acos(min(1.0, abs(axis[2]))))
        out.append({"cluster": r["cluster"], "n": r["n"], "x": float(axis[0]), "y": float(axis[1]), "z": float(axis[2]), "dip": dip, "dip_direction": math.degrees(math.atan2(-axis[0], -axis[1])) % 360, **{f"share{i + 1}": float(v / r["n"]) for i, v in enumerate(values)}, "woodcock": math.log(max(values[0], 1e-300) / max(values[1], 1e-300)) / max(math.log(max(values[1], 1e-300) / max(values[2], 1e-300)), 1e-12) if values[2] > 1e-12 * r["n"] else None})
    return out
