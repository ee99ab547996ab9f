"""Clusters: k-means on scaled variables, density clusters, connected components."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .spatial import AXES
from .stored import written

_CELL, _PART = ["_cx", "_cy", "_cz"], ["_px", "_py", "_pz"]


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """Rows with their cluster, after scaling to unit deviation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_v", "_s")


def cluster_quality(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Between over within sum of squares per degree of freedom (Calinski-Harabasz), from one pass of sums a cluster."""
    sums = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in columns), *(F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in columns))
    total = sums.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"), *(F.sum(f"s_{c}").alias(f"S_{c}") for c in columns), *(F.sum(f"q_{c}").alias(f"Q_{c}") for c in columns), *(F.sum(F.col(f"s_{c}") * F.col(f"s_{c}") / F.col("n")).alias(f"B_{c}") for c in columns))
    between = sum((F.col(f"B_{c}") - F.col(f"S_{c}") * F.col(f"S_{c}") / F.col("N") for c in columns), F.lit(0.0))
    within = sum((F.col(f"Q_{c}") - F.col(f"B_{c}") for c in columns), F.lit(0.0))
    return total.select(F.col("N").alias("n"), F.col("K").alias("clusters"), between.alias("between"), within.alias("within"), ((between / (F.col("K") - 1)) / (within / (F.col("N") - F.col("K")))).alias("score"))


def connected(edges: DataFrame) -> DataFrame:
    """node, component (least node) of undirected edges u, v (an edge of a node with itself names a node), by star rounds until nothing changes."""
    edges = written(edges.select("u", "v"), "edges")
    groups = components(edges)
    alone = edges.where(~F.coalesce(F.col("u") != F.col("v"), F.lit(False)))
    if alone.isEmpty():
        return groups
    alone = alone.select("u").unionByName(alone.select(F.col("v").alias("u"))).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return groups.unionByName(alone.join(groups, "node", "left_anti"))


def _near(rows: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Rows beside the others (columns prefixed o_) of the cells up to two away that lie within the radius."""
    steps = F.array(*(F.struct(*(F.lit(d).alias(c) for c, d in zip(_CELL, o))) for o in product(range(-2, 3), repeat=3)))
    spread = rows.withColumn("_o", F.explode(steps)).withColumns({c: F.col(c) + F.col(f"_o.{c}") for c in _CELL}).drop("_o")
    both = spread.join(others.withColumnsRenamed({c: f"o_{c}" for c in others.columns if c not in _CELL}), _CELL).drop(*_CELL)
    return both.where(F.sqrt(sum(((F.col(a) - F.col(f"o_{a}")) * (F.col(a) - F.col(f"o_{a}")) for a in AXES), F.lit(0.0))) <= radius)


def _linked_cells(core: DataFrame, radius: float) -> DataFrame:
    """u, v: least ids of the cells that have core points within the radius of each other.

    The bounds of the points in the sixty-four parts of a cell decide most pairs
    of cells; only parts that may or may not reach each other, of cells that no
    other parts link, are compared point by point, equal places once.
    """
    own = core.groupBy(*_CELL).agg(F.min("id").alias("least"))
    bounds = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    parts = core.groupBy(*_CELL, *_PART).agg(*bounds).join(own, _CELL)
    ahead = [o for o in product(range(-2, 3), repeat=3) if o > (0, 0, 0)]
    steps = F.array(*(F.struct(*(F.lit(d).alias(c) for c, d in zip(_CELL, o))) for o in ahead))
    left = parts.withColumn("_o", F.explode(steps)).withColumns({c: F.col(c) + F.col(f"_o.{c}") for c in _CELL}).drop("_o")
    both = left.join(parts.withColumnsRenamed({c: f"o_{c}" for c in parts.columns if c not in _CELL}), _CELL)
    length = lambda sides: F.sqrt(sum((d * d for d in sides), F.lit(0.0)))
    apart = [(F.col(f"o_lo_{a}") - F.col(f"hi_{a}"), F.col(f"lo_{a}") - F.col(f"o_hi_{a}")) for a in AXES]
    across = [(F.col(f"o_hi_{a}") - F.col(f"lo_{a}"), F.col(f"hi_{a}") - F.col(f"o_lo_{a}")) for a in AXES]
    both = both.where(length([F.greatest(F.lit(0.0), *d) for d in apart]) <= radius).withColumn("sure", length([F.greatest(*d) for d in across]) <= radius)
    both = written(both.select(F.col("least").alias("u"), F.col("o_least").alias("v"), *_PART, *(f"o_{c}" for c in _PART), "sure"), "parts")
    sure = both.where("sure").select("u", "v").distinct()
    open_ = both.where("not sure").join(sure, ["u", "v"], "left_anti")
    places = core.select(*_PART, *AXES).distinct()
    met = open_.join(places, _PART).join(places.withColumnsRenamed({c: f"o_{c}" for c in places.columns}), [f"o_{c}" for c in _PART])
    met = met.where(length([F.col(a) - F.col(f"o_{a}") for a in AXES]) <= radius)
    return sure.unionByName(met.select("u", "v").distinct())


def density_clusters(points: DataFrame, point_id: str, radius: float, least: int) -> DataFrame:
    """Clusters of core points (``least`` points within ``radius``, themselves included) that reach each other, with the border points at their least core neighbour's cluster; -1 is noise, and points without a place are noise.

    Points are put in cells in which all are within reach of each other, so the
    points of a cell with ``least`` are core, the core points of a cell are one
    cluster, and links are between cells.  Only points of emptier cells, less
    than ``least`` a cell, are compared with those around them one by one.
    Points at one place fare alike: from here on they are one row, of their least
    id and with their number.
    """
    side = radius / math.sqrt(3) * (1 - 1e-9)
    own = points.select(F.col(point_id).alias("id"), *(F.col(a).cast("double").alias(a) for a in AXES))
    rows = own.where(" and ".join(f"{a} is not null and not isnan({a})" for a in AXES)).groupBy(*AXES).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_c"))
    rows = written(rows, "places")
    rows = rows.withColumns({p: F.floor(F.col(a) / side * 4).cast("long") for p, a in zip(_PART, AXES)})
    rows = rows.withColumns({c: F.floor(F.col(p) / 4).cast("long") for c, p in zip(_CELL, _PART)})
    rows = written(rows.join(rows.groupBy(*_CELL).agg((F.sum("_c") >= least).alias("full")), _CELL), "cells")
    thin = rows.where("not full").drop("full", *_PART)
    counted = _near(thin, rows.select("id", *AXES, "_c", *_CELL), radius).groupBy("id").agg(F.sum("o__c").alias("_n"))
    core = rows.where("full").drop("full").unionByName(rows.where("not full").drop("full").join(counted.where(F.col("_n") >= least), "id", "left_semi"))
    core = written(core, "core")
    cells = core.groupBy(*_CELL).agg(F.min("id").alias("node"))
    groups = connected(_linked_cells(core, radius).unionByName(cells.select(F.col("node").alias("u"), F.col("node").alias("v"))))
    core = written(core.join(cells, _CELL).join(groups, "node").drop("node", *_PART), "grouped")
    border = _near(thin.join(core.select("id"), "id", "left_anti"), core, radius).groupBy("id").agg(F.min_by("o_component", "o_id").alias("component"))
    found = core.select("id", "component").unionByName(border).join(rows.select("id", *AXES), "id")
    found = found.select(F.col("component").alias("_component"), *(F.col(a).alias(f"_{a}") for a in AXES))
    own = own.join(found, [F.col(a) == F.col(f"_{a}") for a in AXES], "left")
    return own.select(F.col("id").alias(point_id), F.coalesce("_component", F.lit(-1)).alias("cluster"))


def outlying_points(points: DataFrame, point_id: str, k: int, sigmas: float = 2.0) -> DataFrame:
    """Points whose mean distance to their k nearest others exceeds the mean of that by ``sigmas`` deviations."""
    from .spatial import nearest

    near = nearest(points, points.withColumnRenamed(point_id, "_other"), k + 1, None, point_id, "_other").where(F.col("target") != F.col("point"))
    means = near.groupBy(F.col("target").alias(point_id)).agg(F.avg("distance").alias("mean_distance"))
    limits = means.agg((F.avg("mean_distance") + sigmas * F.stddev_pop("mean_distance")).alias("_limit"))
    return means.crossJoin(F.broadcast(limits)).select(point_id, "mean_distance", (F.col("mean_distance") > F.col("_limit")).alias("outlier"))


def cleaned(points: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Rows without null coordinates and without those further than ``limit`` deviations from the mean, as long as these are under a tenth of all."""
    rows = points.dropna(subset=columns)
    moments = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    far = F.lit(False)
    for c in columns:
        far = far | (F.abs(F.col(c) - F.col(f"_m_{c}")) > limit * F.col(f"_s_{c}"))
    rows = rows.crossJoin(F.broadcast(moments)).withColumn("_far", far)
    share = rows.agg(F.avg(F.col("_far").cast("double")).alias("_share"))
    return rows.crossJoin(F.broadcast(share)).where("not _far or _share >= 0.1").select(*points.columns)


def ranked_cells(points: DataFrame, size: float, levels: int = 10) -> DataFrame:
    """Points with the Morton code of their cell, for level-of-detail reads: a prefix of the code is a coarser cell."""
    cells = [F.floor(F.col(a) / size).cast("long") for a in ("x", "y", "z")]
    code = F.lit(0).cast("long")
    for bit in range(levels):
        for axis, c in enumerate(cells):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(1), 3 * bit + axis))
    return points.withColumn("cell", code)


def first_of_cell(points: DataFrame, point_id: str, size: float) -> DataFrame:
    """One point a cell: that of the least id."""
    cell = [F.floor(F.col(a) / size) for a in ("x", "y", "z")]
    return points.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(point_id))).where("_n = 1").drop("_n")


def mesh_parts(faces: DataFrame, face_id: str, vertices: tuple[str, str, str] = ("a", "b", "c")) -> DataFrame:
    """Connected parts of a mesh, named by their least vertex: each face's part, from links along its edges."""
    a, b, c = vertices
    sides = F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ((a, b), (b, c))))
    edges = faces.select(F.inline(sides))  # a face's edges stay together, so that pieces of the table hold pieces of the mesh
    groups = connected(edges)
    return faces.join(groups.select(F.col("node").alias(a), F.col("component").alias("part")), a).select(face_id, "part")


def grown_regions(points: DataFrame, point_id: str, k: int, angle: float) -> DataFrame:
    """Regions of points with unit normals (nx, ny, nz): neighbours among the k nearest whose normals are within ``angle`` degrees grow together; a region is named by its least point."""
    import math

    from .spatial import nearest

    near = nearest(points, points.withColumnRenamed(point_id, "_other"), k + 1, None, point_id, "_other").where(F.col("target") != F.col("point")).select(F.col("target").alias("u"), F.col("point").alias("v"))
    normal = lambda n: points.select(F.col(point_id).alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("nx", "ny", "nz")))
    both = near.join(normal("u"), "u").join(normal("v"), "v")
    dot = F.abs(F.col("nx_u") * F.col("nx_v") + F.col("ny_u") * F.col("ny_v") + F.col("nz_u") * F.col("nz_v"))
    edges = both.where(dot >= math.cos(math.radians(angle))).select("u", "v")
    own = points.select(F.col(point_id).alias("u"), F.col(point_id).alias("v"))
    return connected(edges.unionByName(own)).withColumnsRenamed({"node": point_id, "component": "region"})
