"""Adaptive octrees: cells of a cube-wise halved box, split while they hold too many points.

A point's cell at the deepest level is its Morton code; a shift by three bits is
the cell above.  The points are counted once, in the deepest cells, and all levels
are counts of those counts, so no cell's points ever meet in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import AXES
from .stored import written

DEPTH, LEAST = 8, 100


def _coded(points: DataFrame, depth: int) -> DataFrame:
    """The points with _code, the Morton code at ``depth`` levels below their joint box (x lowest); the box as _lo and _hi of each axis."""
    rows = points.where(" and ".join(f"{a} is not null and not isnan({a})" for a in AXES))
    box = rows.agg(*(f(a).alias(f"_{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    rows = rows.crossJoin(F.broadcast(box))  # one row
    code = F.lit(0).cast("long")
    for k, a in enumerate(AXES):
        side = F.col(f"_hi_{a}") - F.col(f"_lo_{a}")
        at = F.least(F.floor((F.col(a) - F.col(f"_lo_{a}")) / F.when(side > 0, side) * (1 << depth)), F.lit((1 << depth) - 1))
        at = F.coalesce(at, F.lit(0)).cast("long")
        for b in range(depth):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(at, b).bitwiseAND(1), 3 * b + k))
    return rows.withColumn("_code", code)


def _leaves(coded: DataFrame, depth: int, least: int) -> DataFrame:
    """_code (of a deepest cell that holds points), level and cell (code at that level) of its leaf, n (points of the leaf)."""
    deep = written(coded.groupBy("_code").agg(F.count(F.lit(1)).alias("_n")), "cells")
    chain = deep.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("cell", F.call_function("shiftright", F.col("_code"), 3 * (depth - F.col("level"))))
    sums = chain.groupBy("level", "cell").agg(F.sum("_n").alias("n")).where((F.col("n") <= least) | (F.col("level") == depth))
    # Of a cell's ancestors that need no split the highest is its leaf.
    return chain.join(sums, ["level", "cell"]).groupBy("_code").agg(F.min(F.struct("level", "cell", "n")).alias("leaf")).select("_code", "leaf.*")


def octree(points: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """level, cell, n and the bounds (lo_x, hi_x, ...) of the leaves that hold points: cells of at most ``least`` points, or of the deepest level (at most 20).

    Null and NaN places are left out; points on an inner bound belong to the upper
    cell; an axis without extent is not cut; no points give no leaves.
    """
    coded = _coded(points, depth)
    box = coded.agg(*(F.first(f"_{n}_{a}").alias(f"_{n}_{a}") for a in AXES for n in ("lo", "hi")))
    leaves = _leaves(coded, depth, least).select("level", "cell", "n").distinct().crossJoin(F.broadcast(box))
    for k, a in enumerate(AXES):
        bits = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda b: F.call_function("shiftleft", F.call_function("shiftright", F.col("cell"), 3 * b + k).bitwiseAND(1).cast("long"), b))
        at = F.aggregate(bits, F.lit(0).cast("long"), lambda s, v: s + v)
        side = (F.col(f"_hi_{a}") - F.col(f"_lo_{a}")) / F.pow(F.lit(2.0), F.col("level"))
        leaves = leaves.withColumns({f"lo_{a}": F.col(f"_lo_{a}") + at * side, f"hi_{a}": F.col(f"_lo_{a}") + (at + 1) * side})
    return leaves.drop(*(f"_{n}_{a}" for a in AXES for n in ("lo", "hi")))


def in_leaves(points: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """The points with the level and cell of their leaf."""
    coded = _coded(points, depth)
    return coded.join(_leaves(coded, depth, least).drop("n"), "_code").drop("_code", *(f"_{n}_{a}" for a in AXES for n in ("lo", "hi")))
