"""Checks between tables: assays against logs, points against surfaces, models against what was mined, estimates against samples held out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_polygon
from . import kriging
from .modelling import nearest_code
from .simulation import uniform
from .spatial import AXES, nearest

HOLE = "hole_id"


def assembled(assays: DataFrame, lithology: DataFrame | None = None, code: str = "lith_code", bad: DataFrame | None = None, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(intervals, excluded): assays that can be composited, and the others with the first reason that holds.

    Rows whose ``key`` stands in ``bad`` (found by validation) go first, then
    those without a depth (null or NaN), with one that is no number, without
    length, above the collar.  An interval without a code of its own gets that
    of the lithology whose middle is nearest in the hole, of equally near ones
    the shallower; without a lithology in the hole it stays null.
    """
    start, stop = (F.expr(f"try_cast(`{c}` as double)") for c in ("depth_from", "depth_to"))
    missing = lambda c, n: F.col(c).isNull() | F.isnan(F.coalesce(n, F.lit(0.0)))
    rows, wrong = assays, F.lit(False)
    if bad is not None:
        rows, wrong = rows.join(bad.select(*key).distinct().withColumn("_bad", F.lit(True)), key, "left"), F.coalesce("_bad", F.lit(False))
    reason = F.when(wrong, "validation_error").when(missing("depth_from", start), "missing_from_depth").when(missing("depth_to", stop), "missing_to_depth")
    reason = reason.when(start.isNull() | stop.isNull(), "invalid_depth_format").when(stop <= start, "zero_or_negative_length").when((start < 0) | (stop < 0), "negative_depth")
    rows = rows.withColumn("reason", reason).select(*assays.columns, "reason")
    excluded = rows.where("reason is not null")
    fine = rows.where("reason is null").drop("reason").withColumns({"depth_from": start, "depth_to": stop})
    if code not in fine.columns:
        fine = fine.withColumn(code, F.lit(None).cast("string"))
    if lithology is not None:
        logs = lithology.where(F.col(code).isNotNull() & F.col("depth_from").isNotNull() & F.col("depth_to").isNotNull()).select(HOLE, F.col("depth_from").cast("double").alias("depth_from"), F.col("depth_to").cast("double").alias("depth_to"), code)
        found = nearest_code(fine.where(F.col(code).isNull()).drop(code), logs, code)
        fine = fine.where(F.col(code).isNotNull()).withColumn(code, F.col(code).cast("string")).unionByName(found)
    return fine, excluded


def breaks(intervals: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Holes with gaps or overlaps between an interval and the one before it, and how many."""
    order = Window.partitionBy(HOLE).orderBy("depth_from", "depth_to")
    step = F.col("depth_from") - F.lag("depth_to").over(order)
    rows = intervals.select(HOLE, step.alias("_step")).groupBy(HOLE).agg(F.count_if(F.col("_step") > tolerance).alias("gaps"), F.count_if(F.col("_step") < -tolerance).alias("overlaps"))
    return rows.where("gaps + overlaps > 0")


def spot_checks(points: DataFrame, surface: DataFrame, n: int, point_id: str, vertex_id: str, chosen: Column | None = None, seed: int = 42) -> DataFrame:
    """``n`` points drawn by the hash of their id, each beside the nearest vertex of a surface (of equally near ones the least id): both places, distance, vertical and horizontal offset."""
    some = points if chosen is None else points.where(chosen)
    some = some.select(F.col(point_id).alias("_id"), *AXES).orderBy(uniform(seed, F.col("_id")), "_id").limit(n)
    vertices = surface.select(F.col(vertex_id).alias("_v"), *AXES, *(F.col(a).alias(f"surface_{a}") for a in AXES))
    near = nearest(some, vertices, 1, None, "_id", "_v", [f"surface_{a}" for a in AXES]).withColumnRenamed("target", "_id")
    d = [F.col(a) - F.col(f"surface_{a}") for a in AXES]
    return some.join(near, "_id").select(F.col("_id").alias(point_id), F.col("point").alias(vertex_id), *AXES, *(f"surface_{a}" for a in AXES), "distance", F.abs(d[2]).alias("vertical"), F.hypot(d[0], d[1]).alias("horizontal"))


def mine_series(grades: list[str], long: DataFrame, mined: DataFrame, control: DataFrame | None = None, polygons: list[tuple[str, bool, list[tuple[float, float]]]] | None = None, density: float = 2.7) -> DataFrame:
    """source, period, material, tonnes and plain mean grades of the long-term model by period, of the grade-control model by dig polygon (id, ore, vertices), and of what was mined.

    Models have volume and, if known, density; without a column ``period`` or
    without polygons a model is one row, "all".  A block in several polygons
    counts in each.  A grade that no block has is 0.
    """

    def summed(blocks: DataFrame, source: str, period: Column, material: Column) -> DataFrame:
        mass = F.col("volume") * (F.coalesce(F.col("density"), F.lit(density)) if "density" in blocks.columns else F.lit(density))
        means = (F.coalesce(F.avg(F.when(~F.isnan(F.col(g).cast("double")), F.col(g))), F.lit(0.0)).alias(g) for g in grades)
        return blocks.groupBy(F.lit(source).alias("source"), period.cast("string").alias("period"), material.alias("material")).agg(F.sum(mass).alias("tonnes"), *means)

    parts = [summed(long, "long_model", F.col("period") if "period" in long.columns else F.lit("all"), F.lit("ore"))]
    if control is not None and polygons:
        inside = F.array(*(F.when(in_polygon(F.col("x"), F.col("y"), v), F.struct(F.lit(i).alias("id"), F.lit("ore" if ore else "waste").alias("material"))) for i, ore, v in polygons))
        rows = control.withColumn("_dig", F.explode(F.filter(inside, lambda p: p.isNotNull())))
        parts.append(summed(rows, "gc_model", F.col("_dig.id"), F.col("_dig.material")))
    elif control is not None:
        parts.append(summed(control, "gc_model", F.lit("all"), F.lit("ore")))
    material = F.col("material") if "material" in mined.columns else F.lit("ore")
    parts.append(mined.select(F.lit("mined").alias("source"), F.col("period").cast("string").alias("period"), material.alias("material"), F.col("tonnes").cast("double").alias("tonnes"), *(F.col(g).cast("double").alias(g) for g in grades)))
    return reduce(DataFrame.unionByName, parts)


def slope_periods(schedule: DataFrame, results: DataFrame, on: list[str] | None = None, worst: bool = False) -> DataFrame:
    """Of each period the least factor of safety and the probability of failure of the slopes in the places (``on``) it works in, of all slopes without places.

    ``results`` has fos and probability (null where unknown); the probability is
    the mean (or greatest) of the known ones, and without any the share of
    factors below 1.  Results of a place are first summed up, so a period meets
    one row a place.
    """
    on = on or []
    fos = F.col("fos")
    sums = results.groupBy(*on).agg(F.min("fos").alias("_fos"), F.count("fos").alias("_n"), F.count_if(fos < 1).alias("_below"), F.sum("probability").alias("_p"), F.count("probability").alias("_known"), F.max("probability").alias("_top"))
    places = schedule.select("period", *on).distinct()
    rows = places.join(sums, on, "left") if on else places.crossJoin(F.broadcast(sums))
    known = F.max("_top") if worst else F.sum("_p") / F.sum("_known")
    probability = F.when(F.sum("_known") > 0, known).when(F.sum("_n") > 0, F.sum("_below") / F.sum("_n"))
    return rows.groupBy("period").agg(F.min("_fos").alias("min_fos"), probability.alias("failure_probability"))


def held_out(samples: DataFrame, value: str, share: float = 0.2, seed: int = 1, sample_id: str = "sample_id", refit: bool = True, **settings) -> tuple[DataFrame, DataFrame]:
    """(predictions, scores) of radial functions at a share of the samples drawn by the hash of their id, from the others; ``refit`` False uses all samples.

    scores: n, mae, rmse and r2 against the mean of the held-out values (null where they are all equal).
    """
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    known = samples.where(F.col(value).isNotNull()).withColumn("_test", uniform(seed, F.col(sample_id)) < share)
    test, others = known.where("_test"), known.where("not _test") if refit else known
    found = kriging.radial(test, others.withColumnRenamed(sample_id, "_s"), value, target_id=sample_id, sample_id="_s", **settings)
    rows = test.select(sample_id, F.col(value).cast("double").alias("actual")).join(found, sample_id)
    error = F.col("actual") - F.col("estimate")
    total = F.var_pop("actual") * F.count(F.lit(1))
    scores = rows.where("estimate is not null and not isnan(estimate)").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (1 - F.sum(error * error) / F.nullif(total, F.lit(0.0))).alias("r2"))
    return rows, scores
