"""Drillhole intervals: overlap joins, composites, breaks, contacts.

An interval table has hole_id, depth_from, depth_to and value columns.  All
operators partition by hole; overlap joins explode the bins an interval touches
and join on (hole, bin), so no range join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOLE = "hole_id"


def _weighted(grades: list[str], weight: Column, null_as_zero: bool) -> list[Column]:
    out = []
    for g in grades:
        value = F.coalesce(F.col(g), F.lit(0.0)) if null_as_zero else F.col(g)
        w = weight if null_as_zero else F.when(F.col(g).isNotNull(), weight)
        out.append((F.sum(value * weight) / F.sum(w)).alias(g))
    return out


def fixed_length(intervals: DataFrame, grades: list[str], length: float, partial: str = "keep", min_length: float = 0.0, null_as_zero: bool = False, density: str | None = None, origin: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Bins of ``length`` from each hole's first depth, weighted by overlap (and density).

    A bin that is covered less than ``length`` is partial: "keep" it, "discard"
    it, or "merge" it into the bin before (the hole's only bin is kept).
    ``origin`` sets where bins start instead (bench alignment), ``by`` adds keys
    across which no composite reaches (hard breaks).
    """
    keys = [HOLE, *(by or [])]
    start = origin if origin is not None else F.min("depth_from").over(Window.partitionBy(*keys))
    rows = intervals.where(F.col("depth_to") > F.col("depth_from")).withColumn("_o", start)
    low, high = F.floor((F.col("depth_from") - F.col("_o")) / length), F.ceil((F.col("depth_to") - F.col("_o")) / length) - 1
    rows = rows.withColumn("bin", F.explode(F.sequence(low, F.greatest(low, high))))
    a, b = F.col("_o") + F.col("bin") * length, F.col("_o") + (F.col("bin") + 1) * length
    rows = rows.withColumns({"_a": F.greatest("depth_from", a), "_b": F.least("depth_to", b)}).withColumn("_l", F.col("_b") - F.col("_a")).where("_l > 0")
    if partial == "merge":
        covered = F.sum("_l").over(Window.partitionBy(*keys, "bin"))
        first = F.min("bin").over(Window.partitionBy(*keys))
        rows = rows.withColumn("bin", F.when((covered < length - 1e-9) & (F.col("bin") > first), F.col("bin") - 1).otherwise(F.col("bin")))
    weight = F.col("_l") * F.col(density) if density else F.col("_l")
    out = rows.groupBy(*keys, "bin").agg(F.min("_a").alias("depth_from"), F.max("_b").alias("depth_to"), F.sum("_l").alias("length"), F.count(F.lit(1)).alias("sample_count"), *_weighted(grades, weight, null_as_zero))
    out = out.withColumn("is_partial", F.col("length") < length - 1e-9)
    if partial == "discard":
        out = out.where("not is_partial")
    return out.where(F.col("length") >= min_length)


def indicator(intervals: DataFrame, grade: str, cutoff: float, length: float, **settings) -> DataFrame:
    """Fixed-length composites of grade >= cutoff as 1 or 0."""
    rows = intervals.withColumn("indicator", F.when(F.col(grade).isNotNull(), (F.col(grade) >= cutoff).cast("double")))
    return fixed_length(rows, ["indicator"], length, **settings)


def bench(intervals: DataFrame, grades: list[str], height: float, offset: float = 0.0, **settings) -> DataFrame:
    return fixed_length(intervals, grades, height, origin=F.lit(float(offset)), **settings)


def equal_mass(intervals: DataFrame, grades: list[str], mass: float, density: str) -> DataFrame:
    """Bins of equal mass along the hole: the mass axis takes the place of depth, and cuts are mapped back to depth.

    The running mass is summed in decimals of twelve places, so that no cut moves by a rounding.
    """
    order = Window.partitionBy(HOLE).orderBy("depth_from", "depth_to").rowsBetween(Window.unboundedPreceding, 0)
    exact = lambda c: F.col(c).cast("decimal(18,6)")
    rows = intervals.where(F.col("depth_to") > F.col("depth_from")).withColumn("_m", ((exact("depth_to") - exact("depth_from")).cast("decimal(18,6)") * exact(density)).cast("decimal(38,12)"))
    rows = rows.withColumn("_end", F.sum("_m").over(order))
    rows = rows.withColumn("_start", (F.col("_end") - F.col("_m")).cast("double")).withColumn("_end", F.col("_end").cast("double"))
    low, high = F.floor(F.col("_start") / mass), F.ceil(F.col("_end") / mass) - 1
    rows = rows.withColumn("bin", F.explode(F.sequence(low, F.greatest(low, high))))
    rows = rows.withColumns({"_a": F.greatest(F.col("_start"), F.col("bin") * mass), "_b": F.least(F.col("_end"), (F.col("bin") + 1) * mass)}).where("_b > _a")
    depth = lambda m: F.col("depth_from") + (m - F.col("_start")) / F.col(density)
    rows = rows.withColumn("_w", F.col("_b") - F.col("_a"))
    return rows.groupBy(HOLE, "bin").agg(F.min(depth(F.col("_a"))).alias("c_from"), F.max(depth(F.col("_b"))).alias("c_to"), F.sum("_w").alias("mass"), *_weighted(grades, F.col("_w"), False)).withColumnsRenamed({"c_from": "depth_from", "c_to": "depth_to"})


def rolling(intervals: DataFrame, grades: list[str], length: float, step: float) -> DataFrame:
    """Overlapping windows of ``length`` every ``step``; only those that end within the hole."""
    holes = Window.partitionBy(HOLE)
    rows = intervals.where(F.col("depth_to") > F.col("depth_from")).withColumns({"_o": F.min("depth_from").over(holes), "_e": F.max("depth_to").over(holes)})
    last = F.floor((F.col("_e") - F.col("_o") - length) / step + 1e-9)
    low = F.greatest(F.floor((F.col("depth_from") - F.col("_o") - length) / step) + 1, F.lit(0))
    high = F.least(F.ceil((F.col("depth_to") - F.col("_o")) / step) - 1, last)
    rows = rows.where(high >= low).withColumn("bin", F.explode(F.sequence(low, high)))
    a = F.col("_o") + F.col("bin") * step
    rows = rows.withColumns({"_a": a, "_l": F.least(F.col("depth_to"), a + length) - F.greatest(F.col("depth_from"), a)}).where("_l > 0")
    return rows.groupBy(HOLE, "bin").agg(F.first("_a").alias("depth_from"), (F.first("_a") + length).alias("depth_to"), F.sum("_l").alias("covered"), *_weighted(grades, F.col("_l"), False))


def islands(intervals: DataFrame, code: str, grades: list[str], gap: float = 1e-3, min_length: float = 0.0, sums: list[str] = ()) -> DataFrame:
    """Adjacent intervals of equal code and no gap merged (gaps and islands); ``sums`` are added up."""
    order = Window.partitionBy(HOLE).orderBy("depth_from", "depth_to")
    starts = (F.lag(code).over(order).isNull()) | (F.lag(code).over(order) != F.col(code)) | (F.col("depth_from") - F.lag("depth_to").over(order) >= gap)
    rows = intervals.where(F.col(code).isNotNull()).withColumn("_s", F.when(starts, 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_l", F.col("depth_to") - F.col("depth_from"))
    out = rows.groupBy(HOLE, "island").agg(F.first(code).alias(code), F.min("depth_from").alias("depth_from"), F.max("depth_to").alias("depth_to"), F.sum("_l").alias("length"), F.count(F.lit(1)).alias("sample_count"), *_weighted(grades, F.col("_l"), False), *(F.sum(c).alias(c) for c in sums))
    return out.where(F.col("length") >= min_length)


def economic(intervals: DataFrame, grade: str, cutoff: float, min_ore: float = 0.0, max_waste: float = 0.0) -> DataFrame:
    """Ore runs, joined over waste runs of at most ``max_waste`` that keep the joined grade at the cutoff with one ore run on either side.

    Runs are found per hole by windows; joined runs of less than ``min_ore`` are left out.
    """
    coded = intervals.withColumns({"ore": (F.col(grade) >= cutoff).cast("int"), "_metal": F.col(grade) * (F.col("depth_to") - F.col("depth_from"))})
    rows = islands(coded, "ore", [grade], sums=["_metal"])
    order = Window.partitionBy(HOLE).orderBy("depth_from")
    metal, size = F.col("_metal"), F.col("length")  # summed, as a mean times its length is not what it was made of
    around = (F.lag(metal).over(order) + metal + F.lead(metal).over(order)) / (F.lag(size).over(order) + size + F.lead(size).over(order))
    bridged = (F.col("ore") == 0) & (size <= max_waste) & (around >= cutoff)
    rows = rows.withColumn("_in", F.coalesce((F.col("ore") == 1) | bridged, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_in")
    out = rows.groupBy(HOLE, "run").agg(F.min("depth_from").alias("depth_from"), F.max("depth_to").alias("depth_to"), F.sum("length").alias("length"), (F.sum(metal) / F.sum("length")).alias(grade), F.sum(F.when(F.col("ore") == 0, size).otherwise(0.0)).alias("waste_length"))
    return out.where(F.col("length") >= min_ore)


def contacts(intervals: DataFrame, code: str) -> DataFrame:
    """Depth where one code gives way to another in consecutive intervals."""
    order = Window.partitionBy(HOLE).orderBy("depth_from", "depth_to")
    rows = intervals.withColumns({"above": F.col(code), "below": F.lead(code).over(order), "next_from": F.lead("depth_from").over(order)})
    return rows.where("above != below").select(HOLE, ((F.col("depth_to") + F.col("next_from")) / 2).alias("depth"), "above", "below")


def coded(intervals: DataFrame, lithology: DataFrame, code: str = "lith_code") -> DataFrame:
    """The code of the lithology interval that holds an interval's middle (ties to the shallower); null where none does.

    Both sides are bucketed by depth so that the containment join has an equi key.
    """
    width = 50.0
    mid = (F.col("depth_from") + F.col("depth_to")) / 2
    left = intervals.withColumns({"_mid": mid, "_b": F.floor(mid / width)})
    right = lithology.select(HOLE, F.col("depth_from").alias("_f"), F.col("depth_to").alias("_t"), code).where("_t > _f").withColumn("_b", F.explode(F.sequence(F.floor(F.col("_f") / width), F.floor(F.col("_t") / width))))
    own = list(intervals.columns)
    hit = left.join(right, [HOLE, "_b"], "left").withColumn("_in", (F.col("_mid") >= F.col("_f")) & (F.col("_mid") < F.col("_t")))
    return hit.groupBy(*own).agg(F.min_by(F.when(F.col("_in"), F.col(code)), F.when(F.col("_in"), F.col("_f"))).alias(code))


def length_stats(intervals: DataFrame, grade: str) -> DataFrame:
    """Moments of a grade: plain (population) and weighted by length."""
    w = F.col("depth_to") - F.col("depth_from")
    rows = intervals.where(F.col(grade).isNotNull())
    moments = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(HOLE).alias("holes"), F.avg(grade).alias("mean"), F.stddev_pop(grade).alias("std"), (F.sum(w * F.col(grade)) / F.sum(w)).alias("weighted_mean"), (F.sum(w * F.col(grade) * F.col(grade)) / F.sum(w)).alias("_s"), F.sum(w).alias("metres"))
    return moments.withColumn("weighted_std", F.sqrt(F.greatest(F.col("_s") - F.col("weighted_mean") * F.col("weighted_mean"), F.lit(0.0)))).drop("_s")
