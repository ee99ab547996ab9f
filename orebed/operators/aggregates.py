"""Statistics, declustering, grade-tonnage, resources, swaths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import quantiles, reduce_equal, running


def describe(df: DataFrame, value: str, by: list[str] | None = None, percentiles=(0.1, 0.5, 0.9)) -> DataFrame:
    """Count, mean, population deviation, coefficient of variation, extremes and linear percentiles; NaN counts as missing."""
    by = by or []
    rows = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_x"))
    v = F.col("_x")
    out = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    names = {f"p{round(100 * p):02d}": p for p in percentiles}
    ranks = quantiles(rows, "_x", names, by).withColumnsRenamed({c: f"_k_{c}" for c in by})
    out = out.join(ranks, reduce_equal(by, "_k_") or F.lit(True), "left").drop(*(f"_k_{c}" for c in by))
    return out.select(*by, "n", "mean", "std", "min", "max", *names, F.when(F.abs("mean") > 1e-12, F.col("std") / F.col("mean")).alias("cv"))


def weighted(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Weighted mean and reliability-corrected variance from one pass of power sums."""
    w, x = F.when(F.col(value).isNotNull(), F.col(weight)), F.col(value)
    out = df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.sum(w * x).alias("_wx"), F.sum(w * x * x).alias("_wxx"))
    mean = F.col("_wx") / F.col("_w")
    variance = (F.col("_wxx") - F.col("_wx") * mean) / (F.col("_w") - F.col("_w2") / F.col("_w"))
    return out.withColumns({"mean": mean, "variance": F.greatest(variance, F.lit(0.0)), "weight": F.col("_w")}).drop("_w", "_w2", "_wx", "_wxx")


def cell_weights(df: DataFrame, sizes: dict[str, float]) -> DataFrame:
    """Declustering: 1 / (points in the cell); the weights sum to the number of occupied cells."""
    cells = {f"_c{a}": F.floor(F.col(a) / s) for a, s in sizes.items()}
    rows = df.withColumns(cells)
    return rows.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(*cells))).drop(*cells)


def declustered(df: DataFrame, value: str, sizes: list[float], axes=("x", "y")) -> DataFrame:
    """For each cell size: occupied cells, plain and declustered mean; cells are summed first, so a dense cell is one partial sum."""
    rows = df.where(F.col(value).isNotNull()).select(value, *axes, F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    cells = rows.groupBy("size", *(F.floor(F.col(a) / F.col("size")).alias(f"_{a}") for a in axes)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.sum(value).alias("s"))
    return cells.groupBy("size").agg(F.count(F.lit(1)).alias("cells"), (F.sum("s") / F.sum("n")).alias("mean"), F.avg("m").alias("declustered_mean"), F.max("n").alias("most"))


def top_cells(df: DataFrame, size: float, axes=("x", "y"), most: int = 100) -> DataFrame:
    """The fullest cells."""
    cells = df.groupBy(*(F.floor(F.col(a) / size).alias(f"i{a}") for a in axes)).agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.desc("n"), *(f"i{a}" for a in axes)).limit(most)


def grade_tonnage(blocks: DataFrame, grade: str, tonnes: str, cutoffs: list[float], by: list[str] | None = None) -> DataFrame:
    """Tonnes, grade and metal at or above each cutoff.

    Each block is put once into the band of the last cutoff it meets; the curve
    is the reverse running sum of the bands, so the blocks are not multiplied by
    the cutoffs.
    """
    by = by or []
    cuts = sorted(set(map(float, cutoffs)))
    band = sum((F.when(F.col(grade) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    bands = blocks.where(F.col(grade).isNotNull() & F.col(tonnes).isNotNull()).groupBy(*by, band.alias("band")).agg(F.sum(tonnes).alias("_t"), F.sum(F.col(tonnes) * F.col(grade)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    table = F.array(*(F.struct(F.lit(i + 1).alias("band"), F.lit(c).alias("cutoff")) for i, c in enumerate(cuts)))
    groups = bands.select(*by).distinct() if by else bands.agg(F.count(F.lit(1)).alias("_")).select()
    frame = groups.select(*by, F.inline(table))
    order = Window.partitionBy(*by).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0)
    full = frame.join(bands, [*by, "band"], "left")
    out = full.withColumns({n: F.sum(F.coalesce(c, F.lit(0))).over(order) for n, c in (("tonnes", F.col("_t")), ("metal", F.col("_m")), ("n", F.col("_n")))})
    return out.select(*by, "cutoff", "tonnes", "metal", "n", F.when(F.col("tonnes") > 0, F.col("metal") / F.col("tonnes")).alias("grade"))


def resources(blocks: DataFrame, category: str, volume: Column, density: Column, grade: str, joined: dict[str, list[str]] | None = None) -> DataFrame:
    """Volume, tonnes, tonnage-weighted grade and metal by category, with further totals over lists of categories and over all."""
    rows = blocks.select(F.col(category).alias("category"), volume.alias("_v"), (volume * density).alias("_t"), grade)
    names = F.array(F.col("category"), *(F.when(F.col("category").isin(*members), F.lit(name)) for name, members in (joined or {}).items()), F.lit("All"))
    per = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("volume"), F.sum("_t").alias("tonnes"), F.sum(F.col("_t") * F.col(grade)).alias("metal"))
    out = per.withColumn("category", F.explode(F.filter(names, lambda c: c.isNotNull()))).groupBy("category").agg(*(F.sum(c).alias(c) for c in ("n", "volume", "tonnes", "metal")))
    return out.withColumn("grade", F.try_divide("metal", "tonnes"))


def swath(df: DataFrame, axis: str, value: str, bins: int, closed: str = "right") -> DataFrame:
    """Mean, deviation and count in equal bins along an axis; empty bins stay.

    closed="right": bins hold their upper end (the first also its lower), sample
    deviation; "left": the last also holds its upper end, population deviation.
    """
    rows = df.where(F.col(axis).isNotNull() & F.col(value).isNotNull())
    limits = rows.agg(F.min(axis).alias("_lo"), ((F.max(axis) - F.min(axis)) / bins).alias("_w"))
    at = (F.col(axis) - F.col("_lo")) / F.col("_w")
    place = F.greatest(F.ceil(at) - 1, F.lit(0)) if closed == "right" else F.least(F.floor(at), F.lit(bins - 1))
    spread = F.stddev_samp if closed == "right" else F.stddev_pop
    rows = rows.crossJoin(F.broadcast(limits)).groupBy(place.cast("long").alias("bin")).agg(F.avg(value).alias("mean"), spread(value).alias("std"), F.count(F.lit(1)).alias("n"))
    frame = limits.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "_lo", "_w")
    return frame.join(rows, "bin", "left").select("bin", (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")).alias("middle"), "mean", "std", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_realisation(reals: DataFrame, node: str, value: str) -> DataFrame:
    """Per node over its realisations: mean, deviation, cv and percentiles."""
    return describe(reals, value, [node])


def exceedance(reals: DataFrame, node: str, value: str, cutoffs: list[float]) -> DataFrame:
    """Per node the share of realisations above each cutoff."""
    return reals.groupBy(node).agg(*(F.avg((F.col(value) > c).cast("double")).alias(f"p_{str(c).replace('.', '_')}") for c in cutoffs))


def global_uncertainty(reals: DataFrame, realisation: str, value: str, tonnes: float, cutoffs: list[float]) -> DataFrame:
    """Spread over realisations of tonnes, metal and grade above each cutoff; a realisation with nothing above counts as 0."""
    curves = grade_tonnage(reals.withColumn("_t", F.lit(float(tonnes))), value, "_t", cutoffs, [realisation])
    curves = curves.withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    return curves.groupBy("cutoff").agg(*(f(c).alias(f"{c}_{n}") for c in ("tonnes", "metal", "grade") for n, f in (("mean", F.avg), ("p10", lambda c: F.percentile(c, F.lit(0.1))), ("p90", lambda c: F.percentile(c, F.lit(0.9))))))


def fragment_sizes(df: DataFrame, size: str, volume: str, points=(0.1, 0.5, 0.8)) -> DataFrame:
    """Size distribution: linear percentiles by count, and the sizes at which the running share of volume is reached."""
    sizes = df.where(F.col(size).isNotNull()).groupBy(size).agg(F.sum(volume).alias("_v"))
    share = running(sizes, [size], "_v", "_s").crossJoin(F.broadcast(sizes.agg(F.sum("_v").alias("_all"))))
    share = share.withColumn("_s", (F.col("_s") + F.col("_v")) / F.col("_all"))
    by_volume = share.agg(*(F.min(F.when(F.col("_s") >= p, F.col(size))).alias(f"v{round(100 * p)}") for p in points))
    return quantiles(df, size, {f"p{round(100 * p)}": p for p in points}).crossJoin(by_volume)


def regression(df: DataFrame, actual: str, estimate: str, by: list[str] | None = None) -> DataFrame:
    """Estimates against actual values: slope, r2, bias percent, mean absolute and root mean square error."""
    e, a = F.col(estimate), F.col(actual)
    return df.where(e.isNotNull() & a.isNotNull()).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(a, e).alias("slope"), F.regr_intercept(a, e).alias("intercept"), F.regr_r2(a, e).alias("r2"), (100 * (F.avg(e) - F.avg(a)) / F.nullif(F.avg(a), F.lit(0.0))).alias("bias_percent"), F.avg(F.abs(e - a)).alias("mae"), F.sqrt(F.avg((e - a) * (e - a))).alias("rmse"))
