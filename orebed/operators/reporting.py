"""Reports: data quality, comparisons, logs, trends, reconciliation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import quantiles, running


def quality(df: DataFrame, columns: list[str], positive: tuple[str, ...] = (), key: list[str] | None = None) -> DataFrame:
    """column, rows, missing (null or NaN), negative, distinct-key duplicates, and whether the column varies; one pass over the table."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("missing"), (F.count_if(F.col(c) < 0) if c in positive else F.lit(0).cast("long")).alias("negative"), F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias("varies"))
    out = df.agg(F.array(*map(one, columns)).alias("_all")).select(F.inline("_all"))
    if not key:
        return out
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("duplicates"))
    return out.crossJoin(repeated)


def shares(df: DataFrame, category: str, weight: str | None = None) -> DataFrame:
    """Count (or weight) and percent of each category."""
    per = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("weight").alias("_all")))).select(category, "n", "weight", (100 * F.col("weight") / F.col("_all")).alias("percent"))


def compared(one: DataFrame, two: DataFrame, value: str) -> DataFrame:
    """Mean, median and deviation of two data sets, their differences and percent differences (0 against 0)."""
    def stats(df: DataFrame, n: str) -> DataFrame:
        rows = df.where(F.col(value).isNotNull())
        moments = rows.agg(F.count(value).alias(f"n_{n}"), F.avg(value).alias(f"mean_{n}"), F.stddev_pop(value).alias(f"std_{n}"))
        return moments.crossJoin(quantiles(rows, value, {f"median_{n}": 0.5}))

    out = stats(one, "1").crossJoin(stats(two, "2"))
    percent = lambda c: F.when(F.col(f"{c}_2") != 0, 100 * (F.col(f"{c}_1") - F.col(f"{c}_2")) / F.col(f"{c}_2")).otherwise(0.0)
    for c in ("mean", "median", "std"):
        out = out.withColumn(f"{c}_difference", F.col(f"{c}_1") - F.col(f"{c}_2"))
    return out.withColumns({f"{c}_percent": percent(c) for c in ("mean", "median")})


def by_source(sources: dict[str, DataFrame], value: str) -> DataFrame:
    """Count, mean, deviation and extremes of a value in several tables, side by side."""
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("source"), F.col(value).alias("_v")) for n, df in sources.items()))
    return rows.groupBy("source").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"))


def log_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Entries by each key alone and in all: key, entry, n (grouping sets)."""
    rows = log.select(F.explode(F.array(F.struct(F.lit("all").alias("key"), F.lit(None).cast("string").alias("entry")), *(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("entry")) for k in keys))).alias("_e"))
    return rows.groupBy("_e.key", "_e.entry").agg(F.count(F.lit(1)).alias("n"))


def log_entries(log: DataFrame, equal: dict[str, object], ts: str, start=None, end=None, latest: int | None = None) -> DataFrame:
    """Entries that have the given values between two times, the latest first; ``latest`` is how many are reported."""
    rows = log
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    if start is not None:
        rows = rows.where(F.col(ts) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(ts) <= F.lit(end))
    return rows.orderBy(F.desc(ts), *sorted(rows.columns)).limit(latest) if latest else rows


def timings(log: DataFrame, by: list[str], duration: str, success: Column) -> DataFrame:
    """Runs, share that succeeded, mean, longest and 95th percentile of the durations."""
    out = log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(success.cast("double")).alias("success_rate"), F.avg(duration).alias("mean"), F.max(duration).alias("longest"))
    return out.join(quantiles(log, duration, {"p95": 0.95}, by), by)


def monotonic(df: DataFrame, group: str, ts: str) -> DataFrame:
    """Of each group, in the order of its row numbers, whether times never fall, and how often they do."""
    order = Window.partitionBy(group).orderBy("row")
    falls = df.withColumn("_p", F.lag(ts).over(order)).groupBy(group).agg(F.count_if(F.col(ts) < F.col("_p")).alias("falls"))
    return falls.withColumn("monotonic", F.col("falls") == 0)


def correlation(df: DataFrame, one: str, two: str, least: float = 0.3) -> DataFrame:
    """Pearson's and Spearman's coefficients of the pairs, how strong the first is, and whether it reaches ``least``; null for fewer than ten pairs.

    Ranks of equal values are averaged: counts by value and a two-level running sum give them.
    """
    rows = df.select(F.col(one).cast("double").alias("_a"), F.col(two).cast("double").alias("_b")).where("_a is not null and _b is not null and not isnan(_a) and not isnan(_b)")

    def ranks(c: str) -> DataFrame:
        counts = running(rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), [c], "_n", "_before")
        return counts.select(c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"{c}_rank"))

    rows = rows.join(ranks("_a"), "_a").join(ranks("_b"), "_b")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("pearson"), F.corr("_a_rank", "_b_rank").alias("spearman"))
    size, enough = F.abs("pearson"), F.col("n") >= 10
    strength = F.when(~enough, "insufficient_data").when(size >= 0.7, "strong").when(size >= 0.5, "moderate").when(size >= 0.3, "weak").otherwise("none")
    return out.select("n", F.when(enough, F.col("pearson")).alias("pearson"), F.when(enough, F.col("spearman")).alias("spearman"), strength.alias("strength"), F.coalesce(enough & (size >= least), F.lit(False)).alias("usable"))


def stationarity(df: DataFrame, value: str, domain: str, mean: float, axes=("x", "y", "z"), tolerance: float = 15.0) -> DataFrame:
    """kind, name, statistic, issue: domains (of five rows at least) whose mean is over ``tolerance`` percent off, and linear trends with r2 above 0.15 (moderate) or 0.3 (strong)."""
    domains = df.groupBy(F.col(domain).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m")).where("_n >= 5")
    off = 100 * F.abs(F.col("_m") - mean) / mean
    first = domains.select(F.lit("domain").alias("kind"), "name", off.alias("statistic"), F.when(off > tolerance, "mean differs").alias("issue"))
    fits = df.agg(F.array(*(F.struct(F.lit(a).alias("name"), F.regr_r2(value, a).alias("statistic")) for a in axes)).alias("_t")).select(F.inline("_t"))
    trend = F.when(F.col("statistic") > 0.3, "strong trend").when(F.col("statistic") > 0.15, "moderate trend")
    return first.unionByName(fits.select(F.lit("trend").alias("kind"), "name", "statistic", trend.alias("issue")))


def distribution_distance(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of each group's distribution to that of all rows, from counts by value."""
    values = running(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_all")), [value], "_all", "_below").withColumn("_to", F.col("_below") + F.col("_all"))
    total = df.agg(F.count(value).alias("_total"))
    own = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"_own": F.sum("_n").over(upto), "_size": F.sum("_n").over(Window.partitionBy(group))}).join(values, value).crossJoin(F.broadcast(total))
    # Between a group's own values its share is constant, so the greatest distance is at one of its values or just below it.
    at = F.abs(F.col("_own") / F.col("_size") - F.col("_to") / F.col("_total"))
    below = F.abs((F.col("_own") - F.col("_n")) / F.col("_size") - F.col("_below") / F.col("_total"))
    return own.groupBy(group).agg(F.max("_size").alias("n"), F.max(F.greatest(at, below)).alias("distance"))


def drift(df: DataFrame, value: str, axes: tuple[str, ...] = ("x", "y", "z")) -> tuple[list[float], DataFrame]:
    """(constant and slope of each axis, the rows with drift and residual): least squares from the sums of products, which are all that reaches the driver."""
    rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (value, *axes))))
    centre = rows.agg(*(F.avg(a) for a in axes)).first()
    terms = [F.lit(1.0), *(F.col(a) - F.lit(float(m or 0.0)) for a, m in zip(axes, centre))]
    n = len(terms)
    sums = rows.agg(*(F.sum(terms[i] * terms[j]) for i in range(n) for j in range(n)), *(F.sum(t * F.col(value)) for t in terms)).first()
    left, right = np.array([v or 0.0 for v in sums[: n * n]]).reshape(n, n), np.array([v or 0.0 for v in sums[n * n :]])
    found = np.linalg.lstsq(left, right, rcond=None)[0]
    fitted = sum((F.lit(float(b)) * t for b, t in zip(found, terms)), F.lit(0.0))
    slopes = found[1:].tolist()
    constant = float(found[0] - sum(s * float(m or 0.0) for s, m in zip(slopes, centre)))
    return [constant, *slopes], df.withColumn("drift", fitted).withColumn("residual", F.col(value) - F.col("drift"))


def reproduction(samples: DataFrame, reals: DataFrame, value: str, realisation: str) -> DataFrame:
    """Mean and variance of each realisation beside the samples', and their ratios."""
    target = samples.agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    own = reals.groupBy(realisation).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    return own.crossJoin(F.broadcast(target)).select(realisation, "mean", "variance", F.try_divide("mean", "_m").alias("mean_ratio"), F.try_divide("variance", "_v").alias("variance_ratio"))


def checks(estimate: float | Column, references: dict[str, Column], tolerance: float, df: DataFrame) -> DataFrame:
    """check, reference, percent (difference of the estimate's mean), passed: one aggregation of a table for all references."""
    mean = estimate if isinstance(estimate, Column) else F.lit(float(estimate))
    row = df.agg(mean.alias("_e"), *(c.alias(n) for n, c in references.items()))
    table = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("reference"), (100 * (F.col("_e") - F.col(n)) / F.nullif(F.col(n), F.lit(0.0))).alias("percent")) for n in references))
    return row.select(F.inline(table)).withColumn("passed", F.coalesce(F.abs("percent") <= tolerance, F.lit(False)))


def misfit(df: DataFrame, predicted: str, actual: str, by: str, limits=(1.0, 3.0)) -> DataFrame:
    """Median, 90th percentile and mean of absolute misfits of each group, and their class by the 90th percentile."""
    rows = df.withColumn("_off", F.abs(F.col(predicted) - F.col(actual)))
    out = rows.groupBy(by).agg(F.count("_off").alias("n"), F.avg("_off").alias("mean")).join(quantiles(rows, "_off", {"p50": 0.5, "p90": 0.9}, [by]), by)
    return out.withColumn("class", F.when(F.col("p90") <= limits[0], "good").when(F.col("p90") <= limits[1], "fair").otherwise("poor"))


def deviations(logged: DataFrame, modelled: DataFrame, on: list[str], tolerance: float, by: list[str]) -> DataFrame:
    """Modelled less logged z where they differ by ``tolerance`` at least: count, mean, mean absolute and greatest absolute by group."""
    both = logged.join(modelled.select(*on, F.col("z").alias("_m")), on).withColumn("_d", F.col("_m") - F.col("z")).where(F.abs("_d") >= tolerance)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean"), F.avg(F.abs("_d")).alias("mean_absolute"), F.max(F.abs("_d")).alias("greatest"))


def unit_thickness(contacts: DataFrame, above: str, below: str, voxel: float, least: int = 3) -> DataFrame:
    """Of a pair of adjacent units: the first place in each hole, from the top, where one lies on the other, how thick the upper is there, and in voxels."""
    order = Window.partitionBy("hole_id").orderBy(F.desc("z"))
    rows = contacts.withColumns({"_n": F.lead("formation").over(order), "_z": F.lead("z").over(order)}).where((F.col("formation") == above) & (F.col("_n") == below))
    first = rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").withColumn("_t", F.abs(F.col("z") - F.col("_z"))).where("_t > 0")
    out = first.agg(F.count(F.lit(1)).alias("holes"), F.avg("_t").alias("mean"), F.min("_t").alias("least"), F.max("_t").alias("greatest"))
    voxels = F.col("mean") / voxel
    return out.withColumns({"voxels": voxels, "warning": F.when(voxels < 1, "CRITICAL").when(voxels < least, "WARNING")})


def grouped_fragments(points: DataFrame, label: str) -> DataFrame:
    """Extent, box volume, diameter of the sphere of that volume, and flatness of each labelled fragment."""
    out = points.groupBy(label).agg(F.count(F.lit(1)).alias("points"), *((F.max(a) - F.min(a)).alias(f"d{a}") for a in "xyz"))
    volume = F.col("dx") * F.col("dy") * F.col("dz")
    sides = F.array_sort(F.array("dx", "dy", "dz"))
    return out.withColumns({"volume": volume, "diameter": F.pow(6 * volume / 3.141592653589793, F.lit(1 / 3)), "flatness": F.try_divide(sides[0], sides[2])})


def recommended_cell_size(curve: DataFrame, stable: float = 0.001) -> DataFrame:
    """From size and declustered_mean: the least size whose mean differs from that of the size before by less than ``stable`` of it, else that of the least change, else the middle one."""
    order = Window.orderBy("size")  # a curve has a row a size
    rows = curve.withColumns({"_k": F.row_number().over(order) - 1, "_before": F.lag("declustered_mean").over(order)})
    rows = rows.withColumn("_change", F.abs(F.col("declustered_mean") - F.col("_before")) / F.nullif(F.abs("_before"), F.lit(0.0)))
    out = rows.agg(F.min(F.when(F.col("_change") < stable, F.col("size"))).alias("_stable"), F.min_by("size", F.when(F.col("_change").isNotNull(), F.struct("_change", "size"))).alias("_least"), F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct("_k", "size")).alias("_all"))
    middle = F.filter("_all", lambda x: x["_k"] == F.floor(F.col("_n") / 2))[0]["size"]
    return out.select(F.coalesce("_stable", "_least", middle).alias("size"), F.col("_stable").isNotNull().alias("stable"))


def contour_levels(df: DataFrame, value: str, count: int, kind: str = "linear") -> DataFrame:
    """Levels of a density: equal steps to its greatest value, steps of its logarithm, or percentiles of its positive values from the tenth."""
    rows = df.where(F.col(value) > 0)
    if kind == "percentile":
        names = {f"l{k}": 0.1 + 0.9 * k / (count - 1) for k in range(count)}
        found = quantiles(rows, value, names)
        return found.select(F.posexplode(F.array(*names)).alias("level", "value"))
    ends = rows.agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    k = F.col("level")
    at = F.col("_hi") / count * (k + 1) if kind == "linear" else F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), k / (count - 1))
    return ends.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select("level", at.alias("value"))


def correlations(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """Correlation of each input with each output, one aggregation for all."""
    table = F.array(*(F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"), F.corr(i, o).alias("r")) for i in inputs for o in outputs))
    return df.agg(table.alias("_t")).select(F.inline("_t"))


def filtered_estimates(estimates: DataFrame, estimate: str, drift: str, data: DataFrame, value: str, contraction: float = 0.85, low: float = 0.005, high: float = 0.995, positive: bool = False) -> DataFrame:
    """Estimates drawn towards their drift and cut at percentiles of the data (and at 0)."""
    limits = quantiles(data, value, {"_lo": low, "_hi": high})
    drawn = F.coalesce(F.col(drift) + contraction * (F.col(estimate) - F.col(drift)), F.col(estimate))
    cut = F.greatest(F.least(drawn, F.col("_hi")), F.col("_lo"))
    return estimates.crossJoin(F.broadcast(limits)).withColumn("filtered", F.greatest(cut, F.lit(0.0)) if positive else cut).drop("_lo", "_hi")


def plain_resources(blocks: DataFrame, grade: str, operator: str, cutoff: float, volume: float, density: Column) -> DataFrame:
    """Blocks, tonnes, plain mean grade and metal (in millions) of the blocks that meet a cutoff."""
    from .selection import compared as met

    rows = blocks.where(met(grade, operator, cutoff))
    out = rows.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(density * volume), F.lit(0.0)).alias("tonnes"), F.avg(grade).alias("grade"))
    return out.withColumn("metal", F.col("tonnes") * F.col("grade") / 1e6)


def risk_profile(schedule: DataFrame, places: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Of each period: tonnes, mean of each hazard at its places (0 where unknown), and their weighted sum over all weights."""
    rows = schedule.join(places, "block_id", "left")
    out = rows.groupBy("period").agg(F.sum("tonnes").alias("tonnes"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in weights))
    total = sum(weights.values())
    return out.withColumn("risk", sum((F.col(c) * (w / total) for c, w in weights.items()), F.lit(0.0)))


def profile_differences(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """A profile against the base, key by key; a key that one lacks counts 0 there."""
    a, b = base.select(key, F.col(value).alias("base")), other.select(key, F.col(value).alias("other"))
    both = a.join(b, key, "full").fillna(0.0, ["base", "other"])
    return both.withColumns({"difference": F.col("other") - F.col("base"), "percent": 100 * (F.col("other") - F.col("base")) / F.nullif(F.col("base"), F.lit(0.0))})


def scan_quality(points: DataFrame, cell: float) -> DataFrame:
    """Points, missing coordinates, repeated places, extent and mean points a filled cell of a scan."""
    rows = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz"))
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull() | F.isnan("x") | F.isnan("y") | F.isnan("z")
    whole = rows.agg(F.count(F.lit(1)).alias("points"), F.count_if(bad).alias("missing"))
    fine = rows.where(~bad)
    places = fine.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("_n"))
    cells = places.groupBy(*(F.floor(F.col(c) / cell).alias(f"_{c}") for c in "xyz")).agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") - 1).alias("_r"), *(f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    out = cells.agg(F.sum("_r").alias("repeated"), F.avg("_m").alias("per_cell"), *((F.max(f"_hi{c}") - F.min(f"_lo{c}")).alias(f"d{c}") for c in "xyz"))
    return whole.crossJoin(out)


def indicator_audit(samples: DataFrame, blocks: DataFrame, value: str, cutoffs: list[float], probabilities: list[str], within: float, sample_id: str = "sample_id", block_id: str = "block_id") -> DataFrame:
    """cutoff, n, share (of samples at or below it), probability (mean of their blocks), correlation, good (over 0.7) of samples against their nearest blocks, as far as one lies within the distance.

    Null where nothing varies or no sample has a block.
    """
    from .spatial import nearest

    own = samples.where(F.col(value).isNotNull())
    near = nearest(own, blocks, 1, None, sample_id, block_id, probabilities, max_radius=within).where(F.col("distance") < within)
    rows = near.join(own.select(F.col(sample_id).alias("target"), F.col(value).alias("_value")), "target")
    pairs = F.array(*(F.struct(F.lit(float(c)).alias("cutoff"), F.when(F.col("_value") <= c, 1.0).otherwise(0.0).alias("i"), F.col(p).cast("double").alias("p")) for c, p in zip(cutoffs, probabilities)))
    rows = rows.select(F.inline(pairs))
    out = rows.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n"), F.avg("i").alias("share"), F.avg("p").alias("probability"), F.covar_pop("i", "p").alias("_c"), F.stddev_pop("i").alias("_i"), F.stddev_pop("p").alias("_p"))
    correlation = F.when((F.col("_i") > 1e-12) & (F.col("_p") > 1e-12), F.col("_c") / (F.col("_i") * F.col("_p")))
    return out.select("cutoff", "n", "share", "probability", correlation.alias("correlation"), F.coalesce(correlation > 0.7, F.lit(False)).alias("good"))


def _nice(v: Column) -> Column:
    """To a tenth below 2, a whole below 5, a quarter of ten below 10, five below 50, else ten; halves to even."""
    return F.when(v < 2, F.bround(v, 1)).when(v < 5, F.bround(v)).when(v < 10, F.bround(v / 2.5) * 2.5).when(v < 50, F.bround(v / 5) * 5).otherwise(F.bround(v / 10) * 10)


def suggested_cells(samples: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """One row: spacing (median distance in plan to the nearest other sample), step (median of the differences over 0.1 of successive levels), and the cell sizes that follow, cell (twice the spacing, 5 to 200) and height (three times the step, 2 to 100; the cell's without one), rounded.

    Every sample is looked at; nulls are left out; fewer than two samples give 25.
    """
    from .running import ranked
    from .spatial import nearest

    rows = samples.where("x is not null and y is not null").select(sample_id, "x", "y")
    near = nearest(rows, rows.withColumnRenamed(sample_id, "_other"), 2, None, sample_id, "_other", axes=("x", "y")).where(F.col("target") != F.col("point"))
    spacing = quantiles(near.groupBy("target").agg(F.min("distance").alias("d")), "d", {"spacing": 0.5})
    levels = ranked(samples.where("z is not null").select(F.col("z").cast("double").alias("z")).distinct(), ["z"], "_k")
    steps = levels.join(levels.select((F.col("_k") - 1).alias("_k"), F.col("z").alias("_up")), "_k").select((F.col("_up") - F.col("z")).alias("d")).where("d > 0.1")
    both = spacing.agg(F.max("spacing").alias("spacing")).crossJoin(F.broadcast(quantiles(steps, "d", {"step": 0.5}).agg(F.max("step").alias("step"))))
    cell = F.coalesce(F.greatest(F.least(F.col("spacing") * 2, F.lit(200.0)), F.lit(5.0)), F.lit(25.0))
    height = F.when(F.col("spacing").isNull(), 25.0).otherwise(F.coalesce(F.greatest(F.least(F.col("step") * 3, F.lit(100.0)), F.lit(2.0)), cell))
    return both.select("spacing", "step", _nice(cell).alias("cell"), _nice(height).alias("height"))
