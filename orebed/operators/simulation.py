"""Simulation and resampling: one row a realisation and node, seeds by hash.

Random numbers come from hashes of (seed, realisation, row id), so they do not
depend on partitions or on repeated tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rock import rockburst_index
from .running import around, quantiles, ranked, running
from .spatial import AXES, kernel
from .stored import shards, written


def uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), from 52 bits of the md5 of the seed and the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def standard_normal(seed: int, *keys: Column) -> Column:
    """Two hashed uniforms by the polar cosine form."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(uniform(seed + 7919, *keys) * 6.283185307179586)


#: The published coefficients of the rational approximation of the inverse normal, middle above and below, tail above and below.
QUANTILE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """Inverse normal, rational approximation with relative error below 1.2e-9."""
    a, b, c, d = QUANTILE

    def poly(x: Column, k) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q, tail = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    edge = poly(tail, c) / poly(tail, d)
    return F.when(p < 0.02425, edge).when(p > 1 - 0.02425, -edge).otherwise(q * poly(q * q, a) / poly(q * q, b))


#: The published coefficients of the rational approximation of the normal distribution function, above and below.
PROBABILITY = (
    (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def normal_probability(z: Column) -> Column:
    """Normal distribution function, rational approximation with an error below 1e-14; a continued fraction beyond 7 deviations."""
    a, b = PROBABILITY
    x = F.abs(z)

    def poly(k) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    density = F.exp(-x * x / 2)
    far = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = x + F.lit(k) / far
    tail = F.when(x < 7.07106781186547, density * poly(a) / poly(b)).otherwise(density / far / 2.506628274631)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_scores(df: DataFrame, value: str, weight: str | None = None, tie: str = "sample_id") -> DataFrame:
    """Normal scores by the middle of each value's step of the weighted distribution, ties by id; the running weight is two-level."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    total = rows.agg(F.sum("_w").alias("_all"))
    rows = running(rows, [value, tie], "_w", "_base").crossJoin(F.broadcast(total))
    p = (F.col("_base") + F.col("_w") / 2) / F.col("_all")
    return rows.withColumn("normal_score", normal_quantile(F.greatest(F.least(p, F.lit(1 - 1e-10)), F.lit(1e-10)))).drop("_w", "_all", "_base")


def back_transformed(df: DataFrame, score: str, fitted: DataFrame, value: str, tie: str = "sample_id") -> DataFrame:
    """Scores turned into values by monotone cubic interpolation of the fitted (normal_score, value) steps; beyond their ends the least and the greatest value.

    A knot's slope needs the knots before and after it, found by equi joins on
    their rank; a score's knots come from ranges of both tables.
    """
    knots = written(ranked(fitted.select(F.col("normal_score").alias("g"), F.col(value).cast("double").alias("v"), tie), ["g", tie], "k").drop(tie), "knots")
    last = knots.agg(F.max("k").alias("n"))
    shifted = lambda by, n: knots.select((F.col("k") + by).alias("k"), F.col("g").alias(f"g{n}"), F.col("v").alias(f"v{n}"))
    wide = knots.crossJoin(F.broadcast(last))
    for by, n in ((1, "p"), (-1, "n"), (2, "pp"), (-2, "nn")):
        wide = wide.join(shifted(by, n), "k", "left")
    h = lambda a, b: F.col(f"g{b}") - F.col(f"g{a}")
    m = lambda a, b: (F.col(f"v{b}") - F.col(f"v{a}")) / h(a, b)

    def edge(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
        d = F.when(h1.isNull(), m0).otherwise(((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1))
        return F.when(F.signum(d) != F.signum(m0), 0.0).when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0).otherwise(d)

    h0, h1, m0, m1 = h("p", ""), h("", "n"), m("p", ""), m("", "n")
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when((m0 * m1) <= 0, 0.0).otherwise((w1 + w2) / (w1 / m0 + w2 / m1))
    slope = F.when(F.col("n") == 1, 0.0).when(F.col("k") == 1, edge(h1, h("n", "nn"), m1, m("n", "nn"))).when(F.col("k") == F.col("n"), edge(h0, h("pp", "p"), m0, m("pp", "p"))).otherwise(inner)
    wide = wide.select(F.col("g").alias(score), "v", slope.alias("d"))
    found = around(df, wide, score)
    a, b = F.col("_a"), F.col("_b")
    step = b[score] - a[score]
    t = (F.col(score) - a[score]) / F.nullif(step, F.lit(0.0))
    curve = (1 + 2 * t) * (1 - t) * (1 - t) * a["v"] + t * (1 - t) * (1 - t) * step * a["d"] + t * t * (3 - 2 * t) * b["v"] + t * t * (t - 1) * step * b["d"]
    out = F.when(F.col(score).isNull(), None).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).when(step == 0, a["v"]).otherwise(curve)
    return found.withColumn("value", out).drop("_a", "_b")


def moving_average_fields(spark, counts: tuple[int, int, int], size: tuple[float, float, float], model: dict, realisations: int, seed: int = 1) -> DataFrame:
    """realisation, block_id, value: unconditional Gaussian fields of spherical covariance.

    The mean of independent noise over a ball whose diameter is the range has
    that covariance.  The noise at a place is a hash, so every node is made for
    itself, in any task, and no field is ever in one place.
    """
    reach = [int(model["range"] / 2 / s) for s in size]
    near = [(i, j, k) for i in range(-reach[0], reach[0] + 1) for j in range(-reach[1], reach[1] + 1) for k in range(-reach[2], reach[2] + 1) if (i * size[0]) ** 2 + (j * size[1]) ** 2 + (k * size[2]) ** 2 <= (model["range"] / 2) ** 2]
    nx, ny, nz = counts
    nodes = spark.range(nx * ny * nz * realisations).select(F.floor(F.col("id") / (nx * ny * nz)).alias("realisation"), (F.col("id") % (nx * ny * nz)).alias("block_id"))
    at = (F.col("block_id") % nx, F.floor(F.col("block_id") / nx) % ny, F.floor(F.col("block_id") / (nx * ny)))
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in near))
    noise = F.transform(table, lambda o: standard_normal(seed, F.col("realisation"), at[0] + o["i"], at[1] + o["j"], at[2] + o["k"]))
    smooth = F.aggregate(noise, F.lit(0.0), lambda a, v: a + v) * (model["sill"] / len(near)) ** 0.5
    rough = standard_normal(seed + 1, F.col("realisation"), F.col("block_id")) * model["nugget"] ** 0.5
    return nodes.select("realisation", "block_id", (smooth + rough).alias("value"))


def from_distribution(blocks: DataFrame, probabilities: list[str], cutoffs: list[float], low: float, high: float, realisations: int, block_id: str = "block_id", seed: int = 1) -> DataFrame:
    """Independent draws from each block's distribution of P(value <= cutoff), straight between the cutoffs."""
    rows = blocks.withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))))
    u = uniform(seed, F.col("realisation"), F.col(block_id))
    p = [F.lit(0.0), *map(F.col, probabilities), F.lit(1.0)]
    z = [low, *cutoffs, high]
    draw = None
    for a, b, za, zb in zip(p, p[1:], z, z[1:]):
        value = za + (u - a) / F.nullif(b - a, F.lit(0.0)) * (zb - za)
        draw = F.when(u <= b, value) if draw is None else draw.when(u <= b, value)
    return rows.select(block_id, "realisation", draw.alias("value"))


#: Draws that a row may have: of a Poisson(1) number more have a probability below 2 ** -53, which no double in (0, 1) tells.
MOST_DRAWS = 18


def _drawn(df: DataFrame, row_id: str, iterations: int, seed: int) -> DataFrame:
    """Every row with every iteration and _n, how often it is drawn there: Poisson(1), by hash, so no row is moved."""
    rows = df.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    u, steps, total, term = uniform(seed, F.col("iteration"), F.col(row_id)), F.lit(0), 0.0, float(np.exp(-1))
    for k in range(1, MOST_DRAWS + 1):
        total += term
        steps = steps + F.when(u > total, 1).otherwise(0)
        term /= k
    return rows.withColumn("_n", steps)


def bootstrap_means(df: DataFrame, value: str, row_id: str, iterations: int, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """Means of resampled rows, of the whole or of groups."""
    rows = _drawn(df.where(F.col(value).isNotNull()), row_id, iterations, seed)
    return rows.groupBy(*(by or []), "iteration").agg((F.sum(F.col("_n") * F.col(value)) / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"))


def bootstrap_ratios(df: DataFrame, numerator: str, denominator: str, row_id: str, iterations: int, seed: int = 1) -> DataFrame:
    """Ratios of the sums of resampled rows; 0 where the denominator is not positive."""
    rows = _drawn(df, row_id, iterations, seed)
    low = F.sum(F.col("_n") * F.col(denominator))
    return rows.groupBy("iteration").agg(F.when(low > 0, F.sum(F.col("_n") * F.col(numerator)) / low).otherwise(0.0).alias("ratio"))


def permuted_difference(df: DataFrame, value: str, first: Column, row_id: str, iterations: int, seed: int = 1) -> DataFrame:
    """Difference of the means of the rows of ``first`` and of the others, and the share of iterations in which chance groups differ as much.

    A row is in the first group of an iteration with the first group's share as
    probability, by hash, so no row is moved.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_first", F.coalesce(first, F.lit(False)))
    mean = lambda test: F.sum(F.when(test, F.col(value))) / F.nullif(F.count(F.when(test, 1)), F.lit(0))
    seen = rows.agg((mean(F.col("_first")) - mean(~F.col("_first"))).alias("difference"), F.avg(F.col("_first").cast("double")).alias("_share"))
    drawn = rows.crossJoin(F.broadcast(seen)).withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    drawn = drawn.withColumn("_in", uniform(seed, F.col("iteration"), F.col(row_id)) < F.col("_share"))
    chance = drawn.groupBy("iteration").agg((mean(F.col("_in")) - mean(~F.col("_in"))).alias("_d"), F.max("difference").alias("difference"))
    return chance.agg(F.max("difference").alias("difference"), F.avg((F.abs("_d") >= F.abs("difference")).cast("double")).alias("p_value"))


def corrected_interval(df: DataFrame, value: str, row_id: str, iterations: int, level: float = 0.95, seed: int = 1) -> tuple[float, float, float]:
    """(low, high, mean): the bias-corrected and accelerated interval of the mean; the draws' shares and three moments reach the driver."""
    from statistics import NormalDist

    rows, normal = df.where(F.col(value).isNotNull()), NormalDist()
    mean = rows.agg(F.avg(value)).first()[0]
    off = F.col(value) - F.lit(float(mean))
    cubes, squares = rows.agg(F.sum(off * off * off), F.sum(off * off)).first()
    draws = written(bootstrap_means(rows, value, row_id, iterations, seed), "draws")
    below = draws.agg(F.avg((F.col("mean") < mean).cast("double"))).first()[0]
    bias = normal.inv_cdf(below) if 0 < below < 1 else 0.0
    speed = cubes / (6 * squares**1.5) if squares else 0.0
    share = lambda tail: min(max(normal.cdf(bias + (bias + normal.inv_cdf(tail)) / (1 - speed * (bias + normal.inv_cdf(tail)))), 0.001), 0.999)
    found = quantiles(draws, "mean", {"low": share((1 - level) / 2), "high": share((1 + level) / 2)}).first()
    return found["low"], found["high"], mean


def confidence(draws: DataFrame, statistic: str, level: float = 0.9, by: list[str] | None = None) -> DataFrame:
    tail = (1 - level) / 2
    return draws.groupBy(*(by or [])).agg(F.avg(statistic).alias("mean"), F.stddev_samp(statistic).alias("std"), F.percentile(statistic, F.lit(tail)).alias("low"), F.percentile(statistic, F.lit(1 - tail)).alias("high"))


def latin_hypercube(spark, n: int, distributions: dict[str, tuple], seed: int = 1) -> DataFrame:
    """draw and a column for each of (kind, a, b[, mode]): normal, lognormal, uniform, triangular; each dimension's n strata in an order by hash."""
    out = spark.range(n).withColumnRenamed("id", "draw")
    for k, (name, (kind, *args)) in enumerate(distributions.items()):
        out = ranked(out.withColumn("_h", uniform(seed, F.lit(k), F.col("draw"))), ["_h", "draw"], "_r")
        out = out.withColumn("_u", (F.col("_r") - uniform(seed + k + 1, F.col("draw"))) / n).drop("_h", "_r")
        u = F.col("_u")
        if kind == "uniform":
            value = args[0] + u * (args[1] - args[0])
        elif kind == "triangular":
            a, b, c = args[0], args[1], args[2]
            at = (c - a) / (b - a)
            value = F.when(u < at, a + F.sqrt(u * (b - a) * (c - a))).otherwise(b - F.sqrt((1 - u) * (b - a) * (b - c)))
        else:
            value = args[0] + args[1] * normal_quantile(u)
            value = F.exp(value) if kind == "lognormal" else value
        out = out.withColumn(name, value)
    return out.drop("_u")


def price_paths(spark, scenarios: int, periods: int, start: float, drift: float, reversion: float, volatility: float, seed: int = 1, floor: float = 0.01) -> DataFrame:
    """scenario, period, price: a mean-reverting path, folded over the periods of a scenario's hashed noise."""
    noise = F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda t: standard_normal(seed, F.col("id"), t))
    step = lambda path, e: F.concat(path, F.array(F.greatest(F.element_at(path, -1) * F.exp(drift + reversion * (start - F.element_at(path, -1)) / start + volatility * e), F.lit(floor))))
    path = F.aggregate(noise, F.array(F.lit(float(start))), step)
    return spark.range(scenarios).select(F.col("id").alias("scenario"), F.posexplode(path).alias("period", "price"))


def shell_probability(shells: DataFrame, block: str, mined: str, robust: float = 0.8, fringe: float = 0.2) -> DataFrame:
    """Share of scenarios that mine a block, and its class."""
    p = shells.groupBy(block).agg(F.avg(F.col(mined).cast("double")).alias("p_mined"))
    return p.withColumn("class", F.when(F.col("p_mined") >= robust, "robust").when(F.col("p_mined") <= fringe, "fringe").otherwise("marginal"))


def grade_scenarios(blocks: DataFrame, grade: str, uncertainty: float, scenarios: int, block_id: str = "block_id", seed: int = 1) -> DataFrame:
    """block_id, scenario, grade: independent lognormal grades of each block whose mean is its own; none for a grade of 0."""
    rows = blocks.where(F.col(grade) > 0).withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(scenarios))))
    drawn = F.exp(F.log(grade) - 0.5 * uncertainty * uncertainty + uncertainty * standard_normal(seed, F.col("scenario"), F.col(block_id)))
    return rows.select(block_id, "scenario", drawn.alias("grade"))


def value_scenarios(grades: DataFrame, blocks: DataFrame, draws: DataFrame, rate: float) -> DataFrame:
    """Value of each grade scenario in each draw of price and cost: metal by scenario and period is summed before it meets the draws."""
    per = grades.join(blocks.select("block_id", "tonnes", "period"), "block_id").groupBy("scenario", "period").agg(F.sum(F.col("tonnes") * F.col("grade")).alias("_m"), F.sum("tonnes").alias("_t"))
    flow = (F.col("_m") * F.col("recovery") * F.col("price") / 100 - F.col("_t") * (F.col("mining") + F.col("processing"))) * F.pow(F.lit(1.0 + rate), -F.col("period"))
    return per.crossJoin(draws).groupBy("scenario", "draw").agg(F.sum(flow).alias("npv"))


def hazard_realisations(events: DataFrame, grid: DataFrame, radius: float, realisations: int, magnitude: str = "magnitude", place: float = 10.0, error: float = 0.2, power: float = 2.0, event_id: str = "event_id", grid_id: str = "block_id", seed: int = 1) -> DataFrame:
    """grid_id, realisation, hazard: hazard volumes of catalogues whose places and magnitudes are drawn anew.

    An event moves by normal draws of deviation ``place`` along each axis, its
    magnitude by one of ``error`` (not below 0); draws are hashed from its id
    and the realisation.  The hazard is the sum over events in reach of
    10 ** magnitude / (distance + 1e-6) ** power, over the greatest of its
    realisation.  Events without a magnitude or place are left out.
    """
    known = events.where(" and ".join(f"{c} is not null" for c in (*AXES, magnitude))).select(event_id, *AXES, F.col(magnitude).cast("double").alias("_m"))
    known = known.repartition(max(2, shards(events.sparkSession)), event_id)  # a small file is one task, whatever is drawn for its rows
    rows = known.withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))))
    draw = lambda k: standard_normal(seed + k, F.col("realisation"), F.col(event_id))
    moved = {a: F.col(a) + place * draw(k) for k, a in enumerate(AXES)}
    rows = rows.withColumns(moved).withColumn("_m", F.greatest(F.col("_m") + error * draw(3), F.lit(0.0)))
    rows = written(rows.select(*AXES, "realisation", "_m"), "catalogues")
    top = rows.agg(F.max("_m").alias("_top"))  # one row; a factor common to all does not change a hazard
    rows = rows.crossJoin(F.broadcast(top)).withColumn("_weight", F.pow(F.lit(10.0), F.col("_m") - F.col("_top")))
    sums = written(kernel(grid, rows, radius, "_weight", float(power), "realisation"), "hazards")
    greatest = sums.groupBy("realisation").agg(F.max("_v").alias("_greatest"))
    sums = sums.join(F.broadcast(greatest) if realisations <= 10_000 else greatest, "realisation").withColumnsRenamed({"realisation": "_of", **{a: f"_p{a}" for a in AXES}})
    frame = grid.select(grid_id, *AXES, F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))).alias("realisation"))
    out = frame.join(sums, [*(F.col(a).cast("double") == F.col(f"_p{a}") for a in AXES), F.col("realisation") == F.col("_of")], "left")
    return out.select(grid_id, "realisation", F.coalesce(F.col("_v") / F.col("_greatest"), F.lit(0.0)).alias("hazard"))


def hazard_by_node(volumes: DataFrame, threshold: float, grid_id: str = "block_id") -> DataFrame:
    """Of each node mean, deviation (of the population) and greatest hazard, and the share of realisations at or above a threshold."""
    h = F.col("hazard")
    return volumes.groupBy(grid_id).agg(F.avg(h).alias("mean"), F.stddev_pop(h).alias("deviation"), F.max(h).alias("greatest"), F.avg((h >= threshold).cast("double")).alias("exceedance"))


def hazard_summary(volumes: DataFrame) -> DataFrame:
    """One row over all nodes and realisations: mean, deviation, least, greatest, p10, p50, p90."""
    spread = quantiles(volumes, "hazard", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    whole = volumes.agg(F.avg("hazard").alias("mean"), F.stddev_pop("hazard").alias("deviation"), F.min("hazard").alias("least"), F.max("hazard").alias("greatest"))
    return whole.crossJoin(F.broadcast(spread))


def rockburst_realisations(volumes: DataFrame, rock: DataFrame, rating_error: float = 5.0, stress_error: float = 0.1, node_id: str = "block_id", seed: int = 11, **index) -> DataFrame:
    """node, realisation, hazard: the rockburst index of each node in each realisation of the hazard, with its rating and stress drawn anew.

    ``rock`` has rating (0 to 100) and stress by node; ratings are drawn about
    their own with deviation ``rating_error`` and kept in 0 to 100, stresses with
    ``stress_error`` times the greatest of all and kept from 0 on.  Each
    realisation is drawn from the given values, not from the one before.  The
    result has the columns of a hazard volume, so it is summed up alike.
    """
    top = rock.agg(F.max("stress").alias("_top"))
    keys = (F.col("realisation"), F.col(node_id))
    rows = volumes.join(rock.select(node_id, "rating", "stress"), node_id).crossJoin(F.broadcast(top))
    rating = F.least(F.greatest(F.col("rating") + rating_error * standard_normal(seed, *keys), F.lit(0.0)), F.lit(100.0))
    stress = F.greatest(F.col("stress") + stress_error * F.col("_top") * standard_normal(seed + 1, *keys), F.lit(0.0))
    return rows.select(node_id, "realisation", rockburst_index(F.col("hazard"), rating, stress, **index).alias("hazard"))
