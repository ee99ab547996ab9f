"""Cash flows, cutoffs, pits, schedules, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import economics as E
from .running import folded, quantiles, running
from .stored import written


def net_present_value(schedule: DataFrame, blocks: DataFrame, value: str, rate: float, block: str = "block_id", period: str = "period") -> DataFrame:
    """Mined blocks' value by period, discounted (period 1 by one year), with its running sum."""
    flows = schedule.where("mined = 1").join(blocks.select(block, value), block, "left").groupBy(period).agg(F.sum(value).alias("cash_flow"), F.count(F.lit(1)).alias("blocks"))
    flows = flows.withColumn("discounted", F.col("cash_flow") * E.discount_factor(F.col(period), rate))
    return running(flows, [period], "discounted", "_before").withColumn("npv", F.coalesce(F.col("_before") + F.col("discounted"), F.col("discounted"))).drop("_before")


def rates_of_return(flows: DataFrame, scenario: str, period: str, flow: str) -> DataFrame:
    """Internal rate, sign changes and present value at 10 % of each scenario's flows in the order of periods."""
    rows = flows.groupBy(scenario).agg(F.array_sort(F.collect_list(F.struct(period, F.col(flow).cast("double").alias("v")))).alias("_f")).withColumn("_f", F.transform("_f", lambda x: x["v"]))
    return rows.select(scenario, E.internal_rate(F.col("_f")).alias("irr"), E.sign_changes(F.col("_f")).alias("sign_changes"), E.present_value(F.col("_f"), 0.10).alias("npv10"))


def cutoff_economics(curve: DataFrame, total_tonnes: float, price: float, recovery: float, mining: float, processing: float, capacity: float, rate: float, loss: float = 0.0, dilution: float = 0.0) -> DataFrame:
    """For each cutoff of a grade-tonnage curve: mined ore, head grade, life, yearly flow and present value."""
    ore = F.col("tonnes") * (1 - loss) * (1 + dilution)
    out = curve.select("cutoff", ore.alias("ore"), (F.col("grade") / (1 + dilution)).alias("head_grade"))
    out = out.withColumn("life", F.greatest(F.ceil(F.col("ore") / capacity), F.lit(1)))
    flow = (F.col("ore") * (F.col("head_grade") * recovery * price - processing) - total_tonnes * mining) / F.col("life")
    out = out.withColumn("yearly_flow", flow)
    return out.withColumn("npv", F.col("yearly_flow") * (1 - F.pow(F.lit(1 + rate), -F.col("life"))) / rate)


def best_cutoff(economics: DataFrame, target: str = "npv") -> DataFrame:
    return economics.agg(F.max_by("cutoff", target).alias("cutoff"), F.max(target).alias(target))


def best_route(blocks: DataFrame, routes: DataFrame, block_id: str, most: int = 10_000) -> DataFrame:
    """The route of highest value of every block (of equals the greatest name); routes are a table with recovery, price, cost, factor, of ``most`` rows at most.

    The routes are one row, an array, that every block looks through where it
    is: nothing is shuffled and no block is repeated.  Without routes a block
    has none.
    """
    known = routes.select("route", *(F.col(c).cast("double").alias(c) for c in ("recovery", "price", "cost", "factor")))
    if known.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} routes")
    listed = known.agg(F.collect_list(F.struct(*known.columns)).alias("_routes"))
    worth = lambda r: (F.col("grade") * r["recovery"] * r["price"] - r["cost"]) * r["factor"] * F.col("tonnes")
    best = F.array_max(F.transform("_routes", lambda r: F.struct(worth(r).alias("worth"), r["route"].alias("route"))))
    return blocks.crossJoin(F.broadcast(listed)).withColumn("_best", best).select(block_id, "_best.route", "_best.worth")


def stripping_ratio(schedule: DataFrame, blocks: DataFrame) -> DataFrame:
    """Waste over ore tonnes by period; 0 without ore."""
    rows = schedule.where("mined = 1").join(blocks.select("block_id", "tonnes", "grade"), "block_id", "left")
    out = rows.groupBy("period").agg(F.sum(F.when(F.col("grade") > 0, F.col("tonnes")).otherwise(0.0)).alias("ore"), F.sum(F.when(F.col("grade") > 0, 0.0).otherwise(F.col("tonnes"))).alias("waste"))
    return out.withColumn("ratio", F.when(F.col("ore") > 0, F.col("waste") / F.col("ore")).otherwise(0.0))


def phases(blocks: DataFrame, level: str, count: int) -> DataFrame:
    """Equal slices of elevation, counted from the bottom."""
    limits = blocks.agg(F.min(level).alias("_lo"), F.max(level).alias("_hi"))
    at = F.floor((F.col(level) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / count, F.lit(0.0))) + 1
    return blocks.crossJoin(F.broadcast(limits)).withColumn("phase", F.least(F.coalesce(at, F.lit(1)), F.lit(count)).cast("int")).drop("_lo", "_hi")


def precedence_violations(edges: DataFrame, schedule: DataFrame, strict: bool = False) -> DataFrame:
    """block, above, issue: the block above is not mined, mined later, or (strict) in the same period."""
    s = schedule.select("block_id", "period", "mined")
    rows = edges.join(s.withColumnsRenamed({"block_id": "block", "period": "p", "mined": "m"}), "block").where("m = 1")
    rows = rows.join(s.withColumnsRenamed({"block_id": "above", "period": "q", "mined": "n"}), "above", "left")
    issue = F.when(F.coalesce(F.col("n"), F.lit(0)) != 1, "not mined").when(F.col("q") > F.col("p"), "mined later").when(F.lit(strict) & (F.col("q") == F.col("p")), "same period")
    return rows.withColumn("issue", issue).where("issue is not null").select("block", "above", "issue")


def greedy_schedule(blocks: DataFrame, capacity: float, order: list, tonnes: str = "tonnes", key: str = "block_id") -> DataFrame:
    """Periods of ``capacity`` tonnes filled in the given order; a block belongs to the period in which its first tonne falls.

    The running sum is two-level, so no task holds all blocks.
    """
    rows = running(blocks, [*order, key], tonnes, "_start")
    return rows.withColumn("period", (F.floor(F.col("_start") / capacity) + 1).cast("int")).drop("_start")


def bucket_filled(units: DataFrame, capacity: float, group: str, order: list[str], tonnes: str = "tonnes") -> DataFrame:
    """Periods per group with reset on overflow: a unit that does not fit opens the next period, an oversized one fills one alone; unknown tonnes count as none."""

    def step(state, x):
        used, t = state[0] if state else 0.0, x[0] or 0.0
        opened = not (used + t <= capacity or used == 0)
        return ((0.0 if opened else used) + t,), (int(opened),)

    done = folded(units, [group], order, [F.col(tonnes).cast("double")], step, {"period": "int"}, counted="period")
    return done.withColumn("period", F.col("period") + 1)


def blended(records: DataFrame, by: list[str], tonnes: str = "tonnes", grades: str = "grades") -> DataFrame:
    """Tonnes and tonnage-weighted grades (a map; a missing grade is 0) of groups."""
    total = records.groupBy(*by).agg(F.sum(tonnes).alias("tonnes"))
    metal = records.select(*by, tonnes, F.explode(grades).alias("element", "g")).groupBy(*by, "element").agg(F.sum(F.col(tonnes) * F.col("g")).alias("metal"))
    joined = total.join(metal, by, "left")
    return joined.select(*by, "tonnes", "element", (F.col("metal") / F.nullif(F.col("tonnes"), F.lit(0.0))).alias("grade"), "metal")


def reconciled(model: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Percent bias of tonnes, grade and metal of ``actual`` against ``model`` (columns tonnes, grade), in keys both have."""
    a, m = actual.select(*by, F.col("tonnes").alias("ta"), F.col("grade").alias("ga")), model.select(*by, F.col("tonnes").alias("tm"), F.col("grade").alias("gm"))
    bias = lambda x, y: 100 * (x - y) / F.nullif(y, F.lit(0.0))
    ta, tm, ga, gm = map(F.col, ("ta", "tm", "ga", "gm"))
    return m.join(a, by).select(*by, tm.alias("model_tonnes"), ta.alias("actual_tonnes"), bias(ta, tm).alias("tonnes_bias"), bias(ga, gm).alias("grade_bias"), bias(ta * ga, tm * gm).alias("metal_bias"))


def recovered(mined: DataFrame, recovery: DataFrame) -> DataFrame:
    """Mined grades by the recovery of (period, element), else of ("all", element), else 1."""
    own = recovery.select("period", "element", F.col("recovery").alias("_r"))
    every = recovery.where("period = 'all'").select("element", F.col("recovery").alias("_a"))
    return mined.join(own, ["period", "element"], "left").join(every, "element", "left").withColumn("recovered_grade", F.col("grade") * F.coalesce("_r", "_a", F.lit(1.0))).drop("_r", "_a")


def ore_waste(blocks: DataFrame, rules: list[tuple[str, float]]) -> DataFrame:
    """1 where any (column, cutoff) is met, else 0; tonnes and plain mean grade of each."""
    met = F.lit(False)
    for column, cutoff in rules:
        met = met | F.coalesce(F.col(column) >= cutoff, F.lit(False))
    return blocks.groupBy(met.cast("int").alias("ore")).agg(F.count(F.lit(1)).alias("n"), F.sum("tonnes").alias("tonnes"), F.avg(rules[0][0]).alias("mean_grade"))


def allocated_trucks(routes: DataFrame, total_hours: float) -> DataFrame:
    """Truck hours by need, the largest first, until the fleet's hours are used up."""
    rows = running(routes, [F.desc("required"), "route"], F.col("required").cast("double"), "_before")
    left = F.lit(float(total_hours)) - F.coalesce("_before", F.lit(0.0))
    return rows.withColumn("allocated", F.greatest(F.least(F.col("required"), left), F.lit(0.0))).drop("_before")


def emissions(activity: DataFrame, factors: DataFrame) -> DataFrame:
    """CO2e of each row of (period, kind, amount) by the kind's factor (0 without one), with the period's total."""
    rows = activity.join(factors, "kind", "left").withColumn("co2e", F.col("amount") * F.coalesce("factor", F.lit(0.0)))
    return rows.groupBy("period").agg(F.sum("co2e").alias("co2e"))


def risk_adjusted_rate(flows: DataFrame, scenario: str, period: str, flow: str, alpha: float = 0.8) -> DataFrame:
    """One row: the rate of return that a share ``alpha`` of the scenarios reaches, and what the scenarios are like.

    rate (the 1 - alpha quantile of their internal rates), scenarios, valid (those
    with a rate: others keep their sign or lose money at every rate, and count as
    not reaching any), mean_rate, deviation, reached (share of all scenarios whose
    rate is at least that), more_rates (scenarios whose flows change sign more
    than once, whose rate is one of several), mean_npv10, least_npv10.  A
    scenario's flows are as many as it has periods; everything else is aggregated.
    """
    rows = written(rates_of_return(flows, scenario, period, flow), "rates")
    found = quantiles(rows, "irr", {"rate": 1.0 - alpha})
    sums = rows.agg(F.count(F.lit(1)).alias("scenarios"), F.count("irr").alias("valid"), F.avg("irr").alias("mean_rate"), F.stddev_pop("irr").alias("deviation"), F.count(F.when(F.col("sign_changes") > 1, 1)).alias("more_rates"), F.avg("npv10").alias("mean_npv10"), F.min("npv10").alias("least_npv10"))
    both = sums.crossJoin(F.broadcast(found))
    reached = rows.crossJoin(F.broadcast(found)).agg(F.avg(F.when(F.col("irr") >= F.col("rate"), 1.0).otherwise(0.0)).alias("reached"))
    return both.crossJoin(F.broadcast(reached)).select("rate", "scenarios", "valid", "mean_rate", "deviation", "reached", "more_rates", "mean_npv10", "least_npv10")
