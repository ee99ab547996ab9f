"""Phases, stopes, pushbacks, shells, haulage and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import folded, ranked, running
from .stored import written


def phased_schedule(schedule: DataFrame, blocks: DataFrame, share: float = 0.75) -> DataFrame:
    """The schedule with phases (1 where a block has none), no phase starting before the period at the ``share`` position of the phase before it (of the given periods)."""
    rows = schedule.join(blocks.select("block_id", "phase"), "block_id", "left").withColumn("phase", F.coalesce("phase", F.lit(1)).cast("int"))
    # The block at a position is found from the numbers of blocks by phase and period.
    sizes = rows.groupBy("phase", "period").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("phase").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumns({"_to": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy("phase"))})
    at = F.floor(F.col("_all") * share)
    starts = sizes.where((F.col("_to") > at) & (F.col("_to") - F.col("_n") <= at)).select((F.col("phase") + 1).alias("phase"), F.col("period").alias("_start"))
    return rows.join(starts, "phase", "left").withColumn("period", F.greatest("period", F.coalesce("_start", F.lit(0)))).drop("_start")


def scheduling_units(blocks: DataFrame, by: list[str], grades: list[str], material: str, tonnes: str = "tonnes") -> DataFrame:
    """Blocks, tonnes, weighted grades and the material of most tonnes (of equals the least name) of groups."""
    parts = blocks.groupBy(*by, material).agg(F.count(F.lit(1)).alias("_n"), F.sum(tonnes).alias("_t"), *(F.sum(F.col(g) * F.col(tonnes)).alias(f"_m_{g}") for g in grades))
    first = F.min_by(material, F.struct(-F.col("_t"), F.col(material)))
    out = parts.groupBy(*by).agg(F.sum("_n").alias("blocks"), F.sum("_t").alias("tonnes"), first.alias("material"), *(F.sum(f"_m_{g}").alias(f"_m_{g}") for g in grades))
    return out.select(*by, "blocks", "tonnes", "material", *(F.when(F.col("tonnes") > 0, F.col(f"_m_{g}") / F.col("tonnes")).otherwise(0.0).alias(g) for g in grades))


def grid_stopes(blocks: DataFrame, grade: str, least: float, size: tuple[float, float, float], block: tuple[float, float, float], worth: Column | None = None, density: float = 2.7) -> DataFrame:
    """Stopes of ``size`` (along x, y, z) of the blocks worth at least ``least``: blocks, tonnes, plain mean grade and worth."""
    value = worth if worth is not None else F.col(grade) * 60.0 * 0.85 - 25.0
    rows = blocks.withColumn("_w", value).where((F.col("_w") >= least) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    cells = [F.floor(F.col(a) / s).alias(f"i{a}") for a, s in zip("xyz", size)]
    one = block[0] * block[1] * block[2] * density
    return rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("blocks"), (F.count(F.lit(1)) * one).alias("tonnes"), F.avg(grade).alias("grade"), F.avg("_w").alias("worth"))


def cave_footprint(blocks: DataFrame, inside: Column, cell: float, level: float) -> DataFrame:
    """Columns and levels of the blocks inside a footprint: blocks, tonnes, weighted grade."""
    rows = blocks.where(inside)
    return rows.groupBy(F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy"), F.floor(F.col("z") / level).alias("level")).agg(F.count(F.lit(1)).alias("blocks"), F.sum("tonnes").alias("tonnes"), (F.sum(F.col("tonnes") * F.col("grade")) / F.sum("tonnes")).alias("grade"))


def pushback_totals(shells: DataFrame, groups: DataFrame) -> DataFrame:
    """Shells, tonnes and value of each pushback; groups has pushback, shell."""
    return groups.join(shells, "shell").groupBy("pushback").agg(F.count(F.lit(1)).alias("shells"), F.sum("tonnes").alias("tonnes"), F.sum("value").alias("value"))


def pushbacks_by_value(shells: DataFrame, count: int) -> DataFrame:
    """shell, pushback: shells by value a tonne, the richest first; a pushback is closed once it holds 1 / ``count`` of all tonnes.

    The running sum of tonnes is two-level; each of the ``count`` pushbacks is
    closed by one lookup in it.
    """
    rate = F.when(F.col("tonnes") > 0, F.col("value") / F.col("tonnes")).otherwise(0.0)
    rows = shells.select(F.col("shell").cast("bigint").alias("shell"), (-rate).alias("_k"), F.col("tonnes").cast("double").alias("_t"))
    rows = ranked(running(rows, ["_k", "shell"], "_t", "_held"), ["_k", "shell"], "_turn")
    rows = written(rows, "pushbacks")
    total = rows.agg(F.sum("_t")).first()[0]
    starts, base = [1], 0.0
    while total is not None and len(starts) < count:
        first = rows.where((F.col("_turn") > starts[-1]) & (F.col("_held") - base >= total / count)).agg(F.min(F.struct("_turn", "_held"))).first()[0]
        if first is None:
            break
        starts.append(first["_turn"])
        base = first["_held"]
    return rows.select("shell", sum((F.when(F.col("_turn") >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int").alias("pushback"))


def shells_in_periods(shells: DataFrame, capacity: float, periods: int) -> DataFrame:
    """Shells in order, a period of ``capacity`` tonnes at a time: a shell that does not fit opens the next period and is cut to its capacity; in the last period shells that do not fit are left out."""
    capacity = float(capacity)

    def opening(state, x):
        room, opened = state[0] if state else capacity, 0
        if x[0] > room:
            room, opened = capacity, 1
        taken = min(x[0], room)
        return (room - taken,), (opened, taken)

    def last(state, x):  # the shell that opens the last period is cut, but a first period is opened by none
        room = state[0] if state else capacity
        taken = min(x[0], room) if x[0] <= room or (state is None and periods > 1) else None
        return (room - (taken or 0.0),), (taken,)

    rows = shells.where("tonnes > 0").select(F.col("shell").cast("bigint").alias("shell"), F.col("tonnes").cast("double").alias("_t"))
    rows = folded(rows, [], ["shell"], [F.col("_t")], opening, {"period": "int", "tonnes": "double"}, counted="period").withColumn("period", F.col("period") + 1)
    rows = written(rows, "shells")
    end = folded(rows.where(F.col("period") >= periods).select("shell", "_t"), [], ["shell"], [F.col("_t")], last, {"tonnes": "double"})
    end = end.where("tonnes is not null").select("shell", F.lit(periods).alias("period"), "tonnes")
    return rows.where(F.col("period") < periods).select("shell", "period", "tonnes").unionByName(end)


def split_over(schedule: DataFrame, name: str, parts: list[str], out_of: int | None = None) -> DataFrame:
    """Each row's tonnes in equal parts under the given names; with ``out_of`` the parts are of that many, the rest is not mined."""
    rows = schedule.withColumn(name, F.explode(F.array(*map(F.lit, parts))))
    return rows.withColumn("tonnes", F.col("tonnes") / (out_of or len(parts)))


def haulage(schedule: DataFrame, routes: DataFrame, payload: float, available_hours: float) -> DataFrame:
    """Of each period: scheduled and effective tonnes, truck hours needed (of routes that are known), utilisation, shortfalls and routes; routes has source, destination, cycle_minutes."""
    per = schedule.groupBy("period", "source", "destination").agg(F.sum("tonnes").alias("_t"))
    rows = per.join(routes, ["source", "destination"], "left")
    hours = F.when((F.col("_t") > 0) & F.col("cycle_minutes").isNotNull(), F.col("_t") / payload * F.col("cycle_minutes") / 60)
    out = rows.groupBy("period").agg(F.sum("_t").alias("scheduled_tonnes"), F.coalesce(F.sum(hours), F.lit(0.0)).alias("required_hours"), F.count(hours).alias("routes"))
    need, have = F.col("required_hours"), F.lit(float(available_hours))
    effective = F.when(need > have, F.col("scheduled_tonnes") * have / need).otherwise(F.col("scheduled_tonnes"))
    return out.select("period", "scheduled_tonnes", effective.alias("effective_tonnes"), "required_hours", (need / have * 100).alias("utilisation"), F.greatest(need - have, F.lit(0.0)).alias("shortfall_hours"), (F.col("scheduled_tonnes") - effective).alias("shortfall_tonnes"), "routes")


def chosen_shells(prices: DataFrame, shells: DataFrame, base: float) -> DataFrame:
    """For each price the shell of the largest revenue factor not above price / base, the nearest one, and tonnes interpolated between the neighbours; factors beyond the shells' count as their ends.

    An as-of lookup: prices and shells in one window, in the order of factors.
    """
    ends = shells.agg(F.min("factor").alias("_lo"), F.max("factor").alias("_hi"))
    want = prices.crossJoin(F.broadcast(ends)).select("price", F.greatest(F.least(F.col("price") / base, F.col("_hi")), F.col("_lo")).alias("_f"), F.lit(None).cast("struct<factor:double,shell:bigint,tonnes:double>").alias("_s"))
    have = shells.select(F.lit(None).cast("double").alias("price"), F.col("factor").cast("double").alias("_f"), F.struct(F.col("factor").cast("double").alias("factor"), F.col("shell").cast("bigint").alias("shell"), F.col("tonnes").cast("double").alias("tonnes")).alias("_s"))
    both = have.unionByName(want)
    order = Window.orderBy("_f", F.col("_s").isNull())  # shells and prices are few
    both = both.withColumns({"_a": F.last("_s", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first("_s", True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("price is not null")
    a, b, f = F.col("_a"), F.coalesce("_b", "_a"), F.col("_f")
    near = F.when(f - a["factor"] <= b["factor"] - f, a["shell"]).otherwise(b["shell"])
    share = F.when(b["factor"] > a["factor"], (f - a["factor"]) / (b["factor"] - a["factor"])).otherwise(0.0)
    return both.select("price", f.alias("factor"), a["shell"].alias("floor_shell"), near.alias("nearest_shell"), (a["tonnes"] + share * (b["tonnes"] - a["tonnes"])).alias("tonnes"))


def compared_scenarios(scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """Completed scenarios with their results (null without), beside the best, worst and mean present value of all."""
    rows = scenarios.where("status = 'completed'").join(results, "scenario", "left")
    totals = rows.agg(F.max("npv").alias("best_npv"), F.min("npv").alias("worst_npv"), F.avg("npv").alias("mean_npv"))
    return rows.crossJoin(F.broadcast(totals))


def scenario_grid(parameters: dict[str, list], spark) -> DataFrame:
    """All combinations of parameter values, numbered in the order of the last parameter fastest."""
    out, step = None, 1
    for values in parameters.values():
        step *= len(values)
    out = spark.range(step).withColumnRenamed("id", "instance")
    for name, values in parameters.items():
        step //= len(values)
        out = out.withColumn(name, F.element_at(F.array(*map(F.lit, values)), ((F.floor(F.col("instance") / step) % len(values)) + 1).cast("int")))
    return out


def disturbance(schedule: DataFrame, pit_area: float = 0.1, dump_area: float = 0.3, strip_ratio: float = 3.0) -> DataFrame:
    """Hectares disturbed by a period's ore (areas a thousand tonnes) and its waste."""
    return schedule.select("period", (F.col("ore") / 1000 * pit_area + F.col("ore") * strip_ratio / 1000 * dump_area).alias("area"))


def curve_loss(reference: DataFrame, estimate: DataFrame, key: str = "cutoff", value: str = "tonnes") -> DataFrame:
    """Trapezoid of the absolute difference of two curves over their common points, one apart."""
    both = reference.select(key, F.col(value).alias("_a")).join(estimate.select(key, F.col(value).alias("_b")), key).withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    order = Window.orderBy(key)  # a curve has few points
    return both.withColumn("_n", F.lead("_d").over(order)).agg(F.coalesce(F.sum((F.col("_d") + F.col("_n")) / 2), F.lit(0.0)).alias("loss"))


def certainty_equivalent(samples: DataFrame, value: str, aversion: float) -> DataFrame:
    """The certain value of equal exponential utility: -ln(mean exp(-a v)) / a, taken about the least value so that nothing overflows; the mean for no aversion."""
    rows = samples.where(F.col(value).isNotNull())
    if aversion == 0:
        return rows.agg(F.avg(value).alias("value"))
    least = rows.agg(F.min(value).alias("_lo"))
    return rows.crossJoin(F.broadcast(least)).agg(F.max("_lo").alias("_lo"), F.avg(F.exp(-aversion * (F.col(value) - F.col("_lo")))).alias("_u")).select((F.col("_lo") - F.log("_u") / aversion).alias("value"))


def failure_share(samples: DataFrame, factor: str, by: list[str] | None = None) -> DataFrame:
    """Share of safety factors below 1."""
    return samples.groupBy(*(by or [])).agg(F.count(factor).alias("n"), F.coalesce(F.avg((F.col(factor) < 1).cast("double")), F.lit(0.0)).alias("failure_probability"))


def tornado(results: DataFrame, parameter: str, low: str, high: str) -> DataFrame:
    """Parameters by the swing of the result between their ends, the widest first."""
    rows = results.withColumn("swing", F.abs(F.col(high) - F.col(low)))
    return ranked(rows, [F.desc("swing"), parameter])


def fleet_capacity(trucks: DataFrame) -> DataFrame:
    """Tonnes an hour at two trips an hour."""
    return trucks.agg(F.sum(F.col("payload") * F.col("availability") * F.col("utilisation") * 2.0).alias("capacity"))


def sloped_precedence(blocks: DataFrame, size: tuple[float, float, float], sectors: list[tuple[float, float, float]], default: float, levels: int = 1) -> DataFrame:
    """block, above: for each block those up to ``levels`` above it that lie inside its cone, whose slope depends on the azimuth to them.

    ``sectors`` are (from, to, slope) in degrees, azimuths clockwise from north,
    a sector that passes north having from > to.  The offsets are found once;
    the arcs are an equi join on cells.
    """
    import math

    widest = max(levels * size[2] / math.tan(math.radians(s)) for s in [default, *(s for _, _, s in sectors)])
    reach = [int(widest / s + 1e-9) for s in size[:2]]
    offsets = []
    for k in range(1, levels + 1):
        for i in range(-reach[0], reach[0] + 1):
            for j in range(-reach[1], reach[1] + 1):
                dx, dy = i * size[0], j * size[1]
                azimuth = math.degrees(math.atan2(dx, dy)) % 360
                slope = next((s for a, b, s in sectors if (a <= azimuth < b if a <= b else azimuth >= a or azimuth < b)), default)
                if math.hypot(dx, dy) <= k * size[2] / math.tan(math.radians(slope)) + 1e-9:
                    offsets.append((i, j, k))
    cells = blocks.select("block_id", *(F.floor(F.col(a) / s + 1e-9).cast("long").alias(f"i{a}") for a, s in zip("xyz", size)))
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in offsets))
    wanted = cells.withColumn("_o", F.explode(table)).select(F.col("block_id").alias("block"), (F.col("ix") + F.col("_o.i")).alias("ix"), (F.col("iy") + F.col("_o.j")).alias("iy"), (F.col("iz") + F.col("_o.k")).alias("iz"))
    return wanted.join(cells.withColumnRenamed("block_id", "above"), ["ix", "iy", "iz"]).select("block", "above")


def simulated_values(blocks: DataFrame, draws: DataFrame, rate: float) -> DataFrame:
    """Discounted value of a fixed schedule in each draw of price, mining, processing and recovery; grades above 1 on the whole are percent.

    What a draw needs of the blocks is their tonnes and metal by period, so the
    blocks are summed before they meet the draws.
    """
    top = blocks.agg(F.max("grade").alias("_top"))
    per = blocks.groupBy("period").agg(F.sum("tonnes").alias("_t"), F.sum(F.col("tonnes") * F.col("grade")).alias("_m")).crossJoin(F.broadcast(top))
    per = per.withColumn("_m", F.when(F.col("_top") > 1, F.col("_m") / 100).otherwise(F.col("_m")))
    flow = F.col("_m") * F.col("recovery") * F.col("price") - F.col("_t") * (F.col("mining") + F.col("processing"))
    return draws.crossJoin(per).groupBy("draw").agg(F.sum(flow * F.pow(F.lit(1.0 + rate), -F.col("period"))).alias("npv"))


def allocated_hours(routes: DataFrame, total: float) -> DataFrame:
    """Truck hours by need, the largest first, until the fleet's hours are used up; the running sum is two-level."""
    rows = running(routes, [F.desc("required"), "route"], "required", "_before")
    return rows.withColumn("allocated", F.greatest(F.least(F.col("required"), F.lit(float(total)) - F.col("_before")), F.lit(0.0))).drop("_before")


def waves(tasks: DataFrame, links: DataFrame, task: str = "task", before: str = "before", most: int = 10_000) -> DataFrame:
    """The tasks with their wave: 0 without predecessors, else one more than the latest of them; null on or behind a cycle.

    A wave is one join of what is open with the links of what the last wave
    closed; the rounds are the longest chain, and end when nothing opens.  Links
    of unknown tasks do not count.
    """
    known = tasks.select(task).distinct()
    links = links.select(task, before).where(f"{task} is not null").distinct().join(known, task, "left_semi").join(known.withColumnRenamed(task, before), before, "left_semi")
    links = written(links, "links")
    waiting = written(known.join(links.groupBy(task).agg(F.count(F.lit(1)).alias("_open")), task, "left").fillna(0, ["_open"]), "waiting")
    done = None
    for wave in range(most):
        ready = written(waiting.where("_open = 0").select(task, F.lit(wave).alias("wave")), "wave")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        closed = links.join(ready.select(F.col(task).alias(before)), before, "left_semi").groupBy(task).agg(F.count(F.lit(1)).alias("_closed"))
        left = waiting.where("_open > 0").join(closed, task, "left")
        waiting = written(left.select(task, (F.col("_open") - F.coalesce("_closed", F.lit(0))).alias("_open")), "waiting")
    return tasks.join(done, task, "left") if done is not None else tasks.withColumn("wave", F.lit(None).cast("int"))


def development_schedule(tasks: DataFrame, links: DataFrame, rate: float, periods: int, task: str = "task", length: str = "length") -> DataFrame:
    """The tasks with wave, turn (their place in the order, from 1) and period (from 1; null: not reached).

    Tasks go in the order of their wave, then their id; those on or behind a
    cycle come last, ignoring their predecessors.  A task that does not fit what a
    period has left of its ``rate`` of metres opens the next, also one longer than
    the rate.  The periods, which are few, are closed one after the other by a
    lookup in the running sum of lengths; the rows never meet in a task.
    """
    rows = waves(tasks, links, task).withColumn("_wave", F.coalesce("wave", F.lit(2**31 - 1)))
    order = ["_wave", task]
    rows = running(rows, order, F.coalesce(F.col(length).cast("double"), F.lit(0.0)), "_metres")
    rows = written(ranked(rows, order, "turn").withColumn("_to", F.col("_metres") + F.coalesce(F.col(length).cast("double"), F.lit(0.0))), "development")
    starts, base, turn = [], 0.0, 0
    for _ in range(periods + 1):
        # The first task after the last start that ends beyond the period's metres; a start itself always belongs to its period.
        first = rows.where((F.col("turn") > turn) & (F.col("_to") > base + rate * (1 + 1e-12))).agg(F.min(F.struct("turn", "_metres"))).first()[0]
        if first is None:
            break
        turn, base = first["turn"], first["_metres"]
        starts.append(turn)
    period = F.lit(1) + sum((F.when(F.col("turn") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    return rows.withColumn("period", F.when(period <= periods, period)).drop("_wave", "_metres", "_to")


def reordered(pushbacks: DataFrame, order: DataFrame) -> DataFrame:
    """Pushbacks (pushback, place) with the places, from 0, that a table of pushback and place gives them; those it does not name follow in their old order, from the number of those it does."""
    known = pushbacks.drop("place").join(order.select("pushback", F.col("place").cast("long").alias("place")), "pushback")
    rest = ranked(pushbacks.join(order, "pushback", "left_anti"), ["place", "pushback"], "_turn")
    count = known.agg(F.count(F.lit(1)).alias("_listed"))
    rest = rest.crossJoin(F.broadcast(count)).withColumn("place", F.col("_listed") + F.col("_turn") - 1).drop("_listed", "_turn")
    return known.unionByName(rest)
