"""Recurrences over periods: ponds, caves, backfill, disturbance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import folded, running


def water_balance(flows: DataFrame, start: float, capacity: float) -> DataFrame:
    """Per node: period, stored, spill; of inflow and outflow a period, the store kept between 0 and ``capacity``. An unknown flow empties the store."""

    def step(state, x):
        change = None if x[0] is None or x[1] is None else (state[0] if state else start) + x[0] - x[1]
        wanted = max(change, 0.0) if change is not None else 0.0
        return (min(wanted, capacity),), (min(wanted, capacity), max(wanted - capacity, 0.0))

    start, capacity = float(start), float(capacity)
    rows = flows.select("node", "period", F.col("inflow").cast("double").alias("inflow"), F.col("outflow").cast("double").alias("outflow"))
    done = folded(rows, ["node"], ["period"], [F.col("inflow"), F.col("outflow")], step, {"stored": "double", "spill": "double"})
    return done.select("node", "period", "stored", "spill")


def cave_draw(points: DataFrame, periods: int, rate: float) -> DataFrame:
    """Per draw point (id, tonnes) and period: the tonnes drawn, ``rate`` a period until it is empty."""
    rows = points.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return rows.select("id", "period", F.greatest(F.least(F.lit(float(rate)), F.col("tonnes") - (F.col("period") - 1) * rate), F.lit(0.0)).alias("drawn")).where("drawn > 0")


def void_series(mined: DataFrame, filled: DataFrame) -> DataFrame:
    """Open void by period: running mined less filled volume."""
    both = mined.select("period", F.col("volume").alias("v")).unionByName(filled.select("period", (-F.col("volume")).alias("v"))).groupBy("period").agg(F.sum("v").alias("change"))
    return running(both, ["period"], "change", "_void").withColumn("void", F.coalesce("_void", F.lit(0.0)) + F.coalesce("change", F.lit(0.0))).drop("_void")


def waste_rock(schedule: DataFrame, strip_ratio: float, density: float, acid_share: float) -> DataFrame:
    """Waste tonnes and volume of each period's ore, split into acid-forming and not."""
    waste = F.col("ore") * strip_ratio
    return schedule.select("period", waste.alias("waste"), (waste / density).alias("volume"), (waste * acid_share).alias("acid_forming"), (waste * (1 - acid_share)).alias("benign"))


def exposure(profile: DataFrame, value: str, threshold: float) -> DataFrame:
    """Periods and tonnes at or above a threshold, and the period of the greatest value."""
    over = F.col(value) >= threshold
    return profile.agg(F.count_if(over).alias("periods"), F.coalesce(F.sum(F.when(over, F.col("tonnes"))), F.lit(0.0)).alias("tonnes"), F.max_by("period", value).alias("worst_period"), F.max(value).alias("worst"))


def shifts(periods: DataFrame, per_period: int, trucks: int) -> DataFrame:
    """Period tonnes over shifts and trucks, equally."""
    rows = periods.withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(per_period)))).withColumn("truck", F.explode(F.sequence(F.lit(1), F.lit(trucks))))
    return rows.select("period", "shift", "truck", (F.col("tonnes") / (per_period * trucks)).alias("tonnes"))


def aligned(plan: DataFrame, haulage: DataFrame, actual: DataFrame) -> DataFrame:
    """Periods of the plan with hauled and actual tonnes (0 where there are none) and their differences from it."""
    out = plan.select("period", F.col("tonnes").alias("planned")).join(haulage.select("period", F.col("tonnes").alias("hauled")), "period", "left").join(actual.select("period", F.col("tonnes").alias("actual")), "period", "left").fillna(0.0, ["hauled", "actual"])
    percent = lambda c: 100 * (F.col(c) - F.col("planned")) / F.nullif(F.col("planned"), F.lit(0.0))
    return out.withColumns({"hauled_variance": percent("hauled"), "actual_variance": percent("actual")})


def pushbacks_by_depth(shells: DataFrame, count: int) -> DataFrame:
    """Shells in order of depth, cut into ``count`` contiguous groups at int(i * n / count); shells are few."""
    order = Window.orderBy("depth", "shell")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(order) - 1
    return shells.withColumn("pushback", (F.floor(((place + 1) * count - 1) / n) + 1).cast("int"))
