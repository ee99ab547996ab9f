"""Hole paths: minimum curvature, positions along a path, traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import written

HOLE = "hole_id"


def desurvey(collars: DataFrame, surveys: DataFrame) -> DataFrame:
    """Stations with positions by minimum curvature; a station at depth 0 is put in with the first one's direction, equal depths keep one station.

    Dips are from the horizontal, down negative: the angle between two
    directions comes from their vectors.
    """
    order = Window.partitionBy(HOLE).orderBy("depth")
    rows = surveys.groupBy(HOLE, "depth").agg(F.min(F.struct("azimuth", "dip")).alias("s")).select(HOLE, F.col("depth").cast("double").alias("depth"), "s.*")
    least = F.min("depth").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = (F.col("depth") > 0) & (F.col("depth") == least)  # becomes two rows, so that rows stay with their hole and nothing is read twice
    rows = rows.withColumn("_top", top).withColumn("depth", F.explode(F.when(F.col("_top"), F.array(F.lit(0.0), "depth")).otherwise(F.array("depth")))).drop("_top")
    d, a = F.radians("dip"), F.radians("azimuth")
    rows = rows.withColumns({"_x": F.cos(d) * F.sin(a), "_y": F.cos(d) * F.cos(a), "_z": F.sin(d)})
    prev = lambda c: F.lag(c).over(order)
    dot = F.col("_x") * prev("_x") + F.col("_y") * prev("_y") + F.col("_z") * prev("_z")
    rows = rows.withColumns({"_bend": F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))), "_step": F.col("depth") - prev("depth")})
    ratio = F.when(F.col("_bend") > 1e-6, 2 / F.col("_bend") * F.tan(F.col("_bend") / 2)).otherwise(F.lit(1.0))
    rows = rows.withColumns({f"_d{c}": F.coalesce(F.col("_step") / 2 * (F.col(f"_{c}") + prev(f"_{c}")) * ratio, F.lit(0.0)) for c in "xyz"})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_s{c}": F.sum(f"_d{c}").over(upto) for c in "xyz"})
    starts = collars.select(HOLE, *(F.col(c).alias(f"_c{c}") for c in "xyz"))
    return rows.join(starts, HOLE).select(HOLE, "depth", "azimuth", "dip", *((F.col(f"_c{c}") + F.col(f"_s{c}")).alias(c) for c in "xyz"))


def located(intervals: DataFrame, stations: DataFrame, collars: DataFrame) -> DataFrame:
    """Intervals with x, y, z of their middle: between two stations by straight line, beyond the last at the last, holes without stations straight down from the collar.

    The as-of lookup is one window over stations and middles together, so a hole
    of many stations costs a sort and not a range join.
    """
    mid = (F.col("depth_from") + F.col("depth_to")) / 2
    own = intervals.columns
    points = stations.select(HOLE, F.col("depth").alias("_d"), F.struct("depth", "x", "y", "z").alias("_s"), F.lit(None).cast(intervals.schema.simpleString()).alias("_i"))
    wanted = intervals.select(F.col(HOLE), mid.alias("_d"), F.lit(None).cast("struct<depth:double,x:double,y:double,z:double>").alias("_s"), F.struct(*own).alias("_i"))
    both = points.select(HOLE, "_d", F.col("_s").cast("struct<depth:double,x:double,y:double,z:double>").alias("_s"), "_i").unionByName(wanted)
    before = Window.partitionBy(HOLE).orderBy("_d", F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(HOLE).orderBy("_d", F.col("_s").isNull()).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"_a": F.last("_s", ignorenulls=True).over(before), "_b": F.first("_s", ignorenulls=True).over(after)}).where("_i is not null")
    both = both.join(collars.select(HOLE, *(F.col(c).alias(f"_c{c}") for c in "xyz")), HOLE, "left")
    share = (F.col("_d") - F.col("_a.depth")) / (F.col("_b.depth") - F.col("_a.depth"))

    def along(c: str):
        a, b = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        down = F.col(f"_c{c}") - (F.col("_d") if c == "z" else F.lit(0.0))
        return F.when(a.isNotNull() & b.isNotNull() & (F.col("_b.depth") > F.col("_a.depth")), a + share * (b - a)).otherwise(F.coalesce(a, b, down))

    return both.select("_i.*", *(along(c).alias(c) for c in "xyz"))


def lineages(edges: DataFrame) -> DataFrame:
    """Ancestors of every node of child, parent edges, with their least distance.

    A round knows all pairs up to a distance and doubles it: a pair further apart
    has on a shortest way an ancestor just at that distance, so only such pairs are
    joined with what is known, and nothing found before is found again.  It ends
    when no pair is at the new distance; cycles end too.
    """
    known, step = [written(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct(), "reach")], 1
    while True:
        reach = reduce(DataFrame.unionByName, known)
        ends = known[-1].where(F.col("distance") == step).select("node", F.col("ancestor").alias("_middle"))
        beyond = reach.select(F.col("node").alias("_middle"), "ancestor", (F.col("distance") + step).alias("distance"))
        further = ends.join(beyond, "_middle").groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        old = reach.select(F.col("node").alias("_node"), F.col("ancestor").alias("_ancestor"))
        known.append(written(further.join(old, F.col("node").eqNullSafe(F.col("_node")) & F.col("ancestor").eqNullSafe(F.col("_ancestor")), "left_anti"), "reach"))
        step *= 2
        if known[-1].where(F.col("distance") == step).isEmpty():
            return reduce(DataFrame.unionByName, known)
