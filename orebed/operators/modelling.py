"""Block models from samples and from other models, solids, codes and gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import equal_mass, fixed_length
from .spatial import AXES, grid, nearest, within


def block_model(samples: DataFrame, value: str, counts: tuple[int, int, int], size: tuple[float, float, float], origin=(0.0, 0.0, 0.0), density: float = 2.7, sample_id: str = "sample_id") -> DataFrame:
    """A regular grid whose blocks have the value of the nearest sample, their volume and tonnes."""
    blocks = grid(samples.sparkSession, counts, size, origin)
    near = nearest(blocks, samples, 1, None, "block_id", sample_id, [value]).select(F.col("target").alias("block_id"), value, "distance")
    volume = float(size[0] * size[1] * size[2])
    return blocks.join(near, "block_id", "left").withColumns({"volume": F.lit(volume), "tonnes": F.lit(volume * density)})


def suggested_counts(samples: DataFrame, most: int, axes=AXES) -> DataFrame:
    """Block counts and sizes along each axis for at most ``most`` blocks, all sides alike as far as counts allow."""
    limits = samples.agg(*(F.greatest(F.max(a) - F.min(a), F.lit(1e-9)).alias(f"e{a}") for a in axes))
    side = F.pow(F.col("ex") * F.col("ey") * F.col("ez") / most, F.lit(1 / 3))
    counts = {f"n{a}": F.greatest(F.floor(F.col(f"e{a}") / side), F.lit(1)) for a in axes}
    return limits.withColumns(counts).select(*counts, *((F.col(f"e{a}") / F.col(f"n{a}")).alias(f"d{a}") for a in axes))


def variance_classes(blocks: DataFrame, variance: str, measured: float = 0.05, indicated: float = 0.15) -> DataFrame:
    """Class by estimation variance; without one, Unclassified."""
    v = F.col(variance)
    return blocks.withColumn("class", F.when(v < measured, "Measured").when(v < indicated, "Indicated").when(v >= indicated, "Inferred").otherwise("Unclassified"))


def resampled(blocks: DataFrame, targets: DataFrame, values: list[str], size: tuple[float, float, float], target_id: str = "target_id") -> DataFrame:
    """Values of coarse blocks (x, y, z, dx, dy, dz) on finer ones: means over the blocks whose boxes meet, weighted by the lesser of the two whole volumes.

    Both are put in cells of the coarse blocks' greatest size, so the join has equi keys.
    """
    limits = blocks.agg(*(F.max(f"d{a}").alias(f"_s{a}") for a in AXES))
    own = size[0] * size[1] * size[2]
    left = targets.select(target_id, *(F.col(a).alias(f"_t{a}") for a in AXES)).crossJoin(F.broadcast(limits))
    for a, s in zip(AXES, size):
        width, reach = F.col(f"_s{a}") + s, (F.col(f"_s{a}") + s) / 2
        left = left.withColumn(f"_c{a}", F.explode(F.sequence(F.floor((F.col(f"_t{a}") - reach) / width), F.floor((F.col(f"_t{a}") + reach) / width))))
    right = blocks.crossJoin(F.broadcast(limits)).select(*AXES, *(f"d{a}" for a in AXES), *values, *(F.floor(F.col(a) / (F.col(f"_s{a}") + s)).alias(f"_c{a}") for a, s in zip(AXES, size)))
    both = left.drop(*(f"_s{a}" for a in AXES)).join(right, [f"_c{a}" for a in AXES])
    for a, s in zip(AXES, size):
        both = both.where(F.abs(F.col(f"_t{a}") - F.col(a)) <= (s + F.col(f"d{a}")) / 2)
    w = F.least(F.lit(float(own)), F.col("dx") * F.col("dy") * F.col("dz"))
    mean = lambda v: (F.sum(w * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v)
    return targets.select(target_id).join(both.groupBy(target_id).agg(*map(mean, values)), target_id, "left")


def around_mean(targets: DataFrame, blocks: DataFrame, value: str, radius: float, target_id: str, block_id: str) -> DataFrame:
    """Plain mean of the blocks within a radius of each target."""
    near = within(targets, blocks, radius, target_id, block_id, [value])
    return targets.select(target_id).join(near.groupBy(F.col("target").alias(target_id)).agg(F.avg(value).alias(value)), target_id, "left")


def inside_solid(points: DataFrame, triangles: DataFrame, point_id: str, cell: float) -> DataFrame:
    """Points inside a closed mesh of triangles (ax .. cz): those with an odd number of triangles straight above.

    Triangles are copied to the plan cells that their extent meets, points are
    in one, so a point meets the triangles of its cell only.  A ray through an
    edge counts for the triangle it is on the left of.
    """
    lo = lambda c: F.least(*(F.col(f"{v}{c}") for v in "abc"))
    hi = lambda c: F.greatest(*(F.col(f"{v}{c}") for v in "abc"))
    faces = triangles
    for c in "xy":
        faces = faces.withColumn(f"_{c}", F.explode(F.sequence(F.floor(lo(c) / cell), F.floor(hi(c) / cell))))
    own = points.select(point_id, *AXES, F.floor(F.col("x") / cell).alias("_x"), F.floor(F.col("y") / cell).alias("_y"))
    both = own.join(faces, ["_x", "_y"])
    x, y, z = F.col("x"), F.col("y"), F.col("z")

    def turn(a: str, b: str) -> Column:
        return (F.col(f"{b}x") - F.col(f"{a}x")) * (y - F.col(f"{a}y")) - (F.col(f"{b}y") - F.col(f"{a}y")) * (x - F.col(f"{a}x"))

    def crossed(a: str, b: str) -> Column:  # the half-open rule in plan, edge by edge
        spans = (F.col(f"{a}y") > y) != (F.col(f"{b}y") > y)
        at = (F.col(f"{b}x") - F.col(f"{a}x")) * (y - F.col(f"{a}y")) / (F.col(f"{b}y") - F.col(f"{a}y")) + F.col(f"{a}x")
        return F.when(spans & (x < at), 1).otherwise(0)

    whole = turn("a", "b") + turn("b", "c") + turn("c", "a")
    height = (turn("b", "c") * F.col("az") + turn("c", "a") * F.col("bz") + turn("a", "b") * F.col("cz")) / F.nullif(whole, F.lit(0.0))
    hit = ((crossed("a", "b") + crossed("b", "c") + crossed("c", "a")) % 2 == 1) & (height > z)
    odd = both.groupBy(point_id).agg(F.count_if(hit).alias("_n")).where("_n % 2 = 1").select(point_id)
    return points.join(odd, point_id, "left_semi")


def nearest_code(intervals: DataFrame, codes: DataFrame, code: str, hole: str = "hole_id") -> DataFrame:
    """The intervals with the code whose middle depth is nearest to their own in the hole, of equally near ones the shallower.

    The codes before and after come from one window over both tables.
    """
    mid = (F.col("depth_from") + F.col("depth_to")) / 2
    kind = intervals.select(F.struct(*intervals.columns).alias("r")).schema["r"].dataType
    rows = intervals.select(hole, mid.alias("_m"), F.struct(*intervals.columns).alias("_r"), F.lit(None).cast("struct<m:double,c:string>").alias("_c"))
    marks = codes.select(hole, mid.alias("_m"), F.lit(None).cast(kind).alias("_r"), F.struct(mid.cast("double").alias("m"), F.col(code).cast("string").alias("c")).alias("_c"))
    order = Window.partitionBy(hole).orderBy("_m", F.col("_c").isNull())
    both = rows.unionByName(marks).withColumns({"_a": F.last("_c", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first("_c", True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("_r is not null")
    near = F.when(F.col("_b").isNull() | (F.col("_m") - F.col("_a.m") <= F.col("_b.m") - F.col("_m")), F.col("_a.c")).otherwise(F.col("_b.c"))
    return both.select("_r.*", near.alias(code))


def true_thickness(intervals: DataFrame, grades: list[str], length: float, angle: Column) -> DataFrame:
    """Composites of equal true thickness: the interval's length times the cosine of ``angle`` takes the place of mass."""
    rows = intervals.withColumn("_f", F.abs(F.cos(F.radians(angle))))
    return equal_mass(rows.where("_f > 1e-6"), grades, length, "_f").withColumnRenamed("mass", "thickness")


def filtered_composites(intervals: DataFrame, grades: list[str], length: float, excluded: Column | None = None, recovery: str | None = None, least: float | None = None) -> DataFrame:
    """Fixed-length composites of the intervals that are not excluded (control samples) and recovered well enough; an unknown recovery passes."""
    rows = intervals
    if excluded is not None:
        rows = rows.where(~F.coalesce(excluded, F.lit(False)))
    if recovery and least is not None:
        rows = rows.where(F.col(recovery).isNull() | (F.col(recovery) >= least))
    return fixed_length(rows, grades, length)


def normalised_ids(collars: DataFrame, column: str = "hole_id") -> tuple[DataFrame, DataFrame]:
    """(collars with trimmed, upper-case hole ids, the changes: rule_code, old, new, reason, confidence)."""
    new = F.upper(F.trim(F.col(column)))
    changed = collars.where(F.col(column) != new).select(F.lit("COLLAR_HOLEID_NORMALISED").alias("rule_code"), F.col(column).alias("old"), new.alias("new"), F.lit("Normalised hole_id to stripped uppercase.").alias("reason"), F.lit(1.0).alias("confidence"))
    return collars.withColumn(column, new), changed


def most_confident(rows: DataFrame, place: list[str], confidence: str, tie: str) -> DataFrame:
    """Of rows at one place the one of the greatest confidence."""
    order = Window.partitionBy(*place).orderBy(F.desc(confidence), tie)
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def mapped_types(blocks: DataFrame, types: DataFrame, domain: str, rules: list[tuple[Column, str]] = (), other: str = "UNKNOWN") -> DataFrame:
    """Ore type of each block: by the first rule that holds, else by its domain's type, else ``other``."""
    named = F.coalesce(F.col("_type"), F.lit(other))
    for test, name in reversed(list(rules)):
        named = F.when(test, name).otherwise(named)
    return blocks.join(types.select(domain, F.col("ore_type").alias("_type")), domain, "left").withColumn("ore_type", named).drop("_type")


def search_template(spark, radius: float, size: tuple[float, float, float]) -> DataFrame:
    """Grid offsets within a radius, numbered by distance."""
    reach = [int(radius / s) for s in size]
    axis = lambda n, k: spark.range(-n, n + 1).select(F.col("id").cast("int").alias(k))
    rows = axis(reach[0], "i").crossJoin(axis(reach[1], "j")).crossJoin(axis(reach[2], "k"))
    rows = rows.withColumn("distance", F.sqrt(sum((F.col(c) * s * F.col(c) * s for c, s in zip("ijk", size)), F.lit(0.0)))).where(F.col("distance") <= radius)
    from .running import ranked

    return ranked(rows, ["distance", "i", "j", "k"])


def spacing_thresholds(distances: DataFrame, first: str, third: str, measured: float = 0.2, indicated: float = 0.5) -> DataFrame:
    """Radii under which the wanted shares of blocks have their first or third sample."""
    from .running import quantiles

    a = quantiles(distances, third, {"measured": measured, "indicated": indicated})
    return a.crossJoin(quantiles(distances, first, {"inferred": 0.9}))


def unpivoted(blocks: DataFrame, block_id: str, pattern: str) -> DataFrame:
    """Columns whose names match a pattern with one group (the realisation's number) as rows of block_id, realisation, value."""
    import re

    found = [(int(m.group(1)), c) for c in blocks.columns if (m := re.fullmatch(pattern, c))]
    table = F.array(*(F.struct(F.lit(n).alias("realisation"), F.col(c).cast("double").alias("value")) for n, c in sorted(found)))
    return blocks.select(block_id, F.inline(table))


def domain_rules(domains: DataFrame, least: float = 10.0, most: float = 500.0, factors: tuple[float, float, float] = (0.75, 1.5, 2.5)) -> DataFrame:
    """domain, class, distance, holes: the classification rules of domains with the longest range of their variogram and, if known, their hole spacing.

    Distances are 0.25, 0.67 and 1 of the range, not below ``factors`` times
    the spacing, kept between ``least`` and ``most``, and a class stays below
    0.8 of the next one's distance unless that is under ``least``.
    """
    low, high = F.lit(float(least)), F.lit(float(most))
    spacing = F.when(F.col("spacing") > 0, F.col("spacing").cast("double"))
    raw = [F.least(F.greatest(F.greatest(F.col("range").cast("double") * share, spacing * k), low), high) for share, k in zip((0.25, 0.67, 1.0), factors)]
    rows = domains.select("domain", *(d.alias(c) for c, d in zip(("_m", "_i", "_f"), raw)))
    rules = [("Measured", F.greatest(F.least(F.col("_m"), F.col("_i") * 0.8), low), 3), ("Indicated", F.greatest(F.least(F.col("_i"), F.col("_f") * 0.8), low), 2), ("Inferred", F.col("_f"), 1)]
    return rows.select("domain", F.inline(F.array(*(F.struct(F.lit(n).alias("class"), d.alias("distance"), F.lit(h).alias("holes")) for n, d, h in rules))))
