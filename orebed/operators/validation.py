"""Rules over drillhole tables; every rule gives rows of table_name, rule_code, severity, hole_id, depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import folded

HOLE = "hole_id"


def _found(rows: DataFrame, table: str, rules: dict[str, tuple[str, Column]], depth: str | None) -> DataFrame:
    """One row a rule that holds: the rules are one array, exploded, so the table is read once."""
    hits = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("rule_code"), F.lit(level).alias("severity"))) for code, (level, test) in rules.items()))
    rows = rows.withColumn("_hit", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    return rows.select(F.lit(table).alias("table_name"), "_hit.rule_code", "_hit.severity", HOLE, (F.col(depth) if depth else F.lit(None)).cast("double").alias("depth"))


def intervals(rows: DataFrame, collars: DataFrame, table: str, gap: float = 0.10, over: float = 1e-3, code: str | None = None) -> DataFrame:
    order = Window.partitionBy(HOLE).orderBy("depth_from", "depth_to")
    rows = rows.withColumn("_prev", F.lag("depth_to").over(order)).join(collars.select(HOLE, F.col("length").alias("_td")), HOLE, "left")
    rules = {
        "LENGTH": ("ERROR", F.col("depth_to") <= F.col("depth_from")),
        "GAP": ("WARNING", F.col("depth_from") - F.col("_prev") > gap),
        "OVERLAP": ("ERROR", F.col("depth_from") < F.col("_prev")),
        "BEYOND_TD": ("ERROR", F.col("depth_to") > F.col("_td") + over),
    }
    if code:
        rules["MISSING_CODE"] = ("WARNING", F.col(code).isNull() | (F.trim(code) == ""))
    return _found(rows, table, rules, "depth_from")


def surveys(rows: DataFrame, collars: DataFrame, first: float = 2.0, spacing: float = 30.0, end: float = 5.0, turn: float = 10.0, per: float = 10.0) -> DataFrame:
    """Depth order, ranges, turn per ``per`` metres, first station, spacing and distance of the last station to the hole's end."""
    order = Window.partitionBy(HOLE).orderBy("depth")
    whole = Window.partitionBy(HOLE)
    prev = F.lag("depth").over(order)
    swing = F.abs(F.pmod(F.col("azimuth") - F.lag("azimuth").over(order) + 180, F.lit(360.0)) - 180)
    rows = rows.withColumns({"_p": prev, "_dd": F.abs(F.col("dip") - F.lag("dip").over(order)), "_da": swing, "_last": F.max("depth").over(whole)}).join(collars.select(HOLE, F.col("length").alias("_td")), HOLE, "left")
    step = F.col("depth") - F.col("_p")
    return _found(
        rows,
        "surveys",
        {
            "DEPTH_ORDER": ("ERROR", step <= 0),
            "DIP_RANGE": ("ERROR", ~F.col("dip").between(-90, 90)),
            "AZIMUTH_RANGE": ("ERROR", ~((F.col("azimuth") >= 0) & (F.col("azimuth") <= 360))),
            "DIP_TURN": ("WARNING", F.col("_dd") / step * per > turn),
            "AZIMUTH_TURN": ("WARNING", F.col("_da") / step * per > turn),
            "FIRST_STATION": ("WARNING", F.col("_p").isNull() & (F.col("depth") > first)),
            "SPACING": ("WARNING", step > spacing),
            "END_GAP": ("WARNING", (F.col("depth") == F.col("_last")) & (F.col("_td") - F.col("_last") > end)),
        },
        "depth",
    )


def collars(rows: DataFrame, prefixes: tuple[str, ...] = (), lowest: float = -1000.0) -> DataFrame:
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(HOLE)))
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in (HOLE, "x", "y", "z")))
    rules = {"MISSING": ("ERROR", missing), "DUPLICATE": ("ERROR", F.col("_n") > 1), "NEGATIVE_TD": ("ERROR", F.col("length") < 0), "LOW_ELEVATION": ("WARNING", F.col("z") < lowest)}
    if prefixes:
        rules["PREFIX"] = ("INFO", ~reduce(lambda a, b: a | b, (F.col(HOLE).startswith(p) for p in prefixes)))
    return _found(rows, "collars", rules, None)


def orphans(rows: DataFrame, table: str, collar_rows: DataFrame) -> DataFrame:
    """Child rows whose hole has no collar."""
    return _found(rows.join(collar_rows.select(HOLE), HOLE, "left_anti"), table, {"ORPHAN": ("ERROR", F.lit(True))}, "depth_from")


def short_holes(rows: DataFrame, collar_rows: DataFrame, table: str, tolerance: float = 1.0) -> DataFrame:
    """Holes whose last interval ends before their depth."""
    last = rows.groupBy(HOLE).agg(F.max("depth_to").alias("_last"))
    return _found(collar_rows.join(last, HOLE), table, {"SHORT": ("WARNING", F.col("length") - F.col("_last") > tolerance)}, "_last")


def summary(*found: DataFrame) -> DataFrame:
    """Violations by table, rule and severity; counted by hole first, where the rows are, so that no task holds the holes of a rule."""
    by = ["table_name", "rule_code", "severity"]
    holes = reduce(DataFrame.unionByName, found).groupBy(*by, HOLE).agg(F.count(F.lit(1)).alias("n"))
    return holes.groupBy(*by).agg(F.sum("n").alias("n"), F.count(HOLE).alias("holes"))


def verdict(*found: DataFrame) -> DataFrame:
    """FAIL with an error, WARN with a warning, else PASS."""
    worst = reduce(DataFrame.unionByName, found).agg(F.max(F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARNING", 1).otherwise(0)).alias("w"))
    return worst.select(F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "WARN").otherwise("PASS").alias("status"))


def duplicates_check(assays: DataFrame, grade: str, tolerance: float) -> DataFrame:
    """Duplicate samples beside their parents: relative difference and whether it is within tolerance."""
    parents = assays.select(F.col("sample_id").alias("parent_sample_id"), F.col(grade).alias("parent_grade"))
    both = assays.where(F.col("qaqc_type").isin("DUPLICATE", "CRD", "DUP")).join(parents, "parent_sample_id", "left")
    difference = F.abs(F.col(grade) - F.col("parent_grade")) / F.nullif((F.col(grade) + F.col("parent_grade")) / 2, F.lit(0.0))
    return both.withColumn("difference", difference).withColumn("status", F.when(F.col("difference").isNull(), "PENDING").when(F.col("difference") <= tolerance, "PASS").when(F.col("difference") <= 1.5 * tolerance, "WARNING").otherwise("FAIL"))


def fixed_intervals(rows: DataFrame, collar_rows: DataFrame, snap: float = 0.10, least: float = 0.01) -> DataFrame:
    """Intervals repaired in order down each hole: empty ones get ``least`` length, starts within ``snap`` of (or above) the repaired end before move onto it, ends stop at the hole's depth (the greatest of its collars)."""

    def step(state, x):
        start, stop, depth = x
        before = state[0] if state else None
        if before is not None and start is not None and start - before <= snap:
            start = before
        if stop is not None and start is not None and stop <= start:
            stop = start + least
        if depth is not None:
            most = depth if start is None else max(depth, start)
            stop = most if stop is None else min(stop, most)
        return (stop,), (start, stop)

    depths = collar_rows.groupBy(HOLE).agg(F.max("length").alias("_td"))
    others = [c for c in rows.columns if c not in (HOLE, "depth_from", "depth_to")]
    values = [F.col(c).cast("double") for c in ("depth_from", "depth_to", "_td")]
    done = folded(rows.join(depths, HOLE, "left"), [HOLE], ["depth_from", "depth_to", *others], values, step, {"_start": "double", "_stop": "double"})
    return done.select(HOLE, F.col("_start").cast(rows.schema["depth_from"].dataType).alias("depth_from"), F.col("_stop").cast(rows.schema["depth_to"].dataType).alias("depth_to"), *others)


def fixed_surveys(rows: DataFrame, spacing: float = 30.0, low: float = -90.0, high: float = 90.0) -> DataFrame:
    """Azimuths within 0 to 360, dips within their limits, and stations put in where two are further apart than ``spacing`` (azimuth the short way round)."""
    rows = rows.withColumns({"azimuth": F.pmod("azimuth", F.lit(360.0)), "dip": F.least(F.greatest("dip", F.lit(low)), F.lit(high))})
    order = Window.partitionBy(HOLE).orderBy("depth")
    gap = F.lead("depth").over(order) - F.col("depth")
    turn = F.pmod(F.lead("azimuth").over(order) - F.col("azimuth") + 180, F.lit(360.0)) - 180
    rows = rows.withColumns({"_gap": gap, "_turn": turn, "_fall": F.lead("dip").over(order) - F.col("dip")})
    parts = F.greatest(F.coalesce(F.ceil(F.col("_gap") / spacing), F.lit(1)), F.lit(1))
    rows = rows.withColumn("_n", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    share = F.col("_k") / F.col("_n")
    move = lambda c, by: F.when(F.col("_k") == 0, F.col(c)).otherwise(F.col(c) + share * F.col(by))
    return rows.select(HOLE, move("depth", "_gap").alias("depth"), F.pmod(move("azimuth", "_turn"), F.lit(360.0)).alias("azimuth"), move("dip", "_fall").alias("dip"), (F.col("_k") > 0).alias("inserted"))


def fixed(rows: DataFrame, table: str, fixes: list[tuple[str, Column, str, str, float]], key: str = HOLE) -> tuple[DataFrame, DataFrame]:
    """The rows with the fixes (column, new value, rule_code, reason, confidence) applied, and a log of what they changed.

    The log has a row for each value that a fix changes: table_name, rule_code,
    hole_id (as it was), column, old, new (as text), reason, confidence.  All new
    values are taken from the rows as they were; a value may become or stop being
    null, which counts as a change; further columns are kept.
    """
    entries = [F.when(~F.col(c).eqNullSafe(new), F.struct(F.lit(rule).alias("rule_code"), F.lit(c).alias("column"), F.col(c).cast("string").alias("old"), new.cast("string").alias("new"), F.lit(reason).alias("reason"), F.lit(float(sure)).alias("confidence"))) for c, new, rule, reason, sure in fixes]
    log = rows.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias(HOLE), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
    return rows.withColumns({c: new for c, new, *_ in fixes}), log.select("table_name", "e.rule_code", HOLE, "e.column", "e.old", "e.new", "e.reason", "e.confidence")


def fixed_collars(rows: DataFrame, key: str = HOLE) -> tuple[DataFrame, DataFrame]:
    """Collars with ids trimmed and in upper case, and the log."""
    return fixed(rows, "collars", [(key, F.upper(F.trim(F.col(key).cast("string"))), "HOLE_ID", "id trimmed and in upper case", 1.0)], key)


def fixed_directions(rows: DataFrame, key: str = HOLE) -> tuple[DataFrame, DataFrame]:
    """Surveys with azimuths from 0 to below 360, and the log."""
    return fixed(rows, "surveys", [("azimuth", F.pmod(F.col("azimuth").cast("double"), F.lit(360.0)), "AZIMUTH", "azimuth turned into 0 to 360", 0.99)], key)


#: The columns that a block model must have, those that must not be negative, and the greatest grade of a unit.
BLOCK_COLUMNS, POSITIVE, UNIT_LIMITS = ("block_id", "x", "y", "z", "volume", "density"), ("volume", "density", "tonnes"), {"percent": 100.0, "ppm": 1e6}


def block_model(blocks: DataFrame, grades: dict[str, str], expected: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Faults of a block model: check, column, severity, n (blocks, or the number found), worst (a value); no row where nothing is wrong.

    ``grades`` gives the unit of each grade column (percent, ppm or another,
    which has no limit).  Missing columns end the check, as there is then
    nothing to compare; all else is one aggregation: negative numbers
    (coordinates may be), tonnes that are not volume times density, grades over
    their unit's limit, and a number of blocks other than ``expected``.  Null
    and NaN values have no fault.
    """
    spark = blocks.sparkSession
    names = {c.lower(): c for c in blocks.columns}
    kind = "check string, column string, severity string, n long, worst double"
    missing = [("missing", c, "ERROR", None, None) for c in BLOCK_COLUMNS if c not in names] + [("missing", c, "ERROR", None, None) for c in grades if c not in blocks.columns]
    if missing:
        return spark.createDataFrame(missing, kind)
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    found: list[tuple[str, str, str, Column, Column]] = []
    for f in blocks.schema.fields:
        if isinstance(f.dataType, T.NumericType) and f.name.lower() not in ("x", "y", "z"):
            found.append(("negative", f.name, "ERROR" if f.name.lower() in POSITIVE else "WARNING", F.count_if(value(f.name) < 0), F.min(value(f.name))))
    if "tonnes" in names:
        off = F.abs(value(names["tonnes"]) - value(names["volume"]) * value(names["density"]))
        found.append(("tonnage", names["tonnes"], "WARNING", F.count_if(off > tolerance), F.max(off)))
    for c, unit in grades.items():
        if unit in UNIT_LIMITS:
            found.append(("unit", c, "WARNING", F.count_if(value(c) > UNIT_LIMITS[unit]), F.max(value(c))))
    if expected is not None:
        found.append(("coverage", names["block_id"], "WARNING", F.when(F.count(F.lit(1)) != expected, F.count(F.lit(1))).otherwise(0), F.lit(float(expected))))
    one = blocks.agg(*(c.cast("long").alias(f"n{i}") for i, (*_, c, _) in enumerate(found)), *(w.cast("double").alias(f"w{i}") for i, (*_, w) in enumerate(found)))
    rows = F.array(*(F.struct(F.lit(check).alias("check"), F.lit(c).alias("column"), F.lit(level).alias("severity"), F.col(f"n{i}").alias("n"), F.col(f"w{i}").alias("worst")) for i, (check, c, level, _, _) in enumerate(found)))
    return one.select(F.inline(rows)).where("n > 0")
