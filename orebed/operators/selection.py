"""Predicates, projections and selection algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header aliases of the canonical columns, compared in lower case.
ALIASES = {
    "hole_id": ("hole_id", "holeid", "bhid", "hole", "dhid"),
    "depth_from": ("depth_from", "from", "from_m", "from_depth"),
    "depth_to": ("depth_to", "to", "to_m", "to_depth"),
    "x": ("x", "xc", "xcentre", "easting", "east", "xmorig"),
    "y": ("y", "yc", "ycentre", "northing", "north", "ymorig"),
    "z": ("z", "zc", "zcentre", "elevation", "rl", "zmorig"),
    "azimuth": ("azimuth", "azi", "brg", "bearing"),
    "dip": ("dip", "inclination"),
    "lith_code": ("lith_code", "lith", "lithology", "rock"),
}
COORDINATES = ("x", "y", "z")


def canonical(df: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Columns under their canonical names; the first alias found wins, ``extra`` maps headers explicitly."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    renames = {old: new for old, new in (extra or {}).items() if old in df.columns}
    for name, others in ALIASES.items():
        if name not in df.columns and name not in renames.values():
            found = next((by_lower[a] for a in others if a in by_lower and by_lower[a] not in renames), None)
            if found:
                renames[found] = name
    return df.withColumnsRenamed(renames)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def grade_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are neither coordinates, depths, ids nor excluded."""
    known = {*COORDINATES, "depth_from", "depth_to", "azimuth", "dip", *exclude}
    return [c for c in numeric_columns(df) if c.lower() not in known and not c.lower().endswith("_id")]


def between(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive range; an end that is None is open."""
    out = F.col(column).isNotNull()
    if low is not None:
        out = out & (F.col(column) >= low)
    if high is not None:
        out = out & (F.col(column) <= high)
    return out


def box(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    return reduce(lambda a, b: a & b, (between(c, *r) for c, r in ranges.items()))


def slab(position: float, thickness: float, normal=(1.0, 0.0, 0.0), origin=(0.0, 0.0, 0.0), columns=COORDINATES) -> tuple[Column, Column]:
    """(predicate, signed distance) of a slab around the plane at ``position`` along the unit normal."""
    length = sum(n * n for n in normal) ** 0.5
    distance = sum(((F.col(c) - F.lit(float(o))) * F.lit(n / length) for c, o, n in zip(columns, origin, normal)), F.lit(0.0)) - F.lit(float(position))
    return F.abs(distance) <= thickness / 2, distance


def compared(column: str, operator: str, value: float, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    """Comparison by operator text; equality within tolerances."""
    c, v = F.col(column), F.lit(value)
    close = F.abs(c - v) <= absolute + relative * abs(value) if isinstance(value, (int, float)) else c == v
    return {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "==": close, "!=": ~close}[operator]


def criteria(df: DataFrame, rules: list[tuple[str, str, float]], logic: str = "and") -> DataFrame:
    """Rows that meet all (or any) rules; rules on unknown columns are skipped."""
    found = [compared(*r) for r in rules if r[0] in df.columns]
    if not found:
        return df
    return df.where(reduce((lambda a, b: a & b) if logic.lower() == "and" else (lambda a, b: a | b), found))


def combined(current: DataFrame, new: DataFrame, mode: str, key: str) -> DataFrame:
    """Selection sets of keys: new, add, subtract, intersect."""
    a, b = current.select(key), new.select(key)
    return {"new": lambda: b.distinct(), "add": lambda: a.union(b).distinct(), "subtract": lambda: a.distinct().join(b, key, "left_anti"), "intersect": lambda: a.distinct().join(b, key, "left_semi")}[mode]()


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows of the keys in ``rows`` replaced by these."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def without_ignored(violations: DataFrame, rules: DataFrame, severities: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(visible, ignored): a rule's null fields match anything."""
    keys = ("rule_code", "hole_id", "table_name")
    minor = F.col("severity").isin(*severities) if severities else F.lit(False)
    rated = violations.withColumn("_hit", minor)
    for k in range(1 << len(keys)):  # an equi join for each pattern of fields that a rule names
        named = [c for i, c in enumerate(keys) if k >> i & 1]
        of = rules.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() if c in named else F.col(c).isNull() for c in keys)))
        of = of.select(*(F.col(c).alias(f"_r_{c}") for c in named), F.lit(True).alias("_rule")).distinct()
        on = [F.col(c) == F.col(f"_r_{c}") for c in named] or [F.lit(True)]
        rated = rated.join(of, on, "left").withColumn("_hit", F.col("_hit") | F.coalesce("_rule", F.lit(False))).drop("_rule", *(f"_r_{c}" for c in named))
    return rated.where("not _hit").drop("_hit"), rated.where("_hit").drop("_hit")


def table_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: row count and a hash that does not depend on the order of rows: the sum of 60 bits of each row's md5."""
    values = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (columns or df.columns)))
    part = F.conv(F.substring(F.md5(values), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part) % (1 << 60), F.lit(0)).cast("long").alias("hash"))


#: Endings of the names of transformed columns.
TRANSFORMED = ("_ns", "_nscore", "_gauss", "_log", "_log10", "_ln", "_sqrt", "_boxcox", "_norm")


def untransformed(columns: list[str]) -> list[str]:
    return [c for c in columns if not c.lower().endswith(TRANSFORMED)]


def of_classes(blocks: DataFrame, classes: tuple[str, ...] = ("Measured", "Indicated"), column: str = "class", strict: bool = True) -> DataFrame:
    """Blocks of the given resource classes; without the column an error, or, not strict, all of them."""
    if column not in blocks.columns:
        if strict:
            raise ValueError(f"no column {column}; resources must be classified")
        return blocks
    return blocks.where(F.col(column).isin(*classes))


def usable_variable(df: DataFrame, column: str) -> DataFrame:
    """One row: whether a column exists, is numeric and has values, and the reason if not."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([(column, False, "not found")], "variable string, valid boolean, reason string")
    if column not in numeric_columns(df):
        return df.sparkSession.createDataFrame([(column, False, "not numeric")], "variable string, valid boolean, reason string")
    known = F.count(F.when(~F.isnan(F.col(column).cast("double")), 1))
    return df.agg(known.alias("_n")).select(F.lit(column).alias("variable"), (F.col("_n") > 0).alias("valid"), F.when(F.col("_n") == 0, "no values").alias("reason"))
