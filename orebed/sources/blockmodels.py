"""Readers and writers of block models, drillholes and event catalogues on Spark's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import ranked
from ..operators.selection import canonical

DELIMITERS = (",", "\t", ";", " ")


def delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that cuts the first lines into most, and equally many, fields."""
    lines = [r[0] for r in spark.read.text(path).limit(5).collect() if r[0] and r[0].strip()]
    counts = {d: {len(x.strip().split(d)) for x in lines} for d in DELIMITERS}
    return max(DELIMITERS, key=lambda d: (len(counts[d]) == 1, max(counts[d], default=0), -DELIMITERS.index(d)))


def read_text_table(spark: SparkSession, path: str, names: dict[str, str] | None = None, required: tuple[str, ...] = (), sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): a delimited table under canonical names; rows without a required value are rejected, not lost."""
    raw = spark.read.csv(path, header=True, inferSchema=True, sep=sep or delimiter(spark, path), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="NA")
    rows = canonical(raw, names)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no column for {', '.join(missing)}")
    fine = F.lit(True)
    for c in required:
        fine = fine & F.col(c).isNotNull()
    return rows.where(fine), rows.where(~fine)


def with_sizes(blocks: DataFrame) -> DataFrame:
    """Blocks with dx, dy, dz: the least step between distinct coordinates along each axis, neighbours being found by their rank."""
    for a in ("x", "y", "z"):
        if f"d{a}" not in blocks.columns:
            values = ranked(blocks.select(a).where(F.col(a).isNotNull()).distinct(), [a])
            after = values.select((F.col("rank") - 1).alias("rank"), F.col(a).alias("_next"))
            steps = values.join(after, "rank").select((F.col("_next") - F.col(a)).alias("_step")).where("_step > 1e-9")
            blocks = blocks.crossJoin(F.broadcast(steps.agg(F.coalesce(F.min("_step"), F.lit(1.0)).alias(f"d{a}"))))
    return blocks


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of a catalogue with time, x, y, z, magnitude; a time that cannot be read rejects the row."""
    rows = canonical(spark.read.csv(path, header=True, inferSchema=False, sep=delimiter(spark, path)))
    lower = {c: c.lower() for c in rows.columns}
    rows = rows.withColumnsRenamed(lower)
    when = next((c for c in ("time", "ts", "datetime", "date") if c in rows.columns), None)
    if when is None:
        raise ValueError(f"{path} has no time column")
    rows = rows.withColumn("ts", F.try_to_timestamp(F.col(when)))
    numbers = {c: F.expr(f"try_cast(`{c}` as double)") for c in ("x", "y", "z", "magnitude", "energy") if c in rows.columns}
    rows = rows.withColumns(numbers)
    return rows.where("ts is not null"), rows.where("ts is null")


def write_table(rows: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """csv, json or parquet, partitioned by columns."""
    writer = rows.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    writer.option("header", True).format(kind).save(path)


def long_assays(assays: DataFrame, elements: list[str]) -> DataFrame:
    """One row an element; nulls have none."""
    return assays.unpivot(["hole_id", "depth_from", "depth_to"], elements, "element", "value").where("value is not null")


def wide_assays(rows: DataFrame, elements: list[str]) -> DataFrame:
    return rows.groupBy("hole_id", "depth_from", "depth_to").pivot("element", elements).agg(F.first("value"))


def wide_realisations(reals: DataFrame, node: str, realisation: str, value: str, count: int) -> DataFrame:
    return reals.groupBy(node).pivot(realisation, list(range(count))).agg(F.first(value))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Points of a text cloud: the first three numbers of each line; lines without are left out."""
    parts = F.split(F.trim("value"), r"[\s,;]+")
    rows = spark.read.text(path).select(*(F.get(parts, F.lit(i)).alias(a) for i, a in enumerate("xyz")))
    return rows.select(*(F.expr(f"try_cast({a} as double)").alias(a) for a in "xyz")).where("x is not null and y is not null and z is not null")
