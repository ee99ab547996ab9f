"""Whole projects on files: drillhole tables, structural readings, scenarios, catalogues of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import canonical
from .blockmodels import read_text_table

REQUIRED = {"collars": ("hole_id", "x", "y", "z"), "surveys": ("hole_id", "depth", "azimuth", "dip"), "assays": ("hole_id", "depth_from", "depth_to"), "lithology": ("hole_id", "depth_from", "depth_to"), "structures": ("hole_id", "depth")}


def read_project(spark: SparkSession, files: dict[str, str], names: dict[str, dict[str, str]] | None = None, sep: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables under canonical names, rejected rows by table): the drillhole tables that have a file; ``names`` maps headers explicitly, a table at a time."""
    tables, lost = {}, None
    for name, path in files.items():
        rows, rejected = read_text_table(spark, path, (names or {}).get(name), REQUIRED[name], sep)
        tables[name] = rows
        count = rejected.agg(F.count(F.lit(1)).alias("rejected")).select(F.lit(name).alias("table"), "rejected")
        lost = count if lost is None else lost.unionByName(count)
    return tables, lost


def structural_format(columns: list[str]) -> str:
    """What a structural table's columns make it: vectors, fold axes, orientations, points, or unknown without coordinates."""
    have = {c.lower() for c in columns}
    if not {"x", "y", "z"} <= have:
        return "unknown"
    if {"gx", "gy", "gz"} <= have:
        return "vector_constraint"
    if {"plunge", "trend"} <= have:
        return "fold_axis"
    return "orientation" if "dip" in have else "point_cloud"


def read_structures(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> tuple[str, DataFrame]:
    """(format, rows with feature_type and feature_name): a table without them is one fault without a name."""
    rows = canonical(spark.read.csv(path, header=True, inferSchema=True), names)
    kind = structural_format(rows.columns)
    if kind == "unknown":
        raise ValueError(f"{path} has no coordinates")
    for column, value in (("feature_type", "fault"), ("feature_name", "unnamed")):
        rows = rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in rows.columns else F.lit(value))
    return kind, rows


def save_scenarios(scenarios: DataFrame, folder: str) -> None:
    """Rows of name, version and whatever else describes a scenario, as JSON, a folder a name."""
    scenarios.write.mode("append").partitionBy("name").json(folder)


def scenario(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A scenario of a version, or of its latest one."""
    rows = spark.read.json(folder).where(F.col("name") == name)
    if version is not None:
        return rows.where(F.col("version") == version)
    latest = rows.agg(F.max("version").alias("_latest"))
    return rows.crossJoin(F.broadcast(latest)).where("version = _latest").drop("_latest")


def catalogue(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length and sha256 of the files of a folder whose names match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("checksum"))


def write_all(tables: dict[str, DataFrame], folder: str, kind: str = "csv", prefix: str = "") -> dict[str, str]:
    """Each table in a folder of its name; returns the folders."""
    out = {}
    for name, rows in tables.items():
        out[name] = f"{folder.rstrip('/')}/{prefix}{name}"
        writer = rows.write.mode("overwrite")
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(out[name])
    return out


def for_exchange(blocks: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Blocks under the coordinate headers that mine-planning packages read."""
    return blocks.withColumnsRenamed(names or {"x": "XC", "y": "YC", "z": "ZC"})
