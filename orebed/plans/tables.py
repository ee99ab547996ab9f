"""The driver's tables in the roles of the domain: blocks, intervals, collars, surveys, samples, readings; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of :func:`dealt` should have.
TASK_ROWS = 250_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows by the hash of a key, in as many parts as their number asks for, so that a task's share (and what windows and groups of the key hold) does not grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS)), key)


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks on a grid."""
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 64 + turn).alias("block_id"),
        ((F.col("l_partkey") % 40) * 25.0).alias("x"),
        ((F.col("l_suppkey") % 20) * 25.0).alias("y"),
        (F.col("l_linenumber") * 10.0).alias("z"),
        F.col("l_quantity").alias("tonnes"),
        F.round(F.col("l_discount") * 100).alias("grade"),
        F.round(F.col("l_tax") * 100).alias("grade2"),
        (2.0 + F.round(F.col("l_tax") * 100) / 10).alias("density"),
        F.col("l_returnflag").alias("domain"),
        F.when(F.col("l_returnflag") == "A", "Measured").when(F.col("l_returnflag") == "N", "Indicated").otherwise("Inferred").alias("class"),
        F.col("l_extendedprice").alias("value"),
        (F.year("l_shipdate") - 1990).cast("int").alias("period"),
    )


BLOCKS = """blocks AS (SELECT l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS block_id,
 ((l_partkey % 40) * 25)::DOUBLE AS x, ((l_suppkey % 20) * 25)::DOUBLE AS y, (l_linenumber * 10)::DOUBLE AS z, l_quantity AS tonnes, round(l_discount * 100) AS grade, round(l_tax * 100) AS grade2,
 2::DOUBLE + round(l_tax * 100) / 10 AS density, l_returnflag AS domain, CASE l_returnflag WHEN 'A' THEN 'Measured' WHEN 'N' THEN 'Indicated' ELSE 'Inferred' END AS class, l_extendedprice AS value, (year(l_shipdate) - 1990)::INT AS period FROM lineitem)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as the intervals of a hole, one below the other."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    to = F.sum("l_quantity").over(order)
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("hole_id"), (to - F.col("l_quantity")).alias("depth_from"), to.alias("depth_to"),
        F.round(F.col("l_discount") * 100).alias("grade"), (2.0 + F.round(F.col("l_tax") * 100) / 10).alias("density"), F.col("l_returnflag").alias("lith_code"),
    )


INTERVALS = """intervals AS (SELECT hole_id, depth_to - l AS depth_from, depth_to, grade, density, lith_code FROM (SELECT l_orderkey AS hole_id, l_quantity AS l,
 sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate ROWS UNBOUNDED PRECEDING) AS depth_to,
 round(l_discount * 100) AS grade, 2::DOUBLE + round(l_tax * 100) / 10 AS density, l_returnflag AS lith_code FROM lineitem))"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as logged in the field: some shifted, so that there are gaps, overlaps and empty ones."""
    rows = intervals(spark, sf_dir)
    shift = F.when(F.col("grade") == 3, 0.5).when(F.col("grade") == 5, -0.5).otherwise(0.0)
    return rows.withColumns({"depth_from": F.col("depth_from") + shift, "depth_to": F.when(F.col("grade") == 9, F.col("depth_from")).otherwise(F.col("depth_to"))})


LOGGED = INTERVALS + """, logged AS (SELECT hole_id, depth_from + CASE WHEN grade = 3 THEN 0.5 WHEN grade = 5 THEN -0.5 ELSE 0 END::DOUBLE AS depth_from, CASE WHEN grade = 9 THEN depth_from ELSE depth_to END AS depth_to, grade, density, lith_code FROM intervals)"""


def collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collars; every 20th is missing, so that there are orphans."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(key % 20 != 7).select(key.alias("hole_id"), ((key % 100) * 10.0).alias("x"), ((key % 70) * 10.0).alias("y"), (key % 30 + 100.0).alias("z"), (key % 150 + 50.0).alias("length"))


COLLARS = """collars AS (SELECT o_orderkey AS hole_id, ((o_orderkey % 100) * 10)::DOUBLE AS x, ((o_orderkey % 70) * 10)::DOUBLE AS y, (o_orderkey % 30 + 100)::DOUBLE AS z, (o_orderkey % 150 + 50)::DOUBLE AS length FROM orders WHERE o_orderkey % 20 <> 7)"""


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations down the holes: one at each interval's end."""
    return intervals(spark, sf_dir).select("hole_id", F.col("depth_to").alias("depth"), F.pmod(F.col("hole_id") * 7 + F.col("grade") * 2, F.lit(360.0)).cast("double").alias("azimuth"), (-60.0 - F.col("density") * 2).alias("dip"))


SURVEYS = INTERVALS + """, surveys AS (SELECT hole_id, depth_to AS depth, (hole_id * 7 + grade * 2) % 360 AS azimuth, -60::DOUBLE - density * 2 AS dip FROM intervals)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points with a value."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("sample_id"), (key * 37 % 1000).cast("double").alias("x"), (key * 91 % 700).cast("double").alias("y"), (F.col("p_size") * 4).cast("double").alias("z"), (key * 13 % 50 + F.col("p_size")).cast("double").alias("value"), (key % 97).alias("hole"))


SAMPLES = """samples AS (SELECT p_partkey AS sample_id, (p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 91 % 700)::DOUBLE AS y, (p_size * 4)::DOUBLE AS z, (p_partkey * 13 % 50 + p_size)::DOUBLE AS value, p_partkey % 97 AS hole FROM part)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as blocks to be estimated."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("block_id"), (key * 53 % 1000).cast("double").alias("x"), (key * 29 % 700).cast("double").alias("y"), (key * 7 % 200).cast("double").alias("z"))


TARGETS = """targets AS (SELECT s_suppkey AS block_id, (s_suppkey * 53 % 1000)::DOUBLE AS x, (s_suppkey * 29 % 700)::DOUBLE AS y, (s_suppkey * 7 % 200)::DOUBLE AS z FROM supplier)"""
