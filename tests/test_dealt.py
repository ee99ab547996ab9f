"""Intervals come in as many parts as their rows ask for."""

from pyspark.sql import functions as F

from orebed.plans import tables


def test_parts_follow_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    rows = spark.range(200).select((F.col("id") / 4).cast("long").alias("l_orderkey"), *(F.col("id").cast("double").alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")), F.lit("N").alias("l_returnflag"), F.current_timestamp().alias("l_shipdate"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = tables.intervals(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 20 and made.count() == 200
