"""Structured Streaming forms of the event and interval monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_rate(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Events and their mean value by window; events later than the watermark are dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), *(by or []), "n", "mean_value")


def chunked(spark, path: str, schema, files: int = 1) -> DataFrame:
    """A directory of Parquet files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
