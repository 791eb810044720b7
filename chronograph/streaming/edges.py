"""Extension beyond batch runs: temporal edges as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of (src, dst, event_time) edges."""
    return spark.readStream.schema("src long, dst long, event_time timestamp").parquet(path)


def windowed_degrees(edges: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Out-degree and time span of each source per tumbling window; edges later than the watermark are dropped."""
    w = edges.withWatermark("event_time", late).groupBy(F.window("event_time", width), "src")
    span = F.max("event_time").cast("double") - F.min("event_time").cast("double")
    return w.agg(F.count("*").alias("degree"), span.alias("delta"), F.approx_count_distinct("dst").alias("neighbors"))
