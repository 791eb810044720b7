"""Global order without a single-partition sort.

A monotone bucket number splits the order into stretches. Only a row per bucket meets in one task; within buckets, windows
run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(df: DataFrame, bucket: Column, order: list[Column], name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """``df`` with its 1-based global rank in ``order``, overall or within each ``by``; ``bucket`` is a long that never
    falls along the order. Ties in ``order`` get ranks in an unspecified order, so give a total one."""
    by = by or []
    x = df.withColumn("_b", bucket)
    counts = x.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_b")) - F.col("_n")
    offsets = counts.select(*by, "_b", before.alias("_before"))
    x = x.join(offsets, [*by, "_b"])
    return x.withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy(*by, "_b").orderBy(*order))).drop("_b", "_before")


def time_bucket(df: DataFrame, column: str, buckets: int = 64) -> Column:
    """Equal stretches of a numeric column's range, from its minimum and maximum."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or lo == hi:
        return F.lit(0).cast("long")
    return F.least(F.lit(buckets - 1), F.floor((F.col(column) - F.lit(lo)) / F.lit((hi - lo) / buckets))).cast("long")


def following(df: DataFrame, bucket: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the value of the next row in a global order (null for the last)."""
    x = df.withColumn("_b", bucket)
    inside = W.partitionBy("_b").orderBy(*order)
    x = x.withColumn("_next", F.lead(value).over(inside)).withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    firsts = df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(inside)).where("_r = 1").select("_b", F.col(value).alias("_v"))
    after = firsts.select("_b", F.lead("_v").over(W.orderBy("_b")).alias("_v"))  # a row per bucket
    x = x.join(after, "_b", "left")
    return x.withColumn(name, F.when(F.col("_last"), F.col("_v")).otherwise(F.col("_next"))).drop("_b", "_next", "_last", "_v")
