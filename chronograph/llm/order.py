"""Running sums in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronograph.llm.storage import materialize


def running(df: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in ``order``, whose values must differ. Rows are dealt over
    tasks by ranges of the order; only a row for each range meets in one task."""
    x = df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()).withColumn("_value", value)
    x = materialize(x, "ordered")
    sums = x.groupBy(F.col("_range").alias("_of")).agg(F.sum("_value").alias("_sum"))
    sums = sums.select("_of", (F.sum("_sum").over(W.orderBy("_of")) - F.col("_sum")).alias("_before"))
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_inside", F.sum("_value").over(inside) - F.col("_value")).join(F.broadcast(sums), F.col("_range") == F.col("_of"))
    return x.withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_value", "_inside", "_of", "_before")
