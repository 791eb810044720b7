"""Connected components of a distributed edge list, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograph.llm.storage import drop, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; label is the smallest node of its component.

    ``edges`` has long columns a and b; loops, repeated and reversed edges are allowed. Nothing is gathered: each half
    round is a keyed minimum (combined before the shuffle) and a join back, which adaptive execution splits at hubs.
    Rounds go on until nothing changes; their number grows with the logarithm of the components' diameter. Each is written
    to the shared folder. No edges give no rows.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select("b", "a").toDF("a", "b"))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.least("m", "k").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        pairs = large.join(low, F.col("a") == F.col("k"))
        small = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("k", "m")).distinct()
        new = materialize(small, "edges")
        drop(e)
        e, after = new, _state(new)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
