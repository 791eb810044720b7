"""Synthetic graphs from hash-uniforms: row i of a generator depends on (seed, i) alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograph.functions.rand import uniform, uniform32

MAX_SCALE = 40


def _checked(scale: int) -> int:
    if not 0 < scale <= MAX_SCALE:
        raise ValueError(f"scale must be 1 to {MAX_SCALE}")
    return 1 << scale


def uniform_edges(spark: SparkSession, scale: int, degree: int = 16, seed: int = 42) -> DataFrame:
    n = _checked(scale)
    low = lambda end: uniform32(seed, F.lit(end), F.col("id"))
    wide = lambda end: low(end) + F.shiftleft(uniform32(seed, F.lit(f"{end} high"), F.col("id")) % F.lit(max(1, n >> 32)), 32)
    draw = lambda end: F.pmod(low(end) if n <= 1 << 32 else wide(end), F.lit(n))
    return spark.range(n * degree).select(F.col("id").alias("eid"), draw("src").alias("src"), draw("dst").alias("dst"))


def rmat_edges(spark: SparkSession, scale: int, degree: int = 16, seed: int = 42, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """Kronecker edges: each level picks a quadrant; then ids are permuted by hash order."""
    n = _checked(scale)
    levels = F.transform(F.sequence(F.lit(0), F.lit(scale - 1)), lambda k: uniform(seed, F.lit("q"), F.col("id"), k))
    x = spark.range(n * degree).select(F.col("id").alias("eid"), levels.alias("u"))
    src = F.aggregate("u", F.lit(0).cast("long"), lambda s, u: s * 2 + (u >= a + b).cast("long"))
    dst = F.aggregate("u", F.lit(0).cast("long"), lambda s, u: s * 2 + ((u >= a) & (u < a + b) | (u >= a + b + c)).cast("long"))
    return permuted(x.select("eid", src.alias("src"), dst.alias("dst")), n, seed)


def permuted(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """``edges`` under a random permutation of 0 to n - 1: the rank of each id's hash."""
    from chronograph.operators.ranking import ranked

    ids = edges.sparkSession.range(n).select(F.col("id").alias("node"), uniform32(seed, F.lit("p"), F.col("id")).alias("h"))
    new = ranked(ids, F.floor(F.col("h") / 2**24), [F.col("h"), F.col("node")]).select("node", (F.col("rn") - 1).alias("new"))
    s, d = new.toDF("src", "s"), new.toDF("dst", "d")
    return edges.join(s, "src").join(d, "dst").select("eid", F.col("s").alias("src"), F.col("d").alias("dst"))


def synthetic_temporal(spark: SparkSession, n: int, m: int, seed: int = 42) -> DataFrame:
    """A simple undirected random graph of m edges (fewer if draws repeat or n is small), times floor(m * u) / m: of 4 m
    drawn pairs the first m distinct ones by draw number are kept."""
    draw = lambda end: F.pmod(uniform32(seed, F.lit(end), F.col("id")), F.lit(n))
    x = spark.range(4 * m).select("id", draw("a").alias("a"), draw("b").alias("b")).where("a <> b")
    pairs = x.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("id").alias("eid"))
    from chronograph.operators.ranking import ranked

    first = ranked(pairs, F.floor(F.col("eid") / max(1, 4 * m // 64)), [F.col("eid")]).where(F.col("rn") <= m)
    return first.select("eid", "src", "dst", (F.floor(F.lit(m) * uniform(seed, F.lit("t"), F.col("eid"))) / F.lit(m)).alias("ts"))
