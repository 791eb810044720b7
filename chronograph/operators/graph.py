"""Temporal graphs as edge tables (eid, src, dst, ts): structure, degrees, adjacency and clean-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronograph.functions.rand import uniform32
from chronograph.operators.ranking import ranked


@dataclass(frozen=True)
class TemporalGraph:
    """A multigraph: repeated edges and self-loops stay, ``eid`` keeps the input order. Vertices are 0 to the largest id,
    so gaps are isolated vertices."""

    edges: DataFrame
    directed: bool = True

    @staticmethod
    def from_edges(edges: DataFrame, symmetrize: bool = False, dedup: bool = False) -> TemporalGraph:
        e = squish(edges) if dedup else edges
        return TemporalGraph(symmetrized(e) if symmetrize else e, not symmetrize)

    def vertices(self) -> DataFrame:
        return vertices(self.edges)

    def out_degrees(self) -> DataFrame:
        return degrees(self.edges)

    def in_degrees(self) -> DataFrame:
        return degrees(transposed(self.edges))

    def time_spans(self) -> DataFrame:
        return time_spans(self.edges)

    def stats(self) -> DataFrame:
        return stats(self.edges, self.directed)

    def describe(self) -> str:
        r = self.stats().first()
        return f"Graph has {r['num_nodes']} nodes and {r['num_edges']} {'' if self.directed else 'un'}directed edges for degree: {r['degree']}"


def num_nodes(edges: DataFrame) -> DataFrame:
    return edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("num_nodes"))


def vertices(edges: DataFrame) -> DataFrame:
    n = num_nodes(edges).first()[0]
    return edges.sparkSession.range(n).withColumnRenamed("id", "node")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of every vertex, by ``src``."""
    counted = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return vertices(edges).join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def offsets(degree: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Exclusive prefix sums of (node, degree) in node order, by blocks of vertices."""
    x = degree.withColumn("b", F.floor(F.col("node") / block))
    totals = x.groupBy("b").agg(F.sum("degree").alias("t"))
    base = totals.select("b", (F.sum("t").over(W.orderBy("b")) - F.col("t")).alias("base"))
    return x.join(base, "b").select("node", "degree", (F.col("base") + F.sum("degree").over(W.partitionBy("b").orderBy("node")) - F.col("degree")).alias("offset"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbors): out-edges as an array of (ts, dst, eid), by time."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ts", "dst", "eid"))).alias("neighbors"))


def neighbors_from(adjacent: DataFrame, start: int) -> DataFrame:
    """Neighbour slices from an offset, clamped to the list's end."""
    return adjacent.select("src", F.slice("neighbors", start + 1, F.greatest(F.size("neighbors"), F.lit(1))).alias("neighbors"))


def symmetrized(edges: DataFrame) -> DataFrame:
    return edges.select("eid", "src", "dst", "ts").union(edges.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "ts"))


def transposed(edges: DataFrame) -> DataFrame:
    return edges.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "ts")


def squish(edges: DataFrame) -> DataFrame:
    """Without self-loops, one edge per (src, dst), at its least time."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min("ts").alias("ts"), F.min("eid").alias("eid")).select("eid", "src", "dst", "ts")


def relabeled_by_degree(edges: DataFrame) -> DataFrame:
    """Edges of an undirected graph under new ids by (degree, id) descending; its vertices' new ids are ``new_ids``."""
    ids = new_ids(edges)
    s, d = ids.toDF("src", "new_src"), ids.toDF("dst", "new_dst")
    return edges.join(s, "src").join(d, "dst").select("eid", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "ts")


def new_ids(edges: DataFrame) -> DataFrame:
    """(node, new_id): vertices ranked by degree, then id, both descending; degrees are the buckets of the ranking."""
    d = degrees(edges)
    return ranked(d, -F.col("degree"), [F.desc("node")]).select("node", (F.col("rn") - 1).alias("new_id"))


def time_spans(edges: DataFrame) -> DataFrame:
    """(node, delta): the latest minus the earliest time of a vertex's out-edges."""
    return edges.groupBy(F.col("src").alias("node")).agg((F.max("ts") - F.min("ts")).alias("delta"))


def existing(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def missing(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def stats(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(num_nodes, num_edges, degree): an undirected edge is stored twice and counts once; the mean is an integer."""
    m = F.count("*") if directed else F.floor(F.count("*") / 2)
    x = edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("num_nodes"), m.alias("num_edges"))
    return x.withColumn("degree", F.when(F.col("num_nodes") > 0, F.floor(F.col("num_edges") / F.col("num_nodes"))).otherwise(F.lit(0).cast("long")))


def random_source(edges: DataFrame, seed: int, given: int | None = None) -> DataFrame:
    """A vertex with out-edges (the one of least hash), or the given one."""
    if given is not None:
        return edges.sparkSession.createDataFrame([(given,)], "node long")
    return edges.select(F.col("src").alias("node")).distinct().orderBy(uniform32(seed, F.col("node")), "node").limit(1)


def future_edges(edges: DataFrame, node: int, after: float, strict: bool = True) -> DataFrame:
    later = F.col("ts") > after if strict else F.col("ts") >= after
    return edges.where((F.col("src") == node) & later)


def normalized_times(edges: DataFrame, places: int = 10) -> DataFrame:
    """Times scaled to [0, 1] by their extremes and rounded; 0 where all are equal."""
    ends = edges.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), F.round((F.col("ts") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double"), places)).otherwise(0.0)
    return edges.join(F.broadcast(ends)).select(*(c for c in edges.columns if c != "ts"), scaled.alias("ts"))  # one row


def out_of_range(edges: DataFrame, n: int) -> DataFrame:
    return edges.where((F.col("src") < 0) | (F.col("src") >= n) | (F.col("dst") < 0) | (F.col("dst") >= n))


def top_k(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(value), F.desc(key)).limit(k)
