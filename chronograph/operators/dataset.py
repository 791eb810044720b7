"""Datasets for link prediction and node classification: splits, samples, negatives and features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograph.functions.rand import uniform, uniform32
from chronograph.functions.tables import written
from chronograph.operators.ranking import ranked, time_bucket


def split_sizes(edges: int, ratio: float = 0.8, float32_compat: bool = False) -> dict[str, int]:
    """test = floor(edges * (1 - ratio)), train = 3 * test (at most what is left), valid = test. With ``float32_compat``
    the product is rounded to single precision first."""
    test = int(np.float32(edges) * (np.float32(1) - np.float32(ratio))) if float32_compat else int(edges * round((1 - ratio) * 1e9) // 1e9)
    left = edges - test
    return {"train": min(3 * test, left), "valid": min(test, left), "test": test}


def by_time(edges: DataFrame) -> DataFrame:
    """``edges`` with rn, their 1-based order by (ts, eid)."""
    return ranked(edges, time_bucket(edges, "ts"), [F.col("ts"), F.col("eid")])


def temporal_holdout(edges: DataFrame, test: int) -> tuple[DataFrame, DataFrame]:
    """(earlier, latest ``test``) edges, each with rn."""
    x, n = by_time(edges), edges.count()
    return x.where(F.col("rn") <= n - test), x.where(F.col("rn") > n - test)


def sampled(edges: DataFrame, k: int, seed: int | str) -> DataFrame:
    """``k`` edges without replacement: those of least hash."""
    x = edges.drop("rn").withColumn("_h", uniform32(seed, F.col("eid")))
    return ranked(x, F.floor(F.col("_h") / 2**24), [F.col("_h"), F.col("eid")]).where(F.col("rn") <= k).drop("_h", "rn")


def negatives(positives: DataFrame, edges: DataFrame, num_nodes: int, seed: int, candidates: int = 20) -> DataFrame:
    """(eid, src, dst, exhausted): for each positive, a pair that is no edge.

    A hash decides whether the tail or both ends are redrawn; of ``candidates`` hash-drawn pairs the first non-edge is
    taken. A positive whose candidates are all edges is reported with null ends and ``exhausted``. Positives may have a
    column ``draw`` in place of the seed (then rows are known by draw and eid, and it is returned).
    """
    key = ["draw", "eid"] if "draw" in positives.columns else ["eid"]
    by = F.col("draw") if len(key) > 1 else seed
    tail = uniform(by, F.lit("side"), F.col("eid")) > 0.5
    draw = lambda end: F.pmod(uniform32(by, F.lit(end), F.col("eid"), F.col("r")), F.lit(num_nodes))
    c = positives.select(*key, F.col("src").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("r"))
    c = c.select(*key, "r", F.when(tail, F.col("s")).otherwise(draw("src")).alias("src"), draw("dst").alias("dst"))
    legal = c.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    first = legal.groupBy(*key).agg(F.min(F.struct("r", "src", "dst")).alias("c"))
    return positives.select(*key).join(first, key, "left").select(*key, F.col("c.src").alias("src"), F.col("c.dst").alias("dst"), F.col("c").isNull().alias("exhausted"))


def _nth_missing(taken: list[int] | None, n: int) -> int:
    """The n-th (from 0) natural number that is not in ``taken``."""
    for t in sorted(taken or ()):
        if t > n:
            break
        n += 1
    return n


def complete_negatives(positives: DataFrame, edges: DataFrame, num_nodes: int, seed: int) -> DataFrame:
    """As ``negatives``, with an exhausted positive given a pair of its own by hash: of its source with the vertices that are
    no neighbours, or, if there are none or both ends are redrawn, of any source that has some. ``exhausted`` are only
    positives of a graph that has every edge. Few positives are exhausted unless the graph is nearly full, and sources with
    every edge have as many edges as there are vertices, so what is gathered here is small beside the edges."""
    key = ["draw", "eid"] if "draw" in positives.columns else ["eid"]
    by = F.col("draw") if len(key) > 1 else seed
    found = written(negatives(positives, edges, num_nodes, seed), "negatives")
    if not found.where("exhausted").limit(1).count():
        return found
    left = positives.join(found.where("exhausted").select(*key), key).select(*key, F.col("src").alias("s"))
    known = edges.where(f"src between 0 and {num_nodes - 1} and dst between 0 and {num_nodes - 1}").select("src", "dst").distinct()
    full = known.groupBy("src").count().where(F.col("count") >= num_nodes).select("src")
    closed = F.broadcast(full.agg(F.sort_array(F.collect_list("src")).alias("closed")))
    nth = F.udf(_nth_missing, "long")
    pick = lambda end, n: F.pmod(uniform32(by, F.lit(end), F.col("eid")), n)
    x = left.join(closed).where(F.size("closed") < num_nodes)  # one row
    tail = (uniform(by, F.lit("side"), F.col("eid")) > 0.5) & ~F.array_contains("closed", F.col("s"))
    x = x.select(*key, F.when(tail, F.col("s")).otherwise(nth("closed", pick("free source", num_nodes - F.size("closed")))).alias("src"))
    taken = known.join(x.select("src").distinct(), "src", "left_semi").groupBy("src").agg(F.collect_list("dst").alias("taken"))
    x = x.join(taken, "src", "left")
    free = num_nodes - F.size(F.coalesce("taken", F.array().cast("array<bigint>")))
    x = x.select(*key, F.col("src").alias("s"), nth("taken", pick("free end", free)).alias("d"))
    both = found.join(x, key, "left")
    return both.select(*key, F.coalesce("src", "s").alias("src"), F.coalesce("dst", "d").alias("dst"), (F.col("exhausted") & F.col("s").isNull()).alias("exhausted"))


def link_dataset(edges: DataFrame, ratio: float = 0.8, seed: int = 42, disjoint: bool = False) -> DataFrame:
    """(split, label, eid, src, dst): temporal hold-out, train and valid samples (independent unless ``disjoint``), and a
    negative for each positive unless every pair is an edge. The edges are written once; all splits draw their negatives
    in one pass, each by a seed of its own."""
    edges = written(edges.select("eid", "src", "dst", "ts"), "edges")
    count, top = edges.agg(F.count("*"), F.max(F.greatest("src", "dst"))).first()
    sizes = split_sizes(count, ratio)
    ordered = written(by_time(edges), "ordered")
    pool, test = ordered.where(F.col("rn") <= count - sizes["test"]), ordered.where(F.col("rn") > count - sizes["test"])
    train = sampled(pool, sizes["train"], f"{seed}-train")
    rest = pool.join(train.select("eid"), "eid", "left_anti") if disjoint else pool
    valid = sampled(rest, sizes["valid"], f"{seed}-valid")
    parts = [part.select(F.lit(name).alias("split"), F.lit(seed + k).alias("draw"), "eid", "src", "dst") for k, (name, part) in enumerate((("train", train), ("valid", valid), ("test", test)))]
    positives = written(parts[0].union(parts[1]).union(parts[2]), "positives")
    if not count:
        return positives.select("split", F.lit(1).alias("label"), "eid", "src", "dst")
    name = F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), F.col("draw") - seed + 1)
    missing = complete_negatives(positives, edges, top + 1, seed).where("not exhausted").select(name.alias("split"), F.lit(0).alias("label"), "eid", "src", "dst")
    return positives.select("split", F.lit(1).alias("label"), "eid", "src", "dst").unionByName(missing)


def listed_dataset(edges: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """The older form of :func:`link_dataset`: repeated rows leave each split's positives and negatives."""
    return link_dataset(edges, ratio, seed, disjoint=True).dropDuplicates(["split", "label", "src", "dst"])


def edge_features(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``pairs`` with features = both ends' vectors; a pair without a vector for either end is an error."""
    s, d = embeddings.toDF("src", "_se"), embeddings.toDF("dst", "_de")
    x = pairs.join(s, "src", "left").join(d, "dst", "left")
    missing = F.when(F.col("_se").isNull() | F.col("_de").isNull(), F.raise_error(F.lit("an end has no embedding")))
    return x.withColumn("features", F.coalesce(missing.cast("array<float>"), F.concat("_se", "_de"))).drop("_se", "_de")


def node_features(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    return labels.join(embeddings.toDF("node", "features"), "node")


def label_cap(labels: DataFrame, limit: int = 300) -> DataFrame:
    """The first limit + 1 rows of each label in node order."""
    lo_hi = labels.agg(F.min("node"), F.max("node")).first()
    width = max(1, ((lo_hi[1] or 0) - (lo_hi[0] or 0)) // 64 + 1)
    return ranked(labels, F.floor(F.col("node") / width), [F.col("node")], by=["label"]).where(F.col("rn") <= limit + 1).drop("rn")


def connected_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels up to the last node that has an out-edge."""
    return labels.join(F.broadcast(edges.agg(F.max("src").alias("_m")))).where("node <= _m").drop("_m")  # one row


def label_split(labels: DataFrame, seed: int) -> DataFrame:
    """60/20/20 by hash order: floors for train and valid, the rest is test."""
    n = labels.count()
    a, b = n * 6 // 10, n * 2 // 10
    x = ranked(labels.withColumn("_h", uniform32(seed, F.col("node"))), F.floor(F.col("_h") / 2**24), [F.col("_h"), F.col("node")])
    split = F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "valid").otherwise("test")
    return x.select("node", "label", split.alias("split"))


def class_count(labels: DataFrame) -> DataFrame:
    """Distinct labels, plus one if label 0 is absent."""
    return labels.agg((F.countDistinct("label") + F.when(F.max((F.col("label") == 0).cast("int")) == 1, 0).otherwise(1)).alias("classes"))


def non_edges(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs of a given (small, stated) source set with any vertex that are no edge."""
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    pairs = sources.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top))).alias("dst"))
    return pairs.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
