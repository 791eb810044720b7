"""Mixing sources to target weights by Efraimidis-Spirakis sampling. Native: no Python runs on the executors.

Each document draws the key -ln(u)/w, with u from a hash of the seed and its id and w its quality weight, so small keys
belong to a weighted sample without replacement. A source with target t and size s is taken floor(t/s) times as a whole
(complete epochs first); the rest of its budget is filled by its documents in order of key up to the prefix sum of sizes
that comes nearest the budget. Documents are taken whole, so a source misses its target by half a document at most.

Prefix sums run in two levels: a source of n documents has about sqrt(n) key ranges of about sqrt(n) documents, so neither
level meets in one task as a whole, even where a source holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronograph.llm.order import running
from chronograph.llm.storage import materialize, unused
from chronograph.llm.text import word_count

MAX_EPOCHS = 3


def quality_weights(labels: DataFrame) -> DataFrame:
    """A weight for each labelled document: 0.5 plus its mean quality label (0 or 1)."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("w_id")).agg((F.avg("quality") + 0.5).alias("weight"))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets by source from (source, source_size, n): sources in code-point order, null last, weigh 1, 2, 3, repeating,
    and share the total size; a target stops at ``max_epochs`` times its source's size and the excess is reshared by
    weight until none is above. That fixed point is a water level: sources whose cap per weight is lowest are capped
    first, and each other source gets its weight times the level that is left."""
    x = running(sizes, F.col("source").asc_nulls_last(), F.lit(1), "place")
    x = x.withColumn("w", F.col("place") % 3 + 1)
    x = x.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    x = x.withColumn("band", F.when(F.col("ratio") > 0, F.floor(16 * F.log2("ratio"))).otherwise(-(10**6)))
    x = materialize(x, "mixing-sources")
    sums = x.groupBy(F.col("band").alias("of")).agg(F.sum("cap").alias("caps"), F.sum("w").alias("weights"))  # some 1000 rows at most
    before = W.orderBy("of").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("of", F.coalesce(F.sum("caps").over(before), F.lit(0)).alias("caps"), F.coalesce(F.sum("weights").over(before), F.lit(0)).alias("weights"))
    whole = F.broadcast(x.agg(F.sum("source_size").alias("words"), F.sum("w").alias("all_weights")))  # one row
    below = W.partitionBy("band").orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, -1)
    under = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    x = x.withColumn("caps_in", under("cap")).withColumn("weights_in", under("w")).join(F.broadcast(sums), F.col("band") == F.col("of")).join(whole)
    left, weight = F.col("words") - F.col("caps") - F.col("caps_in"), F.col("all_weights") - F.col("weights") - F.col("weights_in")
    x = materialize(x.withColumn("capped", F.col("ratio") <= left / weight), "mixing-capped")
    free = F.sum(F.when(~F.col("capped"), F.col("w")))
    level = x.agg(((F.sum("source_size") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0))) / free).alias("level"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return x.join(F.broadcast(level)).select("source", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """doc_id, source, size (words), source_size, target and taken (words, repeats counted) of every row of ``docs``.

    ``weights`` has w_id and weight (above 0; 1 where absent). A null text has size 0 and takes nothing; null sources are
    one source, ordered last; rows with a null doc_id draw by their text; repeated rows are separate documents that are taken
    one after another; ties of keys go by doc_id and size; other columns are passed over. An empty table gives no rows. A run with the same seed agrees
    at any partitioning.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    lean = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), name.alias("id"))
    if weights is not None:
        lean = lean.join(weights.select("w_id", "weight"), F.col("doc_id") == F.col("w_id"), "left").drop("w_id")
    else:
        lean = lean.withColumn("weight", F.lit(1.0))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "id")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 1).cast("double") / F.lit(float(2**52))
    key = -F.log(u) / F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6))
    lean = materialize(lean.select("doc_id", "source", "size", key.alias("key")), "mixing")
    sizes = lean.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = materialize(source_targets(sizes), "mixing-targets").withColumnRenamed("source", "s")
    x = lean.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranges = F.ceil(F.sqrt("n"))
    x = x.withColumn("range", F.least(ranges - 1, F.floor(ranges * (1 - F.exp(-F.col("key"))))))
    offsets = x.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    offsets = offsets.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.sum("in_range").over(W.partitionBy("source").orderBy("range")) - F.col("in_range")).alias("before"))
    x = x.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    order = W.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("before", F.col("before") + F.sum("size").over(order) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    extra = (rest > 0) & (2 * F.col("before") + F.col("size") <= 2 * rest)
    return x.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (epochs + extra.cast("int"))).cast("long").alias("taken"))


def keep(docs: DataFrame, weights: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with all their columns; a document that it takes several times
    appears as often, so that what is written holds the mix's epochs.

    Rows meet their share by id; rows without an id, and rows that share an id, are taken as often as any of them is.
    """
    taken = mix(docs, weights, seed).where("taken > 0")
    key, count, n = unused(docs.columns, "_id", "_times", "_n")
    times = taken.groupBy(F.col("doc_id").alias(key)).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias(count))
    x = docs.join(times, F.col("doc_id").eqNullSafe(F.col(key)))
    return x.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(count))).alias(n)).drop(n)
