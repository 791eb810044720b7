"""Writers: text forms sort within partitions of contiguous ranges, so no single task sorts or writes everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograph.operators import walk


def write_edges(edges: DataFrame, path: str, weighted: bool = True) -> None:
    """One line per edge, ``src dst`` or ``src dst ts``, by source, then target and time."""
    if not path:
        raise ValueError("a path is needed")
    columns = ["src", "dst", "ts"] if weighted else ["src", "dst"]
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    edges.repartitionByRange("src").sortWithinPartitions("src", "dst", "ts").select(line).write.text(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """The binary form: Parquet, clustered by source."""
    if not path:
        raise ValueError("a path is needed")
    edges.select("eid", "src", "dst", "ts").repartitionByRange("src").sortWithinPartitions("src", "ts").write.parquet(path)


def write_walks(steps: DataFrame, path: str) -> None:
    walk.corpus(steps).repartitionByRange("walk", "start").sortWithinPartitions("walk", "start").select("line").write.text(path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """``node f f ...`` lines; the header (count and width) is a file of its own, ``<path>-header``."""
    n = embeddings.agg(F.count("*").alias("n"), F.max(F.size("emb")).alias("d"))
    n.select(F.concat_ws(" ", F.col("n").cast("string"), F.col("d").cast("string"))).write.text(f"{path}-header")
    line = F.concat_ws(" ", F.col("node").cast("string"), F.array_join(F.transform("emb", lambda x: x.cast("string")), " "))
    embeddings.repartitionByRange("node").sortWithinPartitions("node").select(line).write.text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.repartitionByRange("vocab_idx").sortWithinPartitions("vocab_idx").select("token", F.col("cn").cast("string")).write.csv(path, sep=" ")


def write_splits(labels: DataFrame, path: str) -> None:
    """A folder per split of space-separated ``node label`` files."""
    labels.select("split", F.col("node").cast("string"), F.col("label").cast("string")).write.partitionBy("split").csv(path, sep=" ")


def write_link_splits(data: DataFrame, path: str) -> None:
    """Folders train_p, train_n, valid_p, ... of ``src dst`` lines, from (split, label, src, dst)."""
    name = F.concat_ws("_", "split", F.when(F.col("label") == 1, "p").otherwise("n"))
    data.select(name.alias("list"), F.col("src").cast("string"), F.col("dst").cast("string")).write.partitionBy("list").csv(path, sep=" ")


def neighbors(adjacent: DataFrame, node: int) -> list[str]:
    """The printed neighbours of one vertex, by time: ``dst ts`` each."""
    rows = adjacent.where(F.col("src") == node).select(F.explode("neighbors").alias("e")).select(F.concat_ws(" ", F.col("e.dst").cast("string"), F.col("e.ts").cast("string")).alias("line"))
    return [r["line"] for r in rows.toLocalIterator()]


def topology(adjacent: DataFrame) -> DataFrame:
    """Printable adjacency: (src, line)."""
    return adjacent.select("src", F.concat(F.col("src").cast("string"), F.lit(": "), F.array_join(F.transform("neighbors", lambda x: x["dst"].cast("string")), " ")).alias("line"))
