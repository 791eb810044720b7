"""Sharding along a Hilbert curve, for multidimensional file pruning.

Language, source and size are quantised to ``bits`` bits each: the two names by cumulative share of rows in code-point
order (so that equal names share a coordinate, coordinates keep the order of names, and each is about equally full), the
size by its binary logarithm. Rows are ordered by the index of their cell on the three-dimensional Hilbert curve and the
order is cut into runs of equal row counts, so a shard covers a compact box of the metadata space and min/max statistics
prune it on any dimension.

Nothing is sorted globally: cells (at most 2**(3*bits)) and about sqrt(n) hash buckets in a cell of n rows give offsets,
and only rows of one bucket meet in one task, so a cell with a third of all rows is still sorted in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronograph.llm.order import running
from chronograph.llm.storage import drop, materialize, ship_package


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of an (n, dims) array of ``bits``-bit coordinates (Skilling's transform)."""
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _on_curve(cells: DataFrame, bits: int) -> DataFrame:
    """``cells`` (cell, n) with h, the index of each on the curve."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            sides = np.stack([cell >> (2 * bits), (cell >> bits) & ((1 << bits) - 1), cell & ((1 << bits) - 1)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(sides, bits), pa.int32())], ["cell", "n", "h"])

    return cells.mapInArrow(index, "cell int, n long, h int")


def _codes(lean: DataFrame, name: str, bits: int, whole: int) -> DataFrame:
    """A coordinate for each distinct value: the share of the ``whole`` rows with smaller values, nulls first."""
    n = lean.groupBy(F.col(name).alias(f"{name}_v")).agg(F.count("*").alias("n"))
    n = running(n, F.col(f"{name}_v").asc_nulls_first(), F.col("n"), "before")
    code = F.floor(F.col("before") * (1 << bits) / F.lit(whole)).cast("int")
    return materialize(n.select(f"{name}_v", code.alias(f"c_{name}")), "sharding-codes")


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def assign(docs: DataFrame, shards: int = 16, bits: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Shard and slot of every row of ``docs`` (doc_id, text, lang, source; other columns are ignored unless carried).

    Shard sizes differ by one row at most; slots count from 0 within a shard. Within a cell the order is by a hash of the
    row, then doc_id, so reruns agree. Null names have a coordinate of their own (first), a null text has size 1 and the
    checksum of no bytes, null doc_ids sort first, repeated rows take adjacent slots, and an empty table gives no rows.
    Carried columns come back as they are; one that has the name of a column of the result is called ``in_`` and that name.
    """
    ship_package(docs.sparkSession)
    extra = {c: f"in_{c}" if c.lower() in RESULT else c for c in carry if c != "doc_id"}
    names = list(dict.fromkeys(["doc_id", "text", "lang", "source", *extra]))
    hidden = dict(zip(names, (f"_in{i}" for i in range(len(names))), strict=True))  # own names inside
    base = docs.select(*(F.col(c).alias(h) for c, h in hidden.items()))
    text = F.col(hidden["text"])
    base = base.select("*", F.col("_in0").alias("doc_id"), F.col(hidden["lang"]).alias("lang"), F.col(hidden["source"]).alias("source"), _size(text).alias("_size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("_crc"))
    base = base.select("doc_id", "lang", "source", "_size", "_crc", *(hidden[c] for c in extra))
    lean = materialize(base.select("doc_id", "lang", "source", "_size", "_crc"), "sharding")
    whole = lean.count()
    langs, sources = _codes(lean, "lang", bits, whole), _codes(lean, "source", bits, whole)

    def placed(rows: DataFrame) -> DataFrame:
        top = (1 << bits) - 1
        x = rows.join(langs, F.col("lang").eqNullSafe(F.col("lang_v"))).join(sources, F.col("source").eqNullSafe(F.col("source_v")))
        c_size = F.least(F.lit(top), F.floor(F.log2(F.col("_size").cast("double")))).cast("int")
        x = x.withColumn("cell", F.col("c_lang") * (1 << (2 * bits)) + F.col("c_source") * (1 << bits) + c_size)
        return x.drop("lang_v", "source_v", "c_lang", "c_source")

    # each step is written, so that the driver never holds the broadcasts of several in one plan
    keyed = materialize(placed(lean).select("doc_id", "_size", "_crc", "cell"), "sharding-keyed")
    drop(lean)
    cells = _on_curve(keyed.groupBy("cell").agg(F.count("*").alias("n")), bits)
    cells = cells.select(
        "cell", "h", F.ceil(F.sqrt("n")).alias("_buckets"),
        (F.sum("n").over(W.orderBy("h")) - F.col("n")).alias("_before"), F.lit(whole).cast("long").alias("_total"),
    )
    cells = F.broadcast(materialize(cells, "sharding-cells"))  # a row for each cell of the curve at most
    bucket = F.pmod(F.xxhash64("doc_id", "_crc", "_size"), F.col("_buckets")).alias("_bucket")
    counts = keyed.join(cells, "cell").select("cell", bucket, "_before").groupBy("cell", "_bucket", "_before").agg(F.count("*").alias("n"))
    offsets = counts.select("cell", "_bucket", (F.col("_before") + F.sum("n").over(W.partitionBy("cell").orderBy("_bucket")) - F.col("n")).alias("_offset"))
    rows = (placed(base) if carry else keyed).join(cells, "cell").select("*", bucket)
    rows = rows.join(offsets, ["cell", "_bucket"])
    order = W.partitionBy("cell", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "_crc", "_size")
    rows = rows.withColumn("_rank", F.col("_offset") + F.row_number().over(order) - 1)
    rows = rows.withColumn("shard", F.expr(f"cast(_rank * {shards} div _total as int)"))
    slot = F.col("_rank") - F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id", *(F.col(hidden[c]).alias(name) for c, name in extra.items()), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("curve"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write whole documents as one folder of files per shard, each sorted by slot; columns are named as by :func:`assign`."""
    out = assign(docs, shards, carry=tuple(docs.columns), **options)
    out.repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
