"""Graph file readers. Each returns (eid, src, dst, ts) with 0-based ids in file order; ts is null where the file has
none, and ``load`` fills it. Malformed rows are errors, blank rows are skipped.

All formats are read as splittable text. A line's place is (file, start of the split, ``monotonically_increasing_id``),
and its eid the last of these; METIS, which needs true line numbers, counts the lines of each split first.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronograph.functions.rand import uniform32

SPACES = r"\s+"


class FormatError(ValueError):
    pass


def suffix(path: str) -> str:
    name = PurePosixPath(path).name
    if "." not in name:
        raise FormatError(f"{path} has no suffix")
    return name.rpartition(".")[2]


def lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """(eid, place, value): lines, trimmed; ``place`` orders them as in the file, or as in the files of a folder by name."""
    eid = F.monotonically_increasing_id()
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), eid.alias("id"))
    x = spark.read.text(path).select(eid.alias("eid"), place.alias("place"), F.trim(F.regexp_replace("value", "\r$", "")).alias("value"))
    return x if blank else x.where("value <> ''")


def numbered(rows: DataFrame) -> DataFrame:
    """(line, value) of ``rows`` (place, value), from 0: the lines of each split are counted, and ranked within it."""
    x = rows.select("place.file", "place.start", "place.id", "value")
    counts = x.groupBy("file", "start").agg(F.count("*").alias("n"))  # a row for each split
    before = counts.select("file", "start", (F.sum("n").over(W.orderBy("file", "start")) - F.col("n")).alias("before"))
    inside = W.partitionBy("file", "start").orderBy("id")
    return x.withColumn("r", F.row_number().over(inside)).join(before, ["file", "start"]).select((F.col("before") + F.col("r") - 1).alias("line"), "value")


def _cast(column: Column, kind: str, what: str) -> Column:
    value = column.try_cast(kind)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(column, F.lit("nothing"))))).otherwise(value)


def _edges(rows: DataFrame, parts: Column, at: int, weighted: bool, base: int) -> DataFrame:
    x = rows.select("eid", parts.alias("p"))
    ts = _cast(F.get("p", F.lit(at + 2)), "double", "time") if weighted else F.lit(None).cast("double")
    return x.select("eid", (_cast(F.get("p", F.lit(at)), "long", "vertex") - base).alias("src"), (_cast(F.get("p", F.lit(at + 1)), "long", "vertex") - base).alias("dst"), ts.alias("ts"))


def read_el(spark: SparkSession, path: str) -> DataFrame:
    return _edges(lines(spark, path), F.split("value", SPACES), 0, False, 0)


def read_wel(spark: SparkSession, path: str) -> DataFrame:
    return _edges(lines(spark, path), F.split("value", SPACES), 0, True, 0)


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).where(F.col("value").rlike(r"^a\s"))
    return _edges(rows, F.split("value", SPACES), 1, True, 1)


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """Header ``n m [format]``; the i-th following line lists the neighbours of vertex i, blank lines included. Format 1
    has pairs of neighbour and weight; 0, 100 or none have neighbours only."""
    rows = numbered(lines(spark, path, blank=True).where(~F.startswith("value", F.lit("%"))))
    first = rows.where("line = 0").select("value").first()
    head = first["value"].split() if first else []
    if not head or not all(h.isdigit() for h in head):
        raise FormatError(f"{path}: no METIS header")
    n, kind = int(head[0]), head[2] if len(head) > 2 else "0"
    if kind not in ("0", "1", "100"):
        raise FormatError(f"{path}: unsupported METIS format {kind}")
    body = rows.where((F.col("line") > 0) & (F.col("line") <= n) & (F.col("value") != ""))
    tokens = body.select((F.col("line") - 1).alias("src"), F.split("value", SPACES).alias("p"))
    each = tokens.select("src", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1, F.lit(2 if kind == "1" else 1))).alias("i"))
    weight = _cast(F.get("p", F.col("i") + 1), "double", "weight") if kind == "1" else F.lit(None).cast("double")
    return each.select((F.col("src") * F.lit(1 << 32) + F.col("i")).alias("eid"), "src", (_cast(F.get("p", F.col("i")), "long", "vertex") - 1).alias("dst"), weight.alias("ts"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate matrices: pattern, or real, double or integer weights; symmetric ones are mirrored, each entry (the
    diagonal too); complex values, arrays, other symmetries and non-square shapes are refused."""
    rows = lines(spark, path)
    first = rows.agg(F.min_by("value", "place").alias("value")).first()["value"]
    banner = (first or "").lower().split()
    if len(banner) != 5 or banner[0] != "%%matrixmarket":
        raise FormatError(f"{path}: no MatrixMarket banner")
    _, kind, layout, field, symmetry = banner
    if (kind, layout) != ("matrix", "coordinate"):
        raise FormatError(f"{path}: only coordinate matrices are read")
    if field not in ("pattern", "real", "double", "integer"):
        raise FormatError(f"{path}: field {field} is not read")
    if symmetry not in ("general", "symmetric", "skew-symmetric"):
        raise FormatError(f"{path}: symmetry {symmetry} is not read")
    body = rows.where(~F.startswith("value", F.lit("%")))
    size = body.agg(F.min_by("value", "place").alias("value"), F.min("place").alias("place")).first()
    n, m, *_ = (size["value"] or "").split() or ["", " "]
    if n != m:
        raise FormatError(f"{path}: the matrix is not square")
    header = F.struct(*(F.lit(size["place"][c]).alias(c) for c in ("file", "start", "id")))
    out = _edges(body.where(F.col("place") > header), F.split("value", SPACES), 0, field != "pattern", 1)
    return out.union(out.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "ts")) if symmetry == "symmetric" else out


READERS = {"el": read_el, "wel": read_wel, "gr": read_gr, "graph": read_metis, "mtx": read_mtx}


def read(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; ``parquet`` is the binary form of a graph."""
    kind = suffix(path)
    if kind == "parquet":
        return spark.read.parquet(path).select("eid", "src", "dst", "ts")
    if kind not in READERS:
        raise FormatError(f"{path}: unknown suffix {kind}")
    return READERS[kind](spark, path)


def with_weights(edges: DataFrame, seed: int = 42) -> DataFrame:
    """Times where there are none: whole numbers from 1 to 255 from a hash of eid."""
    return edges.withColumn("ts", F.coalesce("ts", (F.pmod(uniform32(seed, F.col("eid")), F.lit(255)) + 1).cast("double")))


def load(spark: SparkSession, path: str, seed: int = 42) -> DataFrame:
    return with_weights(read(spark, path), seed)


def read_raw_temporal(spark: SparkSession, path: str) -> DataFrame:
    """Lines of 3 numbers (src dst t) or 4 (src dst _ t); the numbers are the runs of digits, as the format has it."""
    x = lines(spark, path).select("eid", F.regexp_extract_all("value", F.lit(r"(\d+)"), F.lit(1)).alias("a"))
    bad = ~F.size("a").isin(3, 4)
    return x.select("eid", F.when(bad, F.raise_error(F.lit("a line needs 3 or 4 numbers")).cast("long")).otherwise(F.get("a", F.lit(0)).cast("long")).alias("src"), F.get("a", F.lit(1)).cast("long").alias("dst"), F.element_at("a", -1).cast("double").alias("ts"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    x = lines(spark, path).select(F.split("value", SPACES).alias("p"))
    return x.select(_cast(F.get("p", F.lit(0)), "long", "vertex").alias("node"), _cast(F.get("p", F.lit(1)), "int", "label").alias("label"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, step, token) of a walk corpus; steps count from 0."""
    x = lines(spark, path).select(F.col("eid").alias("sentence"), F.posexplode(F.split("value", SPACES)).alias("step", "token"))
    return x.select("sentence", "step", "token")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="token string, cn long")


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of an archive with adjs[T, N, N] and one-hot labels[N, C]: snapshot j has time j / T."""
    import numpy as np
    import pyarrow as pa

    with np.load(path) as z:
        adjs, hot = z["adjs"], z["labels"]
    t, u, v = np.nonzero(adjs)
    edges = spark.createDataFrame(pa.table({"eid": np.arange(len(t)), "src": u, "dst": v, "ts": t / len(adjs)}))
    labels = spark.createDataFrame(pa.table({"node": np.arange(len(hot)), "hot": pa.array(list(hot.astype(np.int32)), pa.list_(pa.int32()))}))
    return edges, labels.select("node", one_hot_label(F.col("hot")).alias("label"))


def one_hot_label(hot: Column) -> Column:
    """The first position that holds 1."""
    return (F.array_position(hot, 1) - 1).cast("int")


def row_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
