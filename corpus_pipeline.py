"""A training corpus from ``documents``: the stages are applied in order, each to all rows that its predecessor kept.

1. quality classifier: rejected documents go.
2. n-gram Jaccard join (five-word shingles, 0.8): one document of each group of near copies stays, the smallest id.
3. benchmark decontamination: documents that repeat a benchmark item's template go.
4. mixing: sources meet their target weights; a document is kept if the mix takes words of it.
5. sharding: the kept documents get a shard and a slot on the Hilbert curve.

All stages but the last return the columns of their input, whatever these are called. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograph.llm import classifier, decontaminate, jaccard_join, mixing, sharding
from chronograph.llm.queries import table
from chronograph.llm.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of 0.3 or more stay. A null or empty text has the score of no features, equal texts fare alike."""
    return classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the smallest id, null last. Rows without words stay, repeated ones too."""
    return jaccard_join.one_of_each(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat an item go, each by its own text. Null and empty texts stay; without items all rows stay."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows appear as often as the mix takes their id; null and empty texts have no words and go. Null sources are one source."""
    return mixing.keep(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot; repeated rows get slots of their own. Columns beyond those of documents end here."""
    return sharding.assign(docs, carry=("text", "lang", "source", "n_chars")).select("doc_id", "text", "lang", "source", "n_chars", F.col("size").alias("bytes"), "shard", "slot")


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

# The classifier's fit and the shingle components are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
