"""Classifier metrics as aggregates over (y, p) predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPS = 1e-12


def accuracy(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("accuracy"))


def rounded(df: DataFrame, p: str = "p") -> DataFrame:
    """1 above one half, else 0 (round half to even)."""
    return df.withColumn("predicted", (F.col(p) > 0.5).cast("int"))


def confusion(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(y, predicted).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """(label, tp, fp, fn) of every label that is true or predicted anywhere."""
    c = confusion(df, y, predicted)
    hit = F.when(F.col(y) == F.col(predicted), F.col("n")).otherwise(0)
    miss = F.when(F.col(y) != F.col(predicted), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    rows = c.select(F.col(y).alias("label"), hit.alias("tp"), zero.alias("fp"), miss.alias("fn")).union(c.select(F.col(predicted).alias("label"), zero, miss, zero))
    return rows.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def macro(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Unweighted means over classes; a class without a denominator counts 0."""
    x = per_class(df, y, predicted)
    p, r, f = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn")), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return x.agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"))


def micro(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    x = per_class(df, y, predicted).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return x.select(_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def _curve(df: DataFrame, y: str, p: str, buckets: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """(p, pos, neg, pos_above, neg_above): one row per distinct score (of each ``by``), running counts from the top by
    score ranges."""
    x = df.groupBy(*by, F.col(p).alias("p")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    x = x.withColumn("b", F.floor(-F.col("p") * buckets))
    t = x.groupBy(*by, "b").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    one = W.partitionBy(*by).orderBy("b")
    t = t.select(*by, "b", (F.sum("tp").over(one) - F.col("tp")).alias("bp"), (F.sum("tn").over(one) - F.col("tn")).alias("bn"))
    inside = W.partitionBy(*by, "b").orderBy(F.desc("p"))
    x = x.join(t, [*by, "b"])
    return x.select(*by, "p", "pos", "neg", (F.col("bp") + F.sum("pos").over(inside) - F.col("pos")).alias("pos_above"), (F.col("bn") + F.sum("neg").over(inside) - F.col("neg")).alias("neg_above"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The chance that a positive outscores a negative, ties counting half; null with one class only."""
    return _curve(df, y, p).agg(_auc())


def _auc():
    wins = F.sum((F.col("pos_above") * F.col("neg") + F.col("pos") * F.col("neg") / 2).cast("double"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.when(pairs > 0, wins / pairs).alias("auc")


def one_vs_rest_auc(df: DataFrame, y: str = "y", scores: str = "scores") -> DataFrame:
    """(label, auc) of every class 0, 1, ...: ``scores`` has a score for each, ``y`` is the true one; null where all rows or
    none are of the class. The mean over classes is the macro AUC."""
    x = df.select(F.col(y).alias("y"), F.posexplode(scores).alias("label", "p"))
    x = x.select("label", (F.col("y") == F.col("label")).cast("int").alias("y"), "p")
    return _curve(x, "y", "p", by=("label",)).groupBy("label").agg(_auc())


def roc_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score."""
    whole = F.broadcast(df.agg(F.sum((F.col(y) != 1).cast("long")).alias("negs"), F.sum((F.col(y) == 1).cast("long")).alias("poss")))  # one row
    return _curve(df, y, p).join(whole).select(F.col("p").alias("threshold"), ((F.col("neg_above") + F.col("neg")) / F.col("negs")).alias("fpr"), ((F.col("pos_above") + F.col("pos")) / F.col("poss")).alias("tpr"))


def log_loss(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    q = F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), F.col(p)))
    return df.agg((-F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"))
