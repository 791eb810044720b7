"""Quality rules with risk-controlled thresholds. Native: no Python runs on the executors.

Five signals are measured on every whole text. Two fixed base rules come first. Then each signal gets, in each stratum
(language), the tightest cutoff of its grid whose false rejections are provably few: on labelled documents of good quality
the number of rejections k of n must make "the true rate exceeds alpha" rejectable by the exact binomial test,
P(Bin(n, alpha) <= k) <= delta / m. Both sides are corrected for multiplicity: alpha is the allowed rate of all signals
together divided by their number, and delta is divided by the number m of all tested (stratum, signal, cutoff) triples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronograph.llm.storage import materialize
from chronograph.llm.text import BLANKS, words

# Candidate cutoffs of each signal, tightest first; a document is rejected above the cutoff.
GRIDS = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0],
    "dup_lines_per_100_words": [0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0],
    "repeat_word_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5],
    "mean_word_chars": [5.2, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0, 15.0],
    "short_word_chars": [-4.8, -4.5, -4.0, -3.5, -3.0, -2.0],
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(w: Column) -> Column:
    """How many words stand in 3-word windows that occur at least twice. Windows are compared by 64-bit hashes."""

    def of_hashes(h: Column) -> Column:
        distinct = F.size(F.array_distinct(h))
        return F.when(distinct == F.size(h), F.lit(0)).otherwise(_let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), of_sorted))

    def of_sorted(z: Column) -> Column:
        n = F.size(z)
        pairs = F.zip_with(F.slice(z, 1, n - 1), F.slice(z, 2, n - 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
        return _let(F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))), covered)

    def covered(p: Column) -> Column:
        n = F.size(p)
        gaps = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(n == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))

    def of_word_hashes(v: Column) -> Column:
        n = F.size(v)
        pairs = F.zip_with(F.slice(v, 1, n - 2), F.slice(v, 2, n - 2), lambda a, b: F.xxhash64(a, b))
        return _let(F.zip_with(pairs, F.slice(v, 3, n - 2), lambda ab, c: F.xxhash64(ab, c)), of_hashes)

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(F.transform(w, lambda x: F.xxhash64(x)), of_word_hashes))


def measure(docs: DataFrame) -> DataFrame:
    """The counts and base verdict of every row of ``docs`` (doc_id, text, lang), from the whole text; a null text has
    no words, lines or symbols."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_words = _let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        _repeats(w).cast("long").alias("n_repeat_words"),
    ))
    x = docs.select(
        "doc_id", "lang", of_words.alias("w"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "w.*", "n_symbols", "n_dup_lines")
    return x.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _signals() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / n
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_100_words": 100 * F.col("n_dup_lines") / n,
        "repeat_word_share": F.col("n_repeat_words") / n,
        "mean_word_chars": mean,
        "short_word_chars": -mean,
    }


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 10 on (its error is below 1e-12 there) and as a sum below."""
    x = F.greatest(n, F.lit(10)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    small = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double")))
    return F.when(n < 10, small).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n * p, where terms fall from k down: j steps below k a term is at most exp(-j(j-1)/2k) of
    the first. Those above e**-45 are summed, and the last one stands for each of the rest, so the value is exact to
    rounding at any n and never too small. 1 for other k."""
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.least(k, F.ceil(F.sqrt(90.0 * k)) + 2)
    summed = F.aggregate(
        F.sequence(F.lit(0), steps.cast("int")), start,
        lambda s, i: F.struct((s["term"] * F.greatest(k - i, F.lit(0)) * (1 - p) / ((n - k + i + 1) * p)).alias("term"),
                              (s["sum"] + s["term"] * F.greatest(k - i, F.lit(0)) * (1 - p) / ((n - k + i + 1) * p)).alias("sum")),
    )
    terms = _let(summed, lambda s: s["sum"] + s["term"] * (k - steps))
    return F.when((n == 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * terms))


def select_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The chosen cutoff of each (lang, signal): the tightest of the grid that passes the test; none where none does.

    The holdout is every labelled document that passes the base rules; an id with several labels is good if their mean
    is 0.5 or more; null labels and ids are passed over. A stratum without labels tests nothing and rejects nothing.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.avg("quality").alias("q")).where("q >= 0.5")
    held = measured.where("not base_failed").join(good, F.col("doc_id") == F.col("l_id"))
    counts = [
        F.count_if(signal > cut).alias(f"{name}_{i}") for name, signal in _signals().items() for i, cut in enumerate(GRIDS[name])
    ]
    per = held.groupBy("lang").agg(F.count("*").alias("n"), *counts)
    tests = [
        F.struct(F.lit(name).alias("signal"), F.lit(i).alias("rank"), F.lit(float(cut)).alias("cutoff"), F.col(f"{name}_{i}").alias("k"))
        for name, cuts in GRIDS.items() for i, cut in enumerate(cuts)
    ]
    long = per.select("lang", "n", F.explode(F.array(*tests)).alias("t")).select("lang", "n", "t.*")
    m = F.count("*").over(W.partitionBy())
    tested = long.withColumn("p_value", binomial_cdf(F.col("k"), F.col("n"), alpha / len(GRIDS))).withColumn("limit", F.lit(delta) / m)
    return tested.where("p_value <= limit").groupBy("lang", "signal").agg(F.min_by("cutoff", "rank").alias("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang).

    Null languages are a stratum of their own; repeated rows are judged alike; an empty table gives no rows.
    """
    measured = materialize(measure(docs), "quality")
    cutoffs = select_cutoffs(measured, labels, alpha, delta)
    wide = materialize(cutoffs.groupBy(F.col("lang").alias("stratum")).pivot("signal", list(GRIDS)).agg(F.first("cutoff")), "quality-cutoffs")
    x = measured.join(wide, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    rejected = F.lit(False)
    for name, signal in _signals().items():
        rejected = rejected | F.coalesce(signal > F.col(name), F.lit(False))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
