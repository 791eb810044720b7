"""URL filters by hashed host-suffix and path-prefix expressions. Native: no Python runs on the executors.

A URL expands into every (suffix of its host, prefix of its path) that could be a rule. Host suffixes have as many labels
as some rule; they meet the rules' hosts, which say how long their paths are, and only prefixes of these lengths follow.
Both joins are equi-joins on the first 32 bits of a SHA-256, full digests confirm, and the longest fitting rule wins
(characters of host and path together; of equally long ones a block beats an allow).

Hosts are expanded once each, not once for each url. A rule that fits a third of all urls meets them in SALTS tasks, where
the rules are too many to be broadcast.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8  # of the 64 hexadecimal digits
SALTS = 16  # copies of each rule in a join by shuffle


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _salted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` (short, by) and ``right`` (short) with equal ``short``; those of one value are dealt over SALTS tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    return left.withColumn("_salt", F.pmod(F.xxhash64("by"), F.lit(SALTS)).cast("int")).join(right.select("*", salts), ["short", "_salt"]).drop("_salt")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """host, path, rule and verdict of each distinct value of the column ``url``.

    ``rules`` has verdict (allow or block), host and path, and may be of any size; only the distinct label counts are
    gathered. A rule fits its host and all its subdomains, if the path starts with the rule's. Where no rule fits, rule is
    null and the verdict is ``default``. A null url has an empty host and path and fits nothing; an empty path starts with
    no non-empty rule path; repeated urls are judged once; repeated rules count once; other columns are passed over.
    """
    rules = rules.select("verdict", "host", "path").where("verdict is not null and host <> '' and path is not null").distinct()
    counts = rules.agg(F.sort_array(F.collect_set(F.size(F.split("host", "[.]"))))).first()[0]
    distinct = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not counts:
        return distinct.select("url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    digest = lambda *c: F.sha2(F.concat_ws("\n", *c), 256)
    short = lambda c: F.substring(c, 1, PREFIX_HEX)
    n_labels = F.size(F.split("host", "[.]"))
    suffixes = F.array_compact(F.array(*(F.when(n_labels >= k, F.substring_index("host", ".", -k)) for k in counts)))
    hosts = distinct.where("host <> ''").select("host").distinct().select(F.col("host").alias("by"), F.explode(suffixes).alias("suffix"))
    hosts = hosts.select("by", "suffix", digest("suffix").alias("digest")).withColumn("short", short("digest"))
    known = rules.groupBy(digest("host").alias("full")).agg(F.collect_set(F.length("path")).alias("lengths")).withColumn("short", short("full"))
    spans = _salted(hosts, known).where("digest = full").select(F.col("by").alias("host"), "suffix", "lengths")
    rows = distinct.join(spans, "host").select("url", "path", "suffix", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    rows = rows.select(F.col("url").alias("by"), digest("suffix", F.substring("path", F.lit(1), F.col("n"))).alias("digest")).withColumn("short", short("digest"))
    listed = rules.select("verdict", F.concat("host", "path").alias("rule"), digest("host", "path").alias("full")).withColumn("short", short("full"))
    fits = _salted(rows, listed).where("digest = full")
    best = fits.groupBy("by").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    found = best.select(F.col("by").alias("u"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("fitted"))
    return distinct.join(found, F.col("url") == F.col("u"), "left").select("url", "host", "path", "rule", F.coalesce("fitted", F.lit(default)).alias("verdict"))


def filter_pages(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with the judgement of their urls; a popular url is judged once and joined back."""
    judged = judge(pages, rules, default).withColumnRenamed("url", "_url")
    return pages.select("page_id", "url").join(judged, F.col("url").eqNullSafe(F.col("_url"))).drop("_url")
