"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograph.llm import classifier, decontaminate, html_extract, jaccard_join, mixing, quality_rules, sharding, suffix_dedup, url_filters, warc
from chronograph.llm.storage import new_path, ship_package

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path, with_payload=False)
    return records.select(warc.page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id_of("refers_to").alias("refers_to"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.join_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of all 200-byte repeats from all documents."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.filter_pages(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, cut along the Hilbert curve."""
    return sharding.assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


GRID_VALUES = ", ".join(f"('{name}', {i}, CAST({cut} AS DOUBLE))" for name, cuts in quality_rules.GRIDS.items() for i, cut in enumerate(cuts))

ORACLES = {
    "op4_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM dup, (VALUES (0), (1), (2)) o(j) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(greatest(n_words, 1) AS DOUBLE) AS n FROM m),
sig AS (SELECT *, {'symbols_per_word': n_symbols / n, 'dup_lines_per_100_words': 100 * n_dup_lines / n, 'repeat_word_share': n_repeat_words / n,
  'mean_word_chars': word_chars / n, 'short_word_chars': -(word_chars / n)} AS s FROM v),
grid(signal, rank, cutoff) AS (VALUES @GRID@),
val AS (SELECT sig.*, signal, rank, cutoff, CASE signal WHEN 'symbols_per_word' THEN s.symbols_per_word WHEN 'dup_lines_per_100_words' THEN s.dup_lines_per_100_words
  WHEN 'repeat_word_share' THEN s.repeat_word_share WHEN 'mean_word_chars' THEN s.mean_word_chars ELSE s.short_word_chars END AS x FROM sig, grid),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING avg(quality) >= 0.5),
k AS (SELECT lang, signal, rank, cutoff, count(*) AS n, count(*) FILTER (WHERE x > cutoff) AS k FROM val JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY lang, signal, rank, cutoff),
p AS (SELECT *, CASE WHEN k >= n * CAST(0.01 AS DOUBLE) THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(CAST(0.01 AS DOUBLE)) + (n - i) * ln(CAST(0.99 AS DOUBLE))))) END AS p_value,
  CAST(0.05 AS DOUBLE) / count(*) OVER () AS lim FROM k),
cut AS (SELECT lang AS stratum, signal AS sg, arg_min(cutoff, rank) AS cutoff FROM p WHERE p_value <= lim GROUP BY lang, signal),
bad AS (SELECT DISTINCT lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words FROM val JOIN cut ON lang IS NOT DISTINCT FROM stratum AND signal = sg WHERE x > cut.cutoff)
SELECT doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, base_failed, NOT base_failed AND bad.n_words IS NULL AS kept
FROM v LEFT JOIN bad ON v.lang IS NOT DISTINCT FROM bad.lang AND v.n_words = bad.n_words AND v.word_chars = bad.word_chars AND v.n_symbols = bad.n_symbols
  AND v.n_dup_lines = bad.n_dup_lines AND v.n_repeat_words = bad.n_repeat_words""".replace("@GRID@", GRID_VALUES),
    "op2_mixing": r"""
WITH lean AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS hash FROM documents),
weights AS (SELECT doc_id AS w_id, avg(quality) + 0.5 AS weight FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT doc_id, source, size,
    -ln(CAST(CAST('0x' || substr(md5(concat_ws('|', '42', coalesce(CAST(doc_id AS VARCHAR), hash))), 1, 13) AS BIGINT) + 1 AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))
      / greatest(coalesce(weight, CAST(1 AS DOUBLE)), CAST(0.000001 AS DOUBLE)) AS key
  FROM lean LEFT JOIN weights ON doc_id = w_id),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM lean GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s0),
s2 AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM s1),
s3 AS (
  SELECT *, ratio <= CAST((SELECT sum(source_size) FROM s0) - coalesce(sum(cap) OVER below, 0) AS DOUBLE) / ((SELECT sum(w) FROM s1) - coalesce(sum(w) OVER below, 0)) AS capped
  FROM s2 WINDOW below AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT CAST(sum(source_size) - coalesce(sum(cap) FILTER (WHERE capped), 0) AS DOUBLE) / sum(w) FILTER (WHERE NOT capped) AS level FROM s3),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE w * level END AS target FROM s3, lv),
x AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    CAST(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM keyed k JOIN s4 ON k.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x""",
    "op8_url_filters": r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (SELECT row_number() OVER () AS k, page_id,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT k, r.verdict, r.host || r.path AS rule,
  row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS rn
  FROM p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.k = f.k AND rn = 1""",
}

QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filters": op8_url_filters,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
}
