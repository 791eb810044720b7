"""Every stage of the pipeline against plain Python, on rows with nulls, empty and long texts, repeated rows, shared ids and
columns with the names that the operators use inside, and on empty tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import SF, brute_components, shingles

import corpus_pipeline
from chronograph.llm import classifier, decontaminate, jaccard_join, mixing
from chronograph.llm import queries as q
from chronograph.llm.storage import new_path, ship_package

CLASHES = ("_id", "_score", "_times", "_n", "_r", "h", "size", "shard", "slot", "curve", "component", "n", "least", "_bucket", "weight", "w_id", "same", "node", "taken", "url")


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    table = q.table(spark, SF, "documents")
    item = q.table(spark, SF, "benchmark").where("text is not null").orderBy("item_id").first()["text"]
    base = " ".join(f"word{i * 13 % 97}" for i in range(80))
    odd = [(1_000_001, base, "en", "a", 1), (1_000_001, base, "en", "a", 1), (1_000_002, base + " more", "en", "a", 1), (1_000_005, base + " more", "en", "b", 1), (1_000_005, "a text of its own that shares an id", "en", "b", 1)]
    odd += [(None, base, None, None, None), (None, "without an id but with words", None, None, None), (1_000_006, None, "de", None, None), (1_000_007, "", None, "a", 0), (1_000_008, " \t\n", "en", "a", 3)]
    odd += [(1_000_009, f"Before. {item} After.", "en", "a", 1), (1_000_010, " ".join(f"long{i % 9000}" for i in range(60_000)), "en", "a", 1)]
    rows = table.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "text", "lang", "source", F.col("n_chars")))
    for c in CLASHES:
        rows = rows.withColumn(c, F.lit(7))
    path = new_path(spark, "odd")
    rows.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        q.table(spark, SF, name).write.parquet(f"{path}/{name}.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def rows_of(df):
    return Counter(map(tuple, df.select("doc_id", "text").collect()))


def test_stages_keep_the_columns(spark, docs):
    path, table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, path)
        assert out.columns == table.columns, name
        assert out.where("_id <> 7 or h <> 7 or size <> 7 or _score <> 7 or _r <> 7 or _times <> 7").count() == 0, name


def test_quality(spark, docs):
    path, table = docs
    labels = q.table(spark, path, "labels")
    model = classifier.train(table, labels)
    scored = classifier.score(table.select("doc_id", "text"), model).where("_score >= 0.3")
    assert rows_of(corpus_pipeline.quality(spark, table, path)) == rows_of(scored)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"] for r in scored.collect()}
    good = [d for d, y in marks.items() if y == 1]
    assert sum(d in kept for d in good) >= 0.9 * len(good)


def test_near_duplicates(spark, docs):
    path, table = docs
    rows = [(i, r["doc_id"], r["text"]) for i, r in enumerate(table.select("doc_id", "text").collect())]
    component = {i: c for (i, _, c) in brute_components([(i, t) for i, _, t in rows], 5, 80, 100)}
    groups, want_empty = defaultdict(list), Counter()
    for i, d, t in rows:
        if shingles(t, 5):
            groups[component[i]].append((d is None, d or 0, d, t))
        else:
            want_empty[d, t] += 1
    got = rows_of(corpus_pipeline.near_duplicates(spark, table, path))
    assert got - want_empty == got - Counter({k: n for k, n in got.items() if not shingles(k[1], 5)}) and sum(got.values()) == len(groups) + sum(want_empty.values())
    for members in groups.values():
        least = min(m[:2] for m in members)
        assert sum(got[m[2:]] > 0 for m in {m for m in members if m[:2] == least}) == 1
    assert got[1_000_005, "a text of its own that shares an id"] == 1 and got[None, "without an id but with words"] == 1


def test_decontamination(spark, docs):
    path, table = docs
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(table, q.table(spark, path, "benchmark")).collect()}
    got = rows_of(corpus_pipeline.decontamination(spark, table, path))
    assert 1_000_009 in leaked and got == Counter({k: n for k, n in rows_of(table).items() if k[0] not in leaked})


def test_mixing(spark, docs):
    path, table = docs
    taken = defaultdict(int)
    for r in mixing.mix(table, mixing.quality_weights(q.table(spark, path, "labels"))).collect():
        taken[r["doc_id"]] = max(taken[r["doc_id"]], r["taken"] // r["size"] if r["size"] else 0)
    got = rows_of(corpus_pipeline.mix(spark, table, path))
    assert got == Counter({k: n * taken[k[0]] for k, n in rows_of(table).items() if taken[k[0]]})


def test_whole_run_on_odd_rows(spark, docs):
    path, table = docs
    want = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = stage(spark, want, path)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == rows_of(want)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(16)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert 1_000_009 not in {r["doc_id"] for r in got}


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_whole_run_on_empty_tables(spark, docs, empty):
    path, _ = docs
    other = new_path(spark, "empty")
    for name in ("documents", "labels", "benchmark"):
        x = spark.read.parquet(f"{path}/{name}.parquet")
        (x.limit(0) if name == empty else x.limit(40)).write.parquet(f"{other}/{name}.parquet")
    n = corpus_pipeline.run(spark, other).count()
    assert n == 0 if empty == "documents" else n >= 0


def test_rows_are_compared_whatever_their_ids(spark):
    ship_package(spark)
    x, y, z = "one two three four five six seven", "quite another text than the first one here", "and a third text that has its own words"
    rows = [(1, x), (1, x), (2, y), (5, y), (5, z)]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, x), (2, y), (5, z)])
