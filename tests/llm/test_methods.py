"""The methods by themselves: each against plain Python, where a result alone would not show that it decides."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import counted, spark_rows
from pyspark.sql import functions as F
from test_operators import DOCS, SF, WORD, fixture_rows

from chronograph.llm import classifier, components, decontaminate, mixing, quality_rules, sharding, suffix_dedup, url_filters, warc
from chronograph.llm import queries as q
from chronograph.llm.order import running
from chronograph.llm.storage import new_path, ship_package, unused

EN = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they".split()


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# --- suffix arrays ------------------------------------------------------------------------------------------------


def contexts(rng, n):
    """Texts around one 64-byte gram, drawn from few pieces so that many windows are equal; some are copies."""
    gram = bytes(rng.randrange(97, 123) for _ in range(64))
    ends = [bytes(rng.randrange(97, 100) for _ in range(136)) for _ in range(3)]
    texts, fronts = [], []
    for _ in range(n):
        before, after = rng.choice(ends), rng.choice(ends)
        front = rng.randrange(0, 137)
        windows = rng.randrange(1, front + 2) if front else 1
        lo, size = 136 - front, windows + 199
        whole = bytearray(before + gram + after)
        if rng.random() < 0.3:
            whole[rng.randrange(len(whole))] = 33
        texts.append(bytes(whole[lo : lo + size]))
        fronts.append(front)
    return texts, fronts


def test_repeats_are_read_from_the_suffix_array(monkeypatch):
    rng, wrong = random.Random(3), 0
    for _ in range(60):
        texts, fronts = contexts(rng, rng.randrange(1, 12))
        start = np.cumsum([0] + [len(t) for t in texts])[:-1]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        x, lo = start + np.array(fronts), start
        hi = start + np.array([len(t) - 200 for t in texts])
        every = [t[i : i + 200] for t in texts for i in range(len(t) - 199)]
        # equal windows of one gram stand at equal offsets from it
        every = [(w, f - i) for t, f in zip(texts, fronts) for i in range(len(t) - 199) for w in [t[i : i + 200]]]
        seen = Counter(every)
        want = [seen[w] > 1 for w in every]
        assert suffix_dedup.repeated_windows(buf, x, lo, hi).tolist() == want
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "suffix_array", lambda s: [len(s) - 1, *range(len(s) - 1)])
            wrong += suffix_dedup.repeated_windows(buf, x, lo, hi).tolist() != want
    assert wrong > 20  # without the order, repeats are missed


def test_suffix_arrays_of_random_sequences():
    rng = random.Random(4)
    for _ in range(500):
        s = [rng.randrange(1, rng.choice((2, 3, 9)) + 1) for _ in range(rng.randrange(0, 60))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [1, 3, 4000])
def test_common_grams_are_parted_without_a_loss(spark, hot):
    line = "This passage of more than two hundred bytes stands in every text, with other words before and after it, so that its grams are common while what surrounds them is not; " * 2
    rng = random.Random(6)
    words = lambda k: " ".join(rng.choice(EN) + str(rng.randrange(999)) for _ in range(k))
    rows = [(i, f"{words(30)} {line} {words(rng.randrange(1, 30))}") for i in range(30)] + [(99, "x" * 1000), (None, None)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    seen = Counter(t.encode()[i : i + 200] for _, t in rows if t for i in range(len(t.encode()) - 199))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert got[i] == (sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest())


# --- risk-controlled cutoffs --------------------------------------------------------------------------------------


def exact_cdf(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_bounds(spark):
    cases = [(0, 793, 0.01), (3, 1000, 0.01), (0, 0, 0.01), (90, 10_000, 0.01), (250_000, 1_000_000, 0.26), (5, 10, 0.2), (995_000, 100_000_000, 0.01)]
    for k, n, p in cases:
        got = spark.createDataFrame([(k, n)], "k long, n long").select(quality_rules.binomial_cdf(F.col("k"), F.col("n"), p)).first()[0]
        want = 1.0 if n == 0 or k >= n * p else exact_cdf(k, n, p)
        assert got == pytest.approx(want, rel=1e-6, abs=0)  # logarithms of factorials round at large n


def labelled(n, seed, bad=0.0):
    """Good documents of 60 words, of which a share has many symbols, and some documents of poor quality."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(EN) + chr(97 + rng.randrange(26)) + str(rng.randrange(10_000)) for _ in range(60)]
        poor = i % 4 == 3
        if poor or rng.random() < bad:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en" if i % 9 else "de", "s", 0))
        labels.append((i, 0 if poor else 1, 0))
    rows += [(n + k, " ".join(f"plain{k}x{j}" for j in range(60)), "fr", "s", 0) for k in range(5)]
    return rows, labels


def test_cutoffs_are_chosen_and_reject(spark):
    rows, labels = labelled(2400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = spark_rows(quality_rules.apply_rules(docs, marks))
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*rows)), strict=True))))
    con.register("labels", pa.table(dict(zip(("doc_id", "quality", "toxic"), map(list, zip(*labels)), strict=True))))
    out = con.execute(q.ORACLES["op4_quality_rules"])
    names = [c[0] for c in out.description]
    assert got == (sorted(names), counted(names, out.fetchall()))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, marks).collect()}
    lang = {r[0]: r[2] for r in rows}
    poor = [d for d, y, _ in labels if not y]
    assert not any(kept[d] for d in poor if lang[d] == "en"), "the stratum with labels enough rejects"
    assert all(kept[d] for d in poor if lang[d] == "de"), "a stratum with few labels tests nothing"
    good = [d for d, y, _ in labels if y]
    assert sum(not kept[d] for d in good) <= 0.05 * len(good), "false rejections stay within alpha"


def test_false_rejections_stay_below_the_bound(spark):
    """Holdouts drawn again and again: a cutoff whose true rate of false rejections is above alpha is chosen in at most a
    share delta of the draws."""
    alpha, delta, n, draws = 0.05, 0.05, 1500, 400
    true = [0.2, 0.06, 0.0101, 0.004, 0.0005]  # of the cutoffs, tightest first; the rate allowed to each signal is 0.01
    rng = np.random.default_rng(8)
    u = rng.random((draws, n))
    rows = [(d, r, int((u[d] < t).sum()), n) for d in range(draws) for r, t in enumerate(true)]
    x = spark.createDataFrame(rows, "draw int, rank int, k long, n long")
    p = quality_rules.binomial_cdf(F.col("k"), F.col("n"), alpha / 5)
    chosen = x.where(p <= delta / len(true)).groupBy("draw").agg(F.min("rank").alias("rank")).collect()
    over = sum(true[r["rank"]] > alpha / 5 for r in chosen)
    assert over <= delta * draws and len(chosen) > draws * 0.9


# --- naive Bayes support vectors ----------------------------------------------------------------------------------


def test_dual_coordinate_descent_reaches_the_optimum():
    """The fitted margin model has no larger hinge objective than a plain dual descent run long, on the same split."""
    rng = np.random.default_rng(2)
    y = np.array([i % 2 for i in range(160)])
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 6), rng.integers(40, 60, 3) + 20 * label])).astype(np.int32) for label in y]
    model = classifier.fit(sets, y, 0.5, epochs=400)
    order = np.random.default_rng(1).permutation(len(sets))
    used = order[len(sets) // 5 :]
    counts = np.ones((2, classifier.DIM))
    for i in used:
        counts[y[i], sets[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.ratio, ratio, atol=1e-5)
    dense = np.zeros((len(used), 101))
    for k, i in enumerate(used):
        v = ratio[sets[i]]
        dense[k, sets[i]] = v / np.sqrt(v @ v)
        dense[k, 100] = 1
    sign = np.where(y[used] == 1, 1.0, -1.0)
    gram, alpha = (dense @ dense.T) * np.outer(sign, sign), np.zeros(len(used))
    for _ in range(3000):
        for k in range(len(used)):
            alpha[k] = min(1.0, max(0.0, alpha[k] - (gram[k] @ alpha - 1) / gram[k, k]))
    objective = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (dense @ w)).sum()
    best = objective(dense.T @ (alpha * sign))
    mine = np.zeros(101)
    known = np.abs(ratio[:100]) > 1e-12
    mine[:100][known] = model.weights[:100][known] / ratio[:100][known]
    mine[100] = model.bias
    assert objective(mine) <= best * 1.01 + 1e-6


def test_features_of_a_fit_are_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert classifier.classify(docs, marks).count() == 40
    model = classifier.train(docs, marks, max_bytes=16_000)
    assert 0 <= float(model.probabilities(np.zeros(1))[0]) <= 1


def test_features_of_a_fit_stay_on_executors(spark, monkeypatch):
    """The driver collects ids, sizes and the model, which is that of a fit on the same features in order of id."""
    ship_package(spark)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0 if i % 3 else 30, 60, 40)) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: collected.append(self.columns) or collect(self))
    model = classifier.train(docs, marks)
    assert collected and not any({"f", "text"} & set(c) for c in collected)
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5]
    ((_, _, r, f),) = classifier.features(pa.array([texts[i] for i in ids]))
    y = np.array([i % 3 > 0 for i in ids], np.int64)
    want = classifier.fit([f[r == k].astype(np.int32) for k in range(len(ids))], y, y.mean())
    assert 0 < y.mean() < 1 and np.array_equal(model.ratio, want.ratio) and np.allclose(model.weights, want.weights)
    assert np.allclose([model.bias, model.slope, model.shift], [want.bias, want.slope, want.shift])


# --- Hilbert order ------------------------------------------------------------------------------------------------


def d2xyz(bits):
    """All cells of a cube in the order of a Hilbert curve, by checking the curve's law on the tested order itself."""
    side = 1 << bits
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    h = sharding.hilbert_index(cells, bits)
    assert sorted(h.tolist()) == list(range(side**3))
    return cells[np.argsort(h)]


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_curve_visits_neighbours_and_whole_octants(bits):
    path = d2xyz(bits)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    for level in range(1, bits):  # each aligned cube is one stretch of the curve
        cube = path >> level
        changes = (np.diff(cube, axis=0) != 0).any(axis=1).sum() + 1
        assert changes == 8 ** (bits - level)


def test_slots_follow_the_curve(spark):
    bits, shards = 5, 16
    table = q.table(spark, SF, "documents")
    extra = spark.createDataFrame([(None, None, None, None), (7, "a b", "en", None), (7, "a b", "en", None), (8, "", "xx", "zz")], "doc_id long, text string, lang string, source string")
    docs = table.select("doc_id", "text", "lang", "source").union(extra)
    rows = [tuple(r) for r in docs.collect()]

    def codes(k):
        order, before, out = sorted(Counter(r[k] for r in rows).items(), key=lambda x: (x[0] is not None, (x[0] or "").encode())), 0, {}
        for name, n in order:
            out[name] = before * (1 << bits) // len(rows)
            before += n
        return out

    langs, sources = codes(2), codes(3)
    want = Counter()
    for d, t, lang, source in rows:
        b = (t or "").encode()
        size = len(b) + 1
        cell = np.array([[langs[lang], sources[source], min(31, int(math.log2(size)))]])
        want[d, size, zlib.crc32(b), int(sharding.hilbert_index(cell, bits)[0])] += 1
    got = sharding.assign(docs, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["curve"]) for r in got) == want
    place = lambda r: (r["shard"], r["slot"])
    curve = [r["curve"] for r in sorted(got, key=place)]
    assert curve == sorted(curve)
    sizes = Counter(r["shard"] for r in got)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - min(sizes.get(k, 0) for k in range(shards)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    again = sharding.assign(docs.repartition(5), shards)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))


@pytest.mark.parametrize("carry", [(), ("text",)])
def test_rows_meet_few_tables(spark, carry):
    """What is known of names and cells is written before, so few broadcasts are in the driver at once."""
    out = sharding.assign(q.table(spark, SF, "documents"), carry=carry)
    assert out.count() == q.table(spark, SF, "documents").count()
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 5


def test_written_shards_hold_every_row(spark):
    docs = spark.createDataFrame(fixture_rows(), DOCS)
    path = new_path(spark, "shards")
    sharding.write_shards(docs, path, 4)
    got = spark.read.parquet(path)
    assert got.count() == len(fixture_rows()) and "in_size" in got.columns and got.where("in_size <> 9 or h <> 9").count() == 0


# --- templates ----------------------------------------------------------------------------------------------------


def plain_tokens(text):
    """Template tokens of a text of blank-parted words: (value, kind), kind None for a literal."""
    out, begin = [], True
    for word in text.split():
        closes = word[-1] in ".!?:"
        while len(word) > 1 and word[0] in "([\"'{,;.!?":
            word = word[1:]
        while len(word) > 1 and word[-1] in ")]\"'},;.!?:":
            word = word[:-1]
        if word in ",;.!?:":
            continue
        if any(c.isdigit() for c in word) and all(c.isdigit() or c in "+-.,:/%$" for c in word):
            kind = "number"
        elif word.lower() in decontaminate.UNITS and out and out[-1][1] == "number":
            kind = "unit"
        elif word[0].isupper() and not begin:
            kind = "name"
        else:
            kind = None
        out.append((word.lower(), kind))
        begin = closes
    return out


def plain_leak(item, doc, coverage=0.6):
    """Whether some alignment of the item in the document covers enough of it by template windows with consistent slots."""
    a, b = plain_tokens(item), plain_tokens(doc)
    shown = lambda x: x[1] or x[0]
    for shift in range(-len(a), len(b)):
        match = [i for i in range(len(a) - 4) if 0 <= i + shift and i + shift + 5 <= len(b) and all(shown(a[i + k]) == shown(b[i + shift + k]) for k in range(5))]
        match = [i for i in match if sum(x[1] is None for x in a[i : i + 5]) >= 3 or any(abs(i - j) < len(a) for j in match)]
        values = defaultdict(Counter)
        for i in match:
            for k in range(5):
                if a[i + k][1]:
                    values[a[i + k][0]][b[i + shift + k][0]] += 1
        best = {v: c.most_common(1)[0][0] for v, c in values.items()}
        ok = {i + k for i in match if all(not a[i + j][1] or best[a[i + j][0]] == b[i + shift + j][0] for j in range(5)) for k in range(5)}
        if ok and len(ok) >= coverage * len(a):
            return True
    return False


def test_templates_against_plain_windows(spark):
    rng = random.Random(12)
    names, things = ["Anna", "Bruno", "Carla", "Dario"], ["apples", "books", "coins", "drums", "eggs"]

    def item(k):
        return f"{rng.choice(['Yesterday', 'Today'])} the seller gave {names[k % 4]} about {rng.randrange(2, 99)} {things[k % 5]} and {rng.randrange(2, 99)} km of rope for the {k}th fair in town, so how many {things[k % 5]} were left there?"

    items = [item(k) for k in range(12)]

    def changed(text):
        out = []
        table = {}
        for w in text.split():
            core = w.strip(",.?")
            if core.isdigit():
                w = w.replace(core, table.setdefault(core, str(rng.randrange(100, 999))))
            elif core in names:
                w = w.replace(core, table.setdefault(core, rng.choice(["Elena", "Fabio"])))
            out.append(w)
        return " ".join(out)

    filler = lambda n: " ".join(rng.choice(EN) for _ in range(n))
    docs = []
    for k in range(60):
        text = rng.choice(items)
        text = (text, changed(text), " ".join(text.split()[: rng.randrange(4, 26)]), filler(20), " ".join(rng.sample(text.split(), 20)))[k % 5]
        docs.append(f"{filler(rng.randrange(5))} so: {text} {filler(rng.randrange(9))}")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, bench).collect()}
    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if plain_leak(t, d)}
    assert got == want and len({i for i, _ in got}) > 20


def test_marks_around_words_are_trimmed_whole(spark):
    item = "the river runs under the old bridge near the mill"
    docs = spark.createDataFrame([(1, " ".join("(" * 200 + w + ")" * 300 for w in item.split())), (2, "((((((( ))))))")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [1]


def test_a_stock_window_in_many_items(spark):
    items = [(i, f"Answer the following question with one of the letters: case {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x of part {EN[i % 27]}") for i in range(700)]
    docs = spark.createDataFrame([(i, f"{t} ok") for i, t in items[:40]], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    full = Counter(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    table = decontaminate.Table(items)
    parts = Counter()
    for d, t in items[:40]:
        buf, off = decontaminate.column_bytes(pa.array([f"{t} ok"]))
        parts.update((d, items[j][0], c, n, v) for _, j, c, n, v in table.match(*decontaminate.template(buf, off), 0.6, most=50))
    assert full == parts and all((i, i) in {(d, k) for d, k, *_ in full} for i, _ in items[:40])


# --- components, archives, urls, mixing ---------------------------------------------------------------------------


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 600)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 600: 600, 900: 600}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def archives(spark, n=20):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "".join(random.Random(i).choices("abcdef <>", k=3000))) for i in range(n)], "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "w")
    warc.write(pages, path)
    from pathlib import Path

    (file,) = Path(path.removeprefix("file:")).glob("*.warc.gz")
    return path, file


@pytest.mark.parametrize("split", [700, 8 << 20])
def test_damage_is_reported(spark, split):
    path, file = archives(spark)
    whole = file.read_bytes()
    file.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="no whole record"):
        warc.read(spark, path, split).count()
    rows = warc.read(spark, path, split, damaged="rows").collect()
    assert Counter(r["record_type"] for r in rows)["damaged"] == 1 and 8 <= len(rows) <= 11
    starts = [i for i in range(len(whole)) if whole.startswith(b"\x1f\x8b\x08", i)]
    for at in (starts[3], starts[0], starts[-1]):  # the magic of a member is overwritten
        file.write_bytes(whole[:at] + b"\0\0\0" + whole[at + 3 :])
        kinds = Counter(r["record_type"] for r in warc.read(spark, path, split, damaged="rows").collect())
        assert kinds == {"response": 19, "damaged": 1}, (at, kinds)
    file.write_bytes(whole)
    assert Counter(r["record_type"] for r in warc.read(spark, path, split).collect()) == {"response": 20}


def test_archives_of_an_empty_table_and_of_odd_ids(spark):
    schema = "page_id long, url string, html string"
    path = new_path(spark, "none")
    warc.write(spark.createDataFrame([], schema), path)
    assert warc.read(spark, path).count() == 0
    path = new_path(spark, "odd")
    warc.write(spark.createDataFrame([(None, "u", "x"), (None, None, "y"), (3, "a\r\nb", "z"), (3, "c", "z"), (2, "d", "z"), (None, "e", "z")], schema), path)
    got = Counter((r["id"], r["record_type"], r["to"]) for r in warc.read(spark, path).select(warc.page_id_of("record_id").alias("id"), "record_type", warc.page_id_of("refers_to").alias("to")).collect())
    assert got == Counter({(None, "response", None): 2, (3, "response", None): 2, (2, "revisit", 3): 1, (None, "revisit", 3): 1})


def test_url_rules_against_plain_python(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/"), ("block", "a.b.example.net", ""), ("allow", "net", "/"), ("block", "", "/"), (None, "org", "/")]
    urls = [None, "", "nowhere", "http://net", "http://NET/", "http://x.net/en/a?b", "https://example.net/en/x", "ftp://www.EXAMPLE.net/en", "http://a.b.example.net#f", "http://c.a.b.example.net/en/", "http://notnet/", "http://example.net:80/en/", "http://org/"]
    rows = [(i, u, "own", "path") for i, u in enumerate(urls * 2)]

    def verdict(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end].lower(), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if v and h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    frame = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_pages(frame, url_filters.rule_table(spark, rules)).collect())
    assert got == Counter((i, *verdict(u)) for i, u, *_ in rows)


def test_rows_without_an_id_draw_apart(spark):
    docs = spark.createDataFrame([(None, f"text {i} " * (i + 1), "s") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(docs)
    assert got.count() == 50
    assert docs.select(F.md5("text")).distinct().count() == 50
    total = got.agg(F.sum("size"), F.sum("taken")).first()
    assert total[0] == total[1]


def test_unused_names():
    assert unused(["_n", "a"], "_n", "_n", "b") == ["__n", "___n", "b"] and unused(["_N"], "_n") == ["__n"]


def test_words_are_those_of_the_pattern(spark):
    text = "a\tb\x0bc\x0cd\re\n f g  "
    assert WORD.findall(text) == ["a", "b", "c", "d", "e", "f g"]


def test_running_sums_in_a_global_order(spark):
    rng = random.Random(1)
    rows = [(f"host{rng.randrange(10**6)}-{i}", rng.randrange(50)) for i in range(3000)] + [(None, 7), ("", 3)]
    got = {r["name"]: r["before"] for r in running(spark.createDataFrame(rows, "name string, n long"), F.col("name").asc_nulls_last(), F.col("n"), "before").collect()}
    before = 0
    for name, n in sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode())):
        assert got[name] == before
        before += n
    assert running(spark.createDataFrame([], "name string, n long"), F.col("name").asc(), F.col("n"), "before").count() == 0


def test_many_sources_meet_their_targets(spark):
    """The water level over very many sources, against plain resharing until no target is above its cap."""
    rng = random.Random(2)
    sizes = {f"s{i:04d}": rng.choice((1, 5, 40, 700)) for i in range(400)} | {"big": 30_000}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    capped: set[str] = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s, w in weight.items() if s not in capped and w * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    assert len(capped) > 100
    for s in sizes:
        assert got[s] == pytest.approx(3 * sizes[s] if s in capped else weight[s] * level)
