"""The dealt operators: against SQL where there is some, else against brute force, on a fixture with nulls, empty and
long texts, ties, repeated rows and clashing extra columns, and on empty tables."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from compare import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

from chronograph.llm import classifier, decontaminate, html_extract, jaccard_join, mixing, quality_rules, sharding, suffix_dedup, url_filters, warc
from chronograph.llm import queries as q
from chronograph.llm.storage import new_path, ship_package

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, node long, weight double, size long, h int"


def fixture_rows():
    base = " ".join(f"w{i * 7 % 101}x{i}" for i in range(120))
    texts = [base, base, base + " tail", base.upper(), "Ünïcode " + base, None, "", " \t\n", "one", "ONE", "two words", base[:400] + " " + base[:400], " ".join(f"long{i % 5000}" for i in range(40_000)), base]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "ab"[i % 2], 0) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, "en", "a", 0), (None, None, None, None, None), (-3, base + " tail", "de", "b", 0)]
    return [(*r, 9, 9, 9.0, 9, 9) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(fixture_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    ship_package(spark)
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (2, 0, 0), (8, 0, 0), (8, 1, 0), (None, 1, 0), (3, None, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_as_sql(spark, name):
    assert spark_rows(q.QUERIES[name](spark, SF)) == sql_rows(connect(SF), q.ORACLES[name])


def test_warc_round_trip(spark):
    ship_package(spark)
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 9, "x" * 3_000_000]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://h/{i}", h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, refers_to string")
    path = new_path(spark, "t")
    warc.write(pages, path)
    got = {r["record_id"]: r for r in warc.read(spark, path, split_bytes=20_000).withColumn("record_id", warc.page_id_of("record_id")).withColumn("refers_to", warc.page_id_of("refers_to")).collect()}
    assert set(got) == set(range(6))
    last = {}
    for i, h in enumerate(html):
        last[(h or "").encode()] = i
    for i, h in enumerate(html):
        b, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[b] == i else ("revisit", last[b]))


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size, num, den):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(held):
        for j, b in held[:k]:
            if den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("size, num", [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(spark, docs, size, num):
    got = lambda d: Counter(tuple(r) for r in jaccard_join.join_components(d, size, num, 100).collect())
    assert got(docs) == brute_components([r[:2] for r in fixture_rows()], size, num, 100)
    table = q.table(spark, SF, "documents")
    assert got(table) == brute_components([(r["doc_id"], r["text"]) for r in table.collect()], size, num, 100)


def test_suffix_dedup_is_exact(spark, docs):
    def check(frame):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in frame.select("doc_id", "text").collect()]
        seen = Counter(hash(t[i : i + 200]) for _, t in rows for i in range(len(t) - 199))  # 64 bits, to hold long texts
        want = Counter()
        for d, t in rows:
            gone = bytearray(len(t))
            for i in range(len(t) - 199):
                if seen[hash(t[i : i + 200])] > 1:
                    gone[i : i + 200] = b"\1" * 200
            kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
            want[(d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
        got = suffix_dedup.remove_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert Counter(tuple(r) for r in got.collect()) == want

    check(docs)
    check(q.table(spark, SF, "documents"))


def test_suffix_array():
    for s in ([1, 2, 1, 2, 1, 0], [5, 5, 5, 5, 0], [3, 1, 2, 3, 1, 2, 3, 0], [0]):
        assert list(suffix_dedup.suffix_array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_html_extraction(spark):
    ship_package(spark)
    page = lambda i: f"<html><head><title>t</title><style>x</style></head><body><nav>menu</nav><article><h1>Title {i}</h1><p>Body&nbsp;of {i} &amp; <b>more</b></p><p>Same line on all pages</p></article><div class='comments'>reader says {i}</div><footer>foot</footer><script>var a</script></body></html>"
    rows = [(i, f"http://h/{i}", page(i), "x") for i in range(40)] + [(40, None, None, "x"), (41, "nowhere", "", "x"), (42, "http://h/q", "<p>open <div>x" * 300, "x"), (43, "http://o/", "plain  text", "x")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(got) == 44 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[7]["text"] == "Title 7\n\nBody of 7 & more\n\nSame line on all pages"
    assert (got[40]["text"], got[41]["text"], got[43]["text"]) == ("", "", "plain text")


def extracted(spark, pages):
    ship_package(spark)
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_extraction_keeps_texts_that_differ(spark):
    page = lambda i, bare, by: f"<html><body><article>{bare}<h1>Title {i}</h1><h2>{by}</h2><p>Body {i}</p></article></body></html>"
    got = extracted(spark, [(f"http://h/{i}", page(i, "Bare words" if i == 3 else "", f"By writer {i % 2}")) for i in range(60)] + [(f"http://g/{i}", page(i, "", "Filed by the desk" if i else "A guest")) for i in range(60)])
    assert got[3] == "Bare words\n\nTitle 3\n\nBy writer 1\n\nBody 3" and got[4] == "Title 4\n\nBy writer 0\n\nBody 4"
    assert got[60] == "Title 0\n\nA guest\n\nBody 0" and got[61] == "Title 1\n\nFiled by the desk\n\nBody 1"


def test_html_extraction_aligns_all_pages_of_a_host(spark):
    extra = ("", "<ul><li>a{0}</li></ul>", "<table><tr><td>b{0}</td></tr></table>", "<blockquote>c{0}</blockquote>", "<pre>d{0}</pre>", "<p><em>e{0}</em></p>")
    page = lambda i: f"<html><body><div class=x>Our site since 1999</div><div class=y><h2>Title {i}</h2><p>Body {i}</p>{extra[i % 6].format(i)}</div><div class=z>All rights kept</div></body></html>"
    got = extracted(spark, [(f"http://h/{i}", page(i)) for i in range(12)])
    assert got[0] == "Title 0\n\nBody 0" and got[8] == "Title 8\n\nBody 8\n\nb8" and got[11] == "Title 11\n\nBody 11\n\ne11"
    assert not [t for t in got.values() if "since" in t or "rights" in t]


def test_html_extraction_keeps_marked_elements_that_hold_text(spark):
    article = "<article><h1>Title {0}</h1><p class=notice>Note {0}</p><p>See <span class=related-term>term {0}</span></p><div class=share>Share this</div></article>"
    around = ("<div class='content has-sidebar'>", "<div id=search-results>", "<div class='page with-comments'>", "<div class='page comments'>")
    pages = [(f"http://{k}/{i}", f"<html><body>{a}{article.format(i)}</div><div class=comments><p>reader {i}</p></div></body></html>") for k, a in enumerate(around) for i in range(6)]
    pages += [(f"http://x/{i}", f"<html><body><div class=sidebar>Fixed</div><p class=notice>Words {i}</p></body></html>") for i in range(6)]
    pages += [("http://y/", "<main>Real<div class=comments><article>reader</article></div></main>")]
    got = extracted(spark, pages)
    assert all(got[k * 6 + i] == f"Title {i}\n\nNote {i}\n\nSee term {i}" for k in range(4) for i in range(6))
    assert got[24] == "Words 0" and got[30] == "Real"


def test_html_extraction_leaves_out_comments_and_adverts_of_an_article(spark):
    article = "<article><h1>Title {0}</h1><p class=comment>Remark {0}</p><div class='ad wide'>Buy {0}</div><p>Body {0}</p><section id=comments><p>reader {0}</p><article>answer {0}</article></section></article>"
    got = extracted(spark, [(f"http://h/{i}", f"<html><body>{article.format(i)}</body></html>") for i in range(7)])
    assert got == {i: f"Title {i}\n\nRemark {i}\n\nBody {i}" for i in range(7)}


STOCK = [f"offer {k} of the week" for k in range(6)]


def plain_page(i):
    """A page without a telling tag or name: menu and advert from a stock, a headline, a byline, an optional box, closing lines."""
    menu = "".join(f"<li>{STOCK[(i + k) % 6]}</li>" for k in range(3))
    box = f"<div class=k><p>Only page {i} says this</p></div>" if i % 25 == 3 else ""
    return f"<html><body><div class=a><ul>{menu}</ul></div><div class=b>{STOCK[i % 6]}</div><div class=c><h1>Head {i}</h1><p>By writer {i % 2}</p>{box}<p>First {i}</p><p>Second {i * 7}</p></div><div class=d>Kept by host, {STOCK[i % 5]}</div><div class=e>All rights kept</div></body></html>"


def test_html_extraction_by_alignment_alone(spark):
    ship_package(spark)
    frame = spark.createDataFrame([(i, f"http://h/{i}", plain_page(i)) for i in range(100)], "page_id long, url string, html string")
    for tags in (True, False):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(frame, tags).collect()}
        for i, text in got.items():
            box = [f"Only page {i} says this"] if i % 25 == 3 else []
            assert text.split("\n\n") == [f"Head {i}", f"By writer {i % 2}", *box, f"First {i}", f"Second {i * 7}"], (tags, i)


def test_html_extraction_of_deep_pages(spark):
    page = lambda i: "<div>" * 3000 + f"<p>Deep {i}</p><nav>Menu {i}</nav>" + "</div>" * 3000
    got = extracted(spark, [(f"http://h/{i}", page(i)) for i in range(3)])
    assert got == {i: f"Deep {i}" for i in range(3)}


def brute_match(a, b):
    """The largest match of two trees (label, children) that keeps order and parents, by trying all."""
    if a[0] != b[0]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), brute_match(xs[0], ys[0]) + best(xs[1:], ys[1:]))

    return 1 + best(a[1], b[1])


def test_tree_matching_is_the_largest():
    rng = random.Random(5)

    def tree(depth):
        return rng.choice(("div", "p", "ul")), [tree(depth - 1) for _ in range(rng.randrange(4 if depth else 1))]

    html = lambda t: f"<{t[0]}>{''.join(map(html, t[1]))}</{t[0]}>" if t[0] != "p" else "<p></p>"
    plain = lambda n: (n.label, [plain(k) for k in n.kids])
    for _ in range(300):
        a, b = (html_extract.parse(html(tree(3))) for _ in range(2))
        w = html_extract.Wrapper.of(html_extract.skeleton(b))
        matched = html_extract.align(a, w)
        assert len(matched) == html_extract._score(a, w, {}) == brute_match(plain(a), plain(b))


def test_classifier_on_held_out_rows(spark, docs, labels):
    scored = q.op7_quality_classifier(spark, "/root/testdata/sf0.01").join(q.table(spark, "/root/testdata/sf0.01", "labels").where("quality is not null"), "doc_id").where("held_out")
    rows = scored.select("score", "quality").collect()
    good, bad = [r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.85, auc
    out = classifier.classify(docs, labels).collect()
    assert len(out) == len(fixture_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_sharding_law(docs):
    rows = sharding.assign(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(fixture_rows()) and max(map(len, slots.values())) - min(len(slots.get(k, ())) for k in range(16)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination_finds_plain_and_changed_copies(spark):
    ship_package(spark)
    item = "A farmer sold 12 baskets of apples to Anna for 30 euros and then bought 7 more baskets from the market in town."
    other = item.replace("12", "48").replace("Anna", "Bruno").replace("30", "90").replace("7", "5")
    docs = spark.createDataFrame([(1, f"Before that. {item} After."), (2, f"Intro words here. {other} End."), (3, "The weather in the hills was mild and the river was calm all through the long week of the fair."), (4, None), (5, ""), (1, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["new_values"] > 0) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == Counter({(1, 10, False): 2, (2, 10, True): 1})
    assert sorted(r["doc_id"] for r in decontaminate.remove_leaks(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def leaks(spark, docs, items):
    ship_package(spark)
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["new_values"] for r in decontaminate.find_leaks(docs, bench).collect()}


def test_decontamination_of_dense_and_short_items(spark):
    numbers = "The values are 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610. What is next?"
    names = "Present were Anna, Bruno, Carla, Dario, Elena, Fabio, Greta, Hugo, Irene, Jonas."
    chinese = "小明有十二个苹果，他给了小红三个，还剩几个？"
    items = [numbers, names, chinese, "Name the capital.", "Photosynthesis?"]
    docs = [f"Quiz. {x} Done." for x in items[:2]] + [f"今天我们学习数学。{chinese}请写下答案。", "First name the capital, then go on.", "Easy one. Photosynthesis? Sure."]
    docs[3:3] = ["they asked What is 3 plus 4 then"]
    items[3:3] = ["What is 3 plus 4?"]
    docs += ["The values are 4, 6, 9, 14, 22, 35, 56, 90, 145, 234, 378, 611. What is next?"]
    docs += ["The values are 9, 6, 9, 14, 22, 35, 56, 90, 145, 234, 378, 611, as we saw in the table of last week.", "It does photosynthesis in the sun. The capital has no name.", "今天天气很好，我们去公园散步。"]
    got = leaks(spark, docs, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 0)}
    assert got[0, 0] == got[1, 1] == got[2, 2] == got[3, 3] == 0 and got[6, 0] == 12


def test_decontamination_votes_within_an_occurrence(spark):
    item = "Buy 3 pens 5 caps 7 hats 9 cups"
    version = lambda i: f"Buy {i}1 pens {i}2 caps {i}3 hats {i}4 cups"
    sheet = " ".join(f"{version(i)} and then" for i in range(1, 9))
    longer = "A farmer sold 12 baskets of ripe apples to Anna for 30 euros and then bought 7 more baskets from the market in town."
    parted = "\n".join(longer.replace("12", f"1{i}0").replace("30", f"2{i}0").replace("7", f"3{i}0").replace("Anna", f"Mina{i}").replace("ripe", "ripe and quite red") for i in range(8))
    got = leaks(spark, [sheet, parted, f"{sheet} so. {item}.", "Buy 3 pens and caps or hats or 9 cups"], [item, longer])
    assert set(got) == {(0, 0), (1, 1), (2, 0)}
    assert got[0, 0] == 4 and got[2, 0] == 0


def test_defined_on_the_odd_rows_and_on_nothing(spark, docs, none, labels):
    for frame, n in ((docs, len(fixture_rows())), (none, 0)):
        assert mixing.mix(frame, mixing.quality_weights(labels)).count() == n
        assert quality_rules.apply_rules(frame, labels).count() == n
        assert sharding.assign(frame).count() == n
        assert classifier.classify(frame, labels.limit(0)).count() == n
        assert jaccard_join.join_components(frame).count() == n
        assert suffix_dedup.remove_repeats(frame).count() == n
    pages = none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert html_extract.extract(pages).count() == 0
    assert url_filters.filter_pages(pages, url_filters.rule_table(spark, q.URL_RULES)).count() == 0


def test_one_of_each_leaves_one_of_repeated_rows(spark):
    ship_package(spark)
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text.upper()), (None, text), (None, "other words"), (None, "other words"), (3, ""), (None, None), (4, "apart"), (4, "quite another")]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, text), (None, "other words"), (3, ""), (None, None), (4, "apart"), (4, "quite another")])


def test_pipeline_keeps_and_removes(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    table = q.table(spark, SF, "documents")
    ids = {r["doc_id"] for r in rows}
    assert ids and ids <= {r[0] for r in table.select("doc_id").collect()}
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(table, q.table(spark, SF, "benchmark")).collect()}
    assert not ids & leaked
    sets = brute_components([(r["doc_id"], r["text"]) for r in {r["doc_id"]: r for r in rows}.values()], 5, 80, 100)
    assert all(i == c for i, _, c in sets)
