"""Walks, embeddings, networks and the stream, where a query's rows alone would not show what is asked."""

import heapq
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronograph import queries
from chronograph.operators import dataset, embedding, graph, metrics, models, walk
from chronograph.streaming import edges as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return queries.event_graph(spark, SF).persist()


def rows(df):
    return Counter((r["walk"], r["start"], r["step"], r["node"], round(r["ts"], 12)) for r in df.collect())


def test_long_walks_agree(spark, events):
    assert rows(walk.joined(events, 2, 15, 7)) == rows(walk.broadcast(events, 2, 15, 7))
    assert max(r[2] for r in rows(walk.broadcast(events, 2, 50, 7))) > 10


def test_a_hub_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(walk, "BLOCK", 8)
    e = spark.range(700).select(F.col("id").alias("eid"), (F.col("id") % 7 == 6).cast("long").alias("src"), (F.col("id") % 5).alias("dst"), (F.col("id") % 97 / 97).alias("ts"))
    both = walk.joined(e, 40, 4, 3), walk.broadcast(e, 40, 4, 3)
    assert rows(both[0]) == rows(both[1])
    assert walk.joined(e.limit(0), 3, 2, 1).count() == walk.broadcast(e.limit(0), 3, 2, 1).count() == 0


def test_draws_follow_the_weights(spark):
    """Later edges are drawn more often, by exp of the time over the vertex's span."""
    e = spark.createDataFrame([(i, 0, i, float(i)) for i in range(1, 5)], "eid long, src long, dst long, ts double")
    seen = Counter(r["node"] for r in walk.broadcast(e, 20_000, 1, 5).where("start = 0 and step = 1").collect())
    w = np.exp(np.arange(1, 5) / 3)
    for i in range(4):
        assert seen[i + 1] / 20_000 == pytest.approx(w[i] / w.sum(), abs=0.012)


def test_edges_beyond_the_bound_are_refused(events, monkeypatch):
    monkeypatch.setattr(walk, "BROADCAST_EDGES", 10)
    with pytest.raises(ValueError, match="bound"):
        walk.broadcast(events, 1, 1, 1)


def test_graphs_beyond_the_bound_are_broadcast_in_pieces(spark, events, monkeypatch):
    """Also where a vertex lies in many pieces, and where times repeat at a cut."""
    whole = rows(queries.QUERIES["walk_steps_broadcast"](spark, SF))
    hubs = spark.range(700).select(F.col("id").alias("eid"), (F.col("id") % 7 == 6).cast("long").alias("src"), (F.col("id") % 5).alias("dst"), (F.col("id") % 97 / 97).alias("ts"))
    known = rows(walk.broadcast(hubs, 40, 4, 3))
    monkeypatch.setattr(walk, "BROADCAST_EDGES", 150)
    assert rows(queries.QUERIES["walk_steps_broadcast"](spark, SF)) == whole
    assert rows(walk.broadcast_in_pieces(hubs, 40, 4, 3)) == known
    assert walk.broadcast_in_pieces(hubs.limit(0), 3, 2, 1).count() == 0


@pytest.mark.parametrize("cbow", [False, True])
def test_embeddings_do_not_depend_on_the_cluster(spark, events, cbow):
    paths = walk.paths(walk.broadcast(events, 4, 6, 3))
    model = embedding.SkipGram(dim=8, window=3, epochs=2, seed=3, partitions=3, cbow=cbow)
    first = {r["node"]: r["emb"] for r in model.fit(paths).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        again = {r["node"]: r["emb"] for r in model.fit(paths.repartition(11)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again and len(first) == paths.select(F.explode("path")).distinct().count()
    assert any(abs(x) > 0 for v in first.values() for x in v)


@pytest.mark.parametrize("hierarchical", [False, True])
def test_neighbours_get_like_vectors(spark, hierarchical):
    """Two groups of vertices that never meet in a walk end apart."""
    walks = [(k, 10 * g + s, [10 * g + (s + j * (k + 1)) % 5 for j in range(8)]) for g in (0, 1) for s in range(5) for k in range(40)]
    paths = spark.createDataFrame(walks, "walk int, start long, path array<long>")
    v = {r["node"]: np.array(r["emb"]) for r in embedding.SkipGram(dim=8, window=4, epochs=12, alpha=0.1, sample=0, partitions=1, hierarchical=hierarchical).fit(paths).collect()}
    cos = lambda a, b: v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b]))
    inside = np.mean([cos(a, b) for g in (0, 10) for a in range(g, g + 5) for b in range(g, g + 5) if a < b])
    across = np.mean([cos(a, b) for a in range(5) for b in range(10, 15)])
    assert inside > across + 0.3


def test_rate_falls_with_the_tokens():
    model = embedding.SkipGram(alpha=0.04)
    assert [round(float(model.rate(x)), 8) for x in (0.0, 0.25, 0.5, 1.0)] == [0.04, 0.03, 0.02, 4e-06]


def test_long_sentences_are_cut(spark):
    tokens = spark.range(25).select(F.lit(0).alias("walk"), F.lit(0).cast("long").alias("start"), F.col("id").cast("int").alias("step"), F.col("id").alias("token"))
    whole = embedding.context_pairs(tokens, 1, 1).collect()
    cut = embedding.context_pairs(tokens, 1, 1, sentence=10).collect()
    assert len(whole) == 48 and Counter(r["position"] for r in cut)[9] == 1 and len(cut) == 44


def test_huffman_codes_are_prefix_free_and_shortest(spark):
    counts = [40, 30, 12, 9, 5, 3, 1]
    vocab = spark.createDataFrame([(f"t{i}", c, i) for i, c in enumerate(counts)], "token string, cn long, vocab_idx long")
    codes = {r["token"]: r["code"] for r in embedding.huffman_codes(vocab).collect()}
    assert not [(a, b) for a in codes.values() for b in codes.values() if a != b and b.startswith(a)]
    heap, best = counts[:], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        best += s
        heapq.heappush(heap, s)
    assert sum(len(codes[f"t{i}"]) * c for i, c in enumerate(counts)) == best


def test_networks_learn_and_their_gradients_are_right():
    rng = np.random.default_rng(1)
    for kind, bias in (("link", True), ("node", True), ("node", False)):
        net = models.Network([3, 4, 1 if kind == "link" else 3], kind, bias=bias, seed=2)
        x = rng.normal(size=(6, 3))
        y = rng.integers(0, 2, 6).astype(float) if kind == "link" else rng.integers(0, 3, 6)
        _, gw, gb = net.gradients(x, y, None)
        for part, grads in ((net.weights, gw), (net.biases, gb) if bias else (net.weights, gw)):
            for w, g in zip(part, grads):
                at = tuple(0 for _ in w.shape)
                keep = w[at]
                w[at] = keep + 1e-6
                up = net.gradients(x, y, None)[0]
                w[at] = keep - 1e-6
                down = net.gradients(x, y, None)[0]
                w[at] = keep
                assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = models.Network([2, 16, 1], "link", seed=3)
    log = net.fit(x, y, 400, 0.5, 32, valid=(x, y), target=0.95)
    assert net.score(x, y) >= 0.95 and len(log) < 400 and log[-1]["valid_accuracy"] >= 0.95


def test_training_in_pieces_takes_every_row_once_an_epoch(spark, monkeypatch):
    monkeypatch.setattr(models, "PIECE", 300)
    x = spark.range(1000).select(F.col("id").alias("eid"), (F.col("id") % 2).cast("double").alias("label"), F.array(F.col("id").cast("float"), (F.col("id") * 2).cast("float")).alias("features"))
    runs = []
    for df in (x, x.repartition(5)):
        spool = models.Rows()
        for r in models.dealt(df, ["eid", "label"], 3).orderBy("piece", "hash", "key0").collect():
            spool.add(np.array([r["piece"]]), np.array([[*r["features"], r["label"]]], np.float32))
        rng = np.random.default_rng(1)
        runs.append([[(f.tolist(), y.tolist()) for f, y in spool.batches(rng, 64)] for _ in range(2)])
        assert max(len(spool.piece(k)) for k in range(10)) < 200
    assert runs[0] == runs[1] and runs[0][0] != runs[0][1]
    for epoch in runs[0]:
        assert [len(y) for _, y in epoch] == [64] * 15 + [40]
        assert sorted((*r, y) for f, ys in epoch for r, y in zip(f, ys)) == [(i, 2 * i, i % 2) for i in range(1000)]


def test_link_training_holds_no_whole_set(spark, monkeypatch):
    """Ten numbers may be held whole, and a piece has about a thousand."""
    whole = queries.QUERIES["link_prediction_accuracy"](spark, SF).first()[0]
    monkeypatch.setattr(models, "MAX_TRAIN", 10)
    monkeypatch.setattr(models, "PIECE", 1000)
    assert queries.QUERIES["link_prediction_accuracy"](spark, SF).first()[0] == pytest.approx(whole, abs=0.1)


def test_networks_in_pieces_learn(spark, monkeypatch):
    monkeypatch.setattr(models, "PIECE", 400)
    rng = np.random.default_rng(1)
    f = rng.normal(size=(400, 2))
    y = (f[:, 0] * f[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(f, y))], "eid long, label double, features array<float>")
    nets = []
    for x in (df, df.repartition(7)):
        net = models.Network([2, 16, 1], "link", seed=3)
        log = net.fit_dealt(models.dealt(x, ["eid"], 1), 400, 0.5, 32, check=lambda net=net: metrics.accuracy(models.predictions(df, net), "label").first()[0], target=0.95, check_every=100)
        assert net.score(f, y) >= 0.95 and len(log) < 400 and log[-1]["valid_accuracy"] >= 0.95
        nets.append(net)
    assert all((a == b).all() for a, b in zip(nets[0].weights, nets[1].weights))
    before = [w.copy() for w in net.weights]
    assert [r["loss"] for r in net.fit_dealt(models.dealt(df.limit(0), ["eid"], 1), 3, 0.5, 32)] == [0.0] * 3
    assert all((a == b).all() for a, b in zip(before, net.weights))


def test_features_without_a_vector_are_an_error(spark):
    v = spark.createDataFrame([(0, [1.0])], "node long, emb array<float>")
    with pytest.raises(Exception, match="no embedding"):
        dataset.edge_features(spark.createDataFrame([(0, 1)], "src long, dst long"), v).collect()


def test_lists_without_repeats(spark, events):
    out = dataset.listed_dataset(events, seed=4).collect()
    assert len(out) == len({(r["split"], r["label"], r["src"], r["dst"]) for r in out}) > 0
    known = {(r["src"], r["dst"]) for r in events.collect()}
    assert all(((r["src"], r["dst"]) in known) == (r["label"] == 1) for r in out)


def test_single_precision_sizes():
    assert dataset.split_sizes(10, 0.8)["test"] == 2 and dataset.split_sizes(10, 0.8, float32_compat=True)["test"] == 1
    assert sum(dataset.split_sizes(7, 0.8).values()) <= 7


def test_inclusive_times_and_auc_of_one_class(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.0), (1, 0, 1, 2.0)], "eid long, src long, dst long, ts double")
    assert graph.future_edges(e, 0, 1.0).count() == 1 and graph.future_edges(e, 0, 1.0, strict=False).count() == 2
    x = spark.createDataFrame([(0, [0.1, 0.9]), (0, [0.3, 0.2])], "y int, scores array<double>")
    assert all(r["auc"] is None for r in metrics.one_vs_rest_auc(x).collect())


def test_stream_of_edges(spark, tmp_path):
    rows = [(1, 2, "2024-01-01 00:05:00"), (1, 3, "2024-01-01 00:45:00"), (2, 3, "2024-01-01 01:05:00"), (1, 2, "2024-01-01 03:00:00")]
    x = spark.createDataFrame(rows, "src long, dst long, t string").select("src", "dst", F.col("t").cast("timestamp").alias("event_time"))
    x.write.parquet(str(tmp_path / "in"))
    run = stream.windowed_degrees(stream.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("degrees").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = Counter((r["src"], r["degree"], r["delta"], r["neighbors"]) for r in spark.table("degrees").collect())
    assert got == Counter([(1, 2, 2400.0, 2), (2, 1, 0.0, 1), (1, 1, 0.0, 1)])
