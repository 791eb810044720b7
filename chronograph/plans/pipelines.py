"""The pipelines end to end: link prediction, node classification, conversion and the walk benchmark."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronograph.operators import dataset, graph, metrics, models, walk
from chronograph.operators.embedding import SkipGram
from chronograph.operators.graph import TemporalGraph
from chronograph.plans.config import Params, arguments
from chronograph.sources import generators, graphs, sinks


class Timings(dict):
    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        yield
        self[name] = self.get(name, 0.0) + time.perf_counter() - began


def graph_of(spark: SparkSession, a) -> TemporalGraph:
    if a.file:
        edges = graphs.load(spark, a.file)
    elif a.kronecker:
        edges = graphs.with_weights(generators.rmat_edges(spark, a.kronecker, a.degree).withColumn("ts", F.lit(None).cast("double")))
    else:
        edges = graphs.with_weights(generators.uniform_edges(spark, a.uniform, a.degree).withColumn("ts", F.lit(None).cast("double")))
    return TemporalGraph.from_edges(edges, a.symmetrize, a.dedup)


def walks_of(edges: DataFrame, p: Params) -> DataFrame:
    """Broadcast arrays where the edges are few enough (their number is checked), joins beyond."""
    strategy = walk.broadcast if edges.count() <= walk.BROADCAST_EDGES else walk.joined
    return strategy(edges, p.num_walks_per_node, p.walk_length, p.seed)


def verified(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``steps``, or an error if a step is no edge of the graph or not later than the one before."""
    w = Window.partitionBy("walk", "start").orderBy("step")
    x = steps.withColumn("_from", F.lag("node").over(w)).withColumn("_ts", F.lag("ts").over(w)).where("step > 0")
    known = edges.select(F.col("src").alias("_from"), F.col("dst").alias("node"), F.col("ts").cast("double").alias("ts")).distinct()
    wrong = x.where("ts <= _ts").select("walk", "start", "step").union(x.join(known, ["_from", "node", "ts"], "left_anti").select("walk", "start", "step")).first()
    if wrong is not None:
        raise ValueError(f"walk {wrong['walk']} from {wrong['start']}: step {wrong['step']} is no later edge")
    return steps


def embed(edges: DataFrame, p: Params, epochs: int, timings: Timings, window: int = 10) -> DataFrame:
    with timings.stage("walk"):
        steps = walks_of(edges, p).persist()
        steps.count()
    with timings.stage("embedding"):
        out = SkipGram(dim=p.node_embedding_dim, window=window, epochs=epochs, seed=p.seed).fit(walk.paths(steps))
    steps.unpersist()
    return out


def link_prediction(edges: DataFrame, p: Params, train_only: bool = False, timings: Timings | None = None) -> DataFrame:
    """(label, p, predicted) of the test pairs. Walks use the whole graph unless ``train_only`` keeps test edges out."""
    timings = Timings() if timings is None else timings
    edges = edges.persist()
    with timings.stage("preprocessing"):
        data = dataset.link_dataset(edges, p.training_ratio, p.seed).persist()
        data.count()
    seen = edges.join(data.where("split = 'test' and label = 1").select("eid"), "eid", "left_anti") if train_only else edges
    vectors = embed(seen, p, 1, timings)
    filled = dataset.edge_features(data, vectors) if not train_only else dataset.edge_features(data.join(vectors.select(F.col("node").alias("src")), "src", "left_semi").join(vectors.select(F.col("node").alias("dst")), "dst", "left_semi"), vectors)
    filled = filled.select("split", "eid", F.col("label").cast("double").alias("label"), "features").persist()
    with timings.stage("training"):
        net = models.Network([2 * p.node_embedding_dim, p.hidden_dim, 1], "link", seed=p.seed)
        rows, valid = models.dealt(filled.where("split = 'train'"), ["eid", "label"], p.seed), filled.where("split = 'valid'")
        check = lambda: metrics.accuracy(models.predictions(valid, net), "label").first()[0]
        net.fit_dealt(rows, p.num_epochs, p.learning_rate, p.batch_size, check=check, target=p.target)
    with timings.stage("testing"):
        return models.predictions(filled.where("split = 'test'"), net).select("eid", F.col("label").cast("int").alias("y"), "p", "predicted")


def node_classification(edges: DataFrame, labels: DataFrame, p: Params, timings: Timings | None = None, bias: bool = False, adam: bool = True, relu_logits: bool = True, epochs: int = 10) -> DataFrame:
    """(node, y, predicted) of the test nodes; ``labels`` has node, label and split. Labels are dense-encoded over all
    splits."""
    timings = Timings() if timings is None else timings
    vectors = embed(edges, p, epochs, timings)
    known = [r[0] for r in labels.select("label").distinct().orderBy("label").limit(100_001).collect()]
    if len(known) > 100_000:
        raise ValueError("more than 100000 classes")
    code = F.array_position(F.array(*(F.lit(x) for x in known)), F.col("label")) - 1
    data = dataset.node_features(labels.withColumn("label", code.cast("int")), vectors).persist()
    with timings.stage("training"):
        net = models.Network([p.node_embedding_dim, p.hidden_dim_1, p.hidden_dim_2, max(1, len(known))], "node", bias=bias, dropout=0.1, relu_logits=relu_logits, seed=p.seed)
        x, y = models.matrices(data.where("split = 'train'"))
        net.fit(x, y, p.num_epochs, p.learning_rate, p.batch_size, adam=adam, valid=models.matrices(data.where("split = 'valid'")), target=p.target)
    with timings.stage("testing"):
        out = models.predictions(data.where("split = 'test'"), net)
    decode = F.array(*(F.lit(x) for x in known))
    return out.select("node", F.get(decode, F.col("label")).alias("y"), F.get(decode, F.col("predicted")).alias("predicted"))


def convert(graph: TemporalGraph, edges: str | None, binary: str | None, weighted: bool) -> str:
    if edges:
        sinks.write_edges(graph.edges, edges, weighted)
    if binary:
        sinks.write_graph(graph.edges, binary)
    return graph.describe()


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("chronograph").getOrCreate()
    p, t = Params.read(a.params) if a.params else Params(), Timings()
    g = graph_of(spark, a)
    print(g.describe())
    if a.verify:
        verified(walks_of(g.edges, p), g.edges)
        print("every step is a later edge")
    if a.analysis and a.command != "walk":
        for r in graph.top_k(g.out_degrees(), "degree", "node", 20).collect():
            print(r["node"], r["degree"])
    if a.command == "convert":
        convert(g, a.edges, a.binary, a.weighted)
    elif a.command == "walk":
        for k in range(a.trials):
            with t.stage(f"walk {k + 1}"):
                steps = walks_of(g.edges, p)
                steps = steps if a.node is None else steps.where(F.col("start") == a.node)
                steps.write.format("noop").mode("overwrite").save()
        if a.analysis:
            for r in walk.lengths(steps).groupBy("length").count().orderBy("length").collect():
                print(r["length"], r["count"])
        t["mean of a walk trial"] = sum(t.values()) / max(1, a.trials)
    elif a.command == "link":
        print(metrics.accuracy(link_prediction(g.edges, p, timings=t)).first()[0])
    else:
        parts = [graphs.read_labels(spark, f"{a.labels}/{s}.tsv").withColumn("split", F.lit(s)) for s in ("train", "valid", "test")]
        labels = parts[0].union(parts[1]).union(parts[2])
        print(metrics.accuracy(node_classification(g.edges, labels, p, timings=t)).first()[0])
    for name, seconds in t.items():
        print(f"{name}: {seconds:.3f} s")


if __name__ == "__main__":
    main()

