"""Node embeddings from walks: vocabulary, noise distribution, subsampling, context pairs, and skip-gram training with
negative sampling (CBOW and hierarchical softmax optional), data-parallel with parameter averaging after every epoch."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from chronograph.functions.rand import uniform, uniform32
from chronograph.functions.tables import written
from chronograph.operators.ranking import ranked

SENTENCE_END = "</s>"
SENTENCE = 1000  # tokens that are trained together
MAX_VOCABULARY = 2_000_000  # rows of the two weight matrices that every executor holds


def vocabulary(tokens: DataFrame, sentences: int | None = None, min_count: int = 0) -> DataFrame:
    """(token, cn, vocab_idx): counts of (token) rows, pruned below ``min_count``, ranked by count descending, token
    ascending; the sentence end, if counted, has index 0."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("cn")).where(F.col("cn") >= min_count)
    if sentences is not None:
        end = tokens.sparkSession.createDataFrame([(SENTENCE_END, sentences)], "token string, cn long")
        counts = counts.where(F.col("token") != SENTENCE_END).union(end)
    end = F.col("token") == SENTENCE_END
    bucket = F.when(end, F.lit(-(1 << 62))).otherwise(-F.col("cn"))  # one for each count
    return ranked(counts, bucket, [F.col("token")], "vocab_idx").withColumn("vocab_idx", F.col("vocab_idx") - 1)


def noise(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """(token, p, cum): probability proportional to cn^0.75, and its running sum in index order."""
    x = vocab.withColumn("w", F.pow(F.col("cn").cast("double"), F.lit(power))).withColumn("b", F.floor(F.col("vocab_idx") / 65536))
    sums = x.groupBy("b").agg(F.sum("w").alias("s"))  # a row for each 65536 tokens
    sums = sums.select("b", (F.sum("s").over(W.orderBy("b")) - F.col("s")).alias("before"), F.sum("s").over(W.partitionBy()).alias("total"))
    running = F.col("before") + F.sum("w").over(W.partitionBy("b").orderBy("vocab_idx"))
    return x.join(sums, "b").select("token", "vocab_idx", (F.col("w") / F.col("total")).alias("p"), (running / F.col("total")).alias("cum"))


def keep_probability(vocab: DataFrame, sample: float = 1e-3) -> DataFrame:
    """(token, keep): the chance that an occurrence of a frequent token stays (may exceed 1)."""
    whole = F.broadcast(vocab.agg(F.sum("cn").alias("whole")))  # one row
    st = F.lit(sample) * F.col("whole")
    return vocab.join(whole).select("token", ((F.sqrt(F.col("cn") / st) + 1) * st / F.col("cn")).alias("keep"))


def subsampled(tokens: DataFrame, vocab: DataFrame, seed: int, sample: float = 1e-3) -> DataFrame:
    """The occurrences (walk, start, step, token) that stay, by hash-uniform."""
    x = tokens.join(keep_probability(vocab, sample), "token")
    return x.where(F.col("keep") >= uniform(seed, F.col("walk"), F.col("start"), F.col("step"))).drop("keep")


def context_pairs(tokens: DataFrame, window: int, seed: int, sentence: int = SENTENCE) -> DataFrame:
    """(walk, start, position, context, center): every centre's neighbours within its shrunken window (window - hash mod
    window) in the same walk, cut into stretches of ``sentence`` tokens. No pair of walks meets."""
    reach = F.lit(window) - F.pmod(uniform32(seed, F.col("walk"), F.col("start"), F.col("step")), F.lit(window))
    whole = tokens.withColumn("reach", reach).groupBy("walk", "start").agg(F.array_sort(F.collect_list(F.struct("step", "token", "reach"))).alias("s"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("s"), F.lit(sentence)), lambda i: F.slice("s", i, sentence))
    center = whole.select("walk", "start", F.explode(cuts).alias("s")).select("walk", "start", "s", F.posexplode("s").alias("i", "c"))
    near = F.expr("slice(s, cast(greatest(i - c.reach, 0) as int) + 1, cast(least(i + c.reach, size(s) - 1) - greatest(i - c.reach, 0) as int) + 1)")
    other = center.select("walk", "start", F.col("c.step").alias("position"), F.col("c.token").alias("center"), F.explode(near).alias("o"))
    return other.where("o.step <> position").select("walk", "start", "position", F.col("o.token").alias("context"), "center")


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A list of floats for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(rows, np.float32).ravel()))


@dataclass(frozen=True)
class SkipGram:
    """Hyper-parameters; input is the context word and target the centre word, index 0 is never drawn as noise."""

    dim: int = 128
    window: int = 10
    negative: int = 5
    epochs: int = 1
    alpha: float = 0.025
    sample: float = 1e-3
    seed: int = 1
    cbow: bool = False
    hierarchical: bool = False  # softmax over a binary tree of the vertices in place of noise
    partitions: int = 16  # copies that are trained and averaged: a parameter of the model, not of the cluster

    def fit(self, paths: DataFrame) -> DataFrame:
        """(node, emb) from (walk, start, path). Each epoch every part of the walks, dealt by a hash of (walk, start), trains
        its own copy in the order of (walk, start); copies are averaged over those that touched a vector, in the order of
        the parts, so the result depends on neither cluster nor retries. The rate falls with the share of tokens trained, down
        to a ten-thousandth. The driver holds two matrices whose size follows the vocabulary (at most MAX_VOCABULARY rows,
        checked) and never the corpus."""
        spark = paths.sparkSession
        counts = paths.select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("cn"))
        size = counts.count()
        if size > MAX_VOCABULARY:
            raise ValueError(f"{size} vertices exceed the bound of {MAX_VOCABULARY}")
        table = counts.orderBy(F.desc("cn"), "node").toArrow()
        nodes, cn = table.column("node").to_numpy(), table.column("cn").to_numpy().astype(np.float64)
        lookup = np.argsort(nodes)
        n, rng = len(nodes), np.random.default_rng(self.seed)
        syn0 = ((rng.random((n, self.dim)) - 0.5) / self.dim).astype(np.float32)
        syn1 = np.zeros((n, self.dim), np.float32)
        cum = np.cumsum(cn**0.75)
        cum /= cum[-1] if n else 1
        st = self.sample * cn.sum()
        keep = np.minimum(1.0, (np.sqrt(cn / st) + 1) * st / cn) if n and self.sample > 0 else np.ones(n)
        part = F.pmod(F.xxhash64("walk", "start"), F.lit(self.partitions)).cast("int").alias("part")
        tree = _tree(cn) if self.hierarchical else None
        walks = written(paths.select(part, "walk", "start", "path"), "walks")
        tokens = {r["part"]: r["n"] for r in walks.groupBy("part").agg(F.sum(F.size("path")).alias("n")).collect()}  # a row for each part
        model = self
        for epoch in range(self.epochs):
            shared = spark.sparkContext.broadcast((nodes[lookup], lookup, syn0, syn1, cum, keep, tree))

            def train(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
                ids, where, syn0, syn1, cum, keep, tree = shared.value
                number, a, b, touched, done = None, None, None, None, 0

                def copy() -> Iterator[pa.RecordBatch]:
                    at = np.flatnonzero(touched | b.any(axis=1)) if number is not None else ()
                    for i in range(0, len(at), 50_000):
                        k = at[i : i + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), number, np.int32)), pa.array(k), _lists(a[k]), _lists(b[k])], ["part", "i", "a", "b"])

                for batch in batches:
                    for part, walk, start, path in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                        if part != number:
                            yield from copy()
                            number, a, b, touched, done = part, syn0.copy(), syn1.copy(), np.zeros(len(ids), bool), 0
                        rng = np.random.default_rng([model.seed & 0xFFFFFFFF, epoch, walk & 0xFFFFFFFF, start & 0xFFFFFFFF, start >> 32 & 0xFFFFFFFF])
                        s = where[np.searchsorted(ids, path.values.to_numpy())]
                        for at in range(0, len(s), SENTENCE):
                            cut = s[at : at + SENTENCE]
                            cut = cut[rng.random(len(cut)) < keep[cut]]
                            if len(cut) > 1:
                                model._sentence(cut, a, b, cum, tree, rng, model.rate((epoch + done / max(1, tokens[number])) / model.epochs))
                                touched[cut] = True
                        done += len(s)
                yield from copy()

            dealt = walks.repartition(self.partitions, "part").sortWithinPartitions("part", "walk", "start")
            trained = dealt.mapInArrow(train, "part int, i long, a array<float>, b array<float>")
            summed = [F.array(*(F.aggregate(F.transform("rows", lambda r: r[c][k].cast("double")), F.lit(0.0), lambda s, v: s + v, lambda s: (s / F.size("rows")).cast("float")) for k in range(self.dim))).alias(c) for c in ("a", "b")]
            rows = F.array_sort(F.collect_list(F.struct("part", "a", "b"))).alias("rows")  # ``partitions`` at most
            averaged = trained.groupBy("i").agg(rows).select("i", *summed).toArrow()
            at = averaged.column("i").to_numpy()
            if len(at):
                syn0[at], syn1[at] = (averaged.column(c).combine_chunks().values.to_numpy().reshape(-1, self.dim) for c in ("a", "b"))
            shared.unpersist()
        return spark.createDataFrame(pa.table([pa.array(nodes, pa.int64()), _lists(syn0)], ["node", "emb"]))

    def rate(self, share: float) -> np.float32:
        """The learning rate after a share of all tokens of all epochs."""
        return np.float32(self.alpha * max(1e-4, 1 - share))

    def _sentence(self, s: np.ndarray, a: np.ndarray, b: np.ndarray, cum: np.ndarray, tree: tuple | None, rng: np.random.Generator, rate: np.float32) -> None:
        for i in range(len(s)):
            reach = self.window - int(rng.integers(self.window))
            near = np.concatenate([s[max(0, i - reach) : i], s[i + 1 : i + reach + 1]])
            if not len(near):
                continue
            if tree is not None:
                points, codes = (t[tree[2][s[i]] : tree[2][s[i] + 1]] for t in tree[:2])
                x = a[near].mean(axis=0, keepdims=True) if self.cbow else a[near]
                g = (1 - codes - 1 / (1 + np.exp(-np.clip(x @ b[points].T, -6, 6)))).astype(np.float32) * rate
                step = g @ b[points]
                b[points] += g.T @ x  # a path has no point twice
                np.add.at(a, near, np.repeat(step / len(near), len(near), axis=0) if self.cbow else step)
                continue
            noise = np.searchsorted(cum, rng.random((1 if self.cbow else len(near), self.negative)), "right").clip(0, len(cum) - 1)
            target = np.concatenate([np.full((len(noise), 1), s[i]), noise], axis=1)
            label = np.zeros(target.shape, np.float32)
            label[:, 0] = 1
            x = a[near].mean(axis=0, keepdims=True) if self.cbow else a[near]
            f = np.einsum("nd,nkd->nk", x, b[target])
            g = (label - 1 / (1 + np.exp(-np.clip(f, -6, 6)))) * rate
            g[:, 1:][noise == s[i]] = 0
            step = np.einsum("nk,nkd->nd", g, b[target])
            np.add.at(b, target.ravel(), (g[:, :, None] * x[:, None, :]).reshape(-1, self.dim))
            np.add.at(a, near, np.repeat(step / len(near), len(near), axis=0) if self.cbow else step)


def k_means(vectors: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(node, cluster) of (node, emb): clusters start at index mod k, centroids are unit means, a vector joins the
    centroid of largest dot product. ``k`` centroids are broadcast."""
    spark = vectors.sparkSession
    x = vectors.withColumn("cluster", F.pmod(F.col("node"), F.lit(k)).cast("int"))
    dim = len(vectors.select("emb").first()[0])
    for _ in range(rounds):
        means = x.groupBy("cluster").agg(F.array(*(F.avg(F.col("emb")[i]) for i in range(dim))).alias("m")).collect()
        centers = np.zeros((k, dim))
        for r in means:
            v = np.array(r["m"])
            centers[r["cluster"]] = v / max(1e-12, np.sqrt(v @ v))
        shared = spark.sparkContext.broadcast(centers)

        def join(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                e = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((e @ shared.value.T).argmax(axis=1).astype(np.int32))], ["node", "emb", "cluster"])

        x = vectors.select("node", "emb").mapInArrow(join, T.StructType([*vectors.select("node", "emb").schema.fields, T.StructField("cluster", T.IntegerType())]))
    return x.select("node", "cluster")


def _parents(counts: list[float]) -> tuple[list[int], list[int]]:
    """The parent (-1 for the root) and the side of each node of the binary tree of least weighted depth; leaves first."""
    heap = [(c, -i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, fresh = [-1] * max(0, 2 * len(counts) - 1), [0] * max(0, 2 * len(counts) - 1), len(counts)
    while len(heap) > 1:
        (c0, _, x), (c1, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y], side[y] = fresh, fresh, 1
        heapq.heappush(heap, (c0 + c1, fresh, fresh))
        fresh += 1
    return parent, side


def _tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inner nodes (numbered from 0) and sides on each leaf's path, and where each leaf's begin."""
    (parent, side), n = _parents(counts.tolist()), len(counts)
    points, codes, begin = [], [], [0]
    for i in range(n):
        at = i
        while parent[at] >= 0:
            points.append(parent[at] - n)
            codes.append(side[at])
            at = parent[at]
        begin.append(len(points))
    return np.array(points, np.int64), np.array(codes, np.float32), np.array(begin)


def huffman_codes(vocab: DataFrame) -> DataFrame:
    """(token, code): the binary tree of hierarchical softmax, made on the driver for a vocabulary of bounded size."""
    rows = vocab.orderBy("vocab_idx").select("token", "cn").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError("the vocabulary exceeds its bound")
    parent, side = _parents([r["cn"] for r in rows])
    out = []
    for i, r in enumerate(rows):
        code, at = "", i
        while parent[at] >= 0:
            code, at = str(side[at]) + code, parent[at]
        out.append((r["token"], code))
    return vocab.sparkSession.createDataFrame(out, "token string, code string")
