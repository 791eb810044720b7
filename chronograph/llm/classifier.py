"""Quality classifier: a support-vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Features are indicators of hashed words (case kept) and of hashed byte trigrams. Each is scaled by the log ratio of its
smoothed class counts, rows are scaled to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent. A logistic curve on a part of the sample that the fit does not see turns margins into probabilities.

The fit uses a bounded sample of labelled documents (``max_train`` per class, smallest id hashes first), so one task holds
a bounded matrix, of which the driver gets the model only; scoring reads every text whole, in vectorised batches, and needs no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograph.llm.storage import drop, materialize, unused
from chronograph.llm.text import column_bytes, hashed_words

WORD_BITS, GRAM_BITS = 17, 16
DIM = (1 << WORD_BITS) + (1 << GRAM_BITS)
MAX_TRAIN = 6000  # labelled documents of each class that a fit uses
MAX_BYTES = 128 << 20  # of their features, 4 each


def _gram_pairs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hashed byte trigram) pairs; blocks of rows share one bitmap."""
    rows, feats = [], []
    side = 1 << GRAM_BITS
    for i in range(0, len(off) - 1, 128):
        j = min(len(off) - 1, i + 128)
        seen = np.zeros((j - i) * side, bool)
        at = int(off[i])
        while at < off[j]:
            end = min(int(off[j]), at + (1 << 20))
            b = buf[at : min(int(off[j]), end + 2)].astype(np.uint32)
            if len(b) >= 3:
                h = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) >> np.uint32(32 - GRAM_BITS)
                pos = np.arange(at, at + len(h))
                row = np.searchsorted(off[i : j + 1], pos, "right") - 1
                inside = pos + 2 < off[i + 1 + row]
                seen[row[inside] * side + h[inside]] = True
            at = end
        k = np.flatnonzero(seen)
        rows.append(k // side + i)
        feats.append(k % side + (1 << WORD_BITS))
    return (np.concatenate(rows), np.concatenate(feats)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: (first row, end row, row of each feature minus the first, feature), sorted by row."""
    buf, off = column_bytes(column)
    for i, j, h, row in hashed_words(column, fold=False):
        pair = np.unique((row << WORD_BITS) | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64))
        r2, f2 = _gram_pairs(buf, off[i : j + 1])
        r = np.concatenate([pair >> WORD_BITS, r2])
        f = np.concatenate([pair & ((1 << WORD_BITS) - 1), f2])
        order = np.argsort(r, kind="stable")
        yield i, j, r[order], f[order]


@dataclass
class Model:
    """weights already hold the log-count ratios; scale is their square, for the rows' lengths."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: int, r: np.ndarray, f: np.ndarray) -> np.ndarray:
        dot = np.bincount(r, self.weights[f], rows)
        length = np.sqrt(np.bincount(r, self.ratio[f].astype(np.float64) ** 2, rows))
        return dot / np.maximum(length, 1e-12) + self.bias

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def fit(sets: list[np.ndarray], y: np.ndarray, prior: float, seed: int = 1, c: float = 1.0, epochs: int = 12) -> Model:
    """Fit on feature sets and labels (0 or 1); ``prior`` is the share of label 1 among all labelled rows.

    With one class only, or no rows, every score is the prior."""
    n = len(sets)
    rng = np.random.default_rng(seed)
    if n == 0 or y.min() == y.max():
        p = np.clip(prior, 1e-6, 1 - 1e-6)
        return Model(np.zeros(DIM, np.float32), np.zeros(DIM), 0.0, 1.0, float(np.log(p / (1 - p))))
    order = rng.permutation(n)
    held, used = order[: n // 5], order[n // 5 :]
    if len(np.unique(y[used])) < 2 or len(np.unique(y[held])) < 2:
        held = used = order
    counts = np.ones((2, DIM))
    for i in used:
        counts[int(y[i]), sets[i]] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0]).astype(np.float32)
    w, bias = np.zeros(DIM), 0.0
    length = {i: max(1e-12, np.sqrt((v := ratio[sets[i]].astype(np.float64)) @ v)) for i in used}
    alpha, sign = np.zeros(n), np.where(y == 1, 1.0, -1.0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(used):
            at = sets[i]
            x = ratio[at].astype(np.float64) / length[i]
            g = sign[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - g / 2, 0.0), c)  # rows have length 1, and the constant adds 1
            if (d := new - alpha[i]) != 0:
                alpha[i] = new
                w[at] += d * sign[i] * x
                bias += d * sign[i]
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    model = Model(ratio, w * ratio, bias, 1.0, 0.0)
    m = np.array([model.margins(1, np.zeros(len(sets[i]), np.int64), sets[i])[0] for i in held])
    t = y[held].astype(float)
    weight = np.where(t == 1, prior / max(t.mean(), 1e-9), (1 - prior) / max(1 - t.mean(), 1e-9))
    a, b = 1.0, 0.0
    target = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g0, g1 = (weight * (p - target) * m).sum() + 1e-3 * a, (weight * (p - target)).sum()
        s = weight * p * (1 - p)
        h00, h01, h11 = (s * m * m).sum() + 1e-3, (s * m).sum(), s.sum() + 1e-6
        det = h00 * h11 - h01 * h01
        a, b = a - (h11 * g0 - h01 * g1) / det, b - (h00 * g1 - h01 * g0) / det
    model.slope, model.shift = float(a), float(b)
    return model


def held_out(doc_id: str = "doc_id"):
    """The fifth of the ids that training never sees; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on at most ``max_train`` labelled documents of each class that are not held out, and of each class at most as
    many as have half of ``max_bytes`` of features together.

    An id with several labels counts as 1 if their mean is 0.5 or more; null labels and ids are passed over; of documents
    that share an id one is used."""
    marked = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    share = marked.agg(F.avg("y")).first()[0]
    ids = None
    for value in (0, 1):
        part = marked.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        ids = part if ids is None else ids.union(part)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # 2 * max_train rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, r, f in features(batch.column(1)):
                cut = np.searchsorted(r, np.arange(j - i + 1))
                out += [f[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "f"])

    sets = chosen.select("doc_id", "text", "y").mapInArrow(extract, "doc_id long, y int, f binary")
    sets = materialize(sets.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("f").alias("f")).coalesce(16), "features")  # 2 * max_train rows at most
    sizes = sets.select("doc_id", "y", F.octet_length("f").alias("bytes"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    room, used = {0: max_bytes // 2, 1: max_bytes // 2}, []
    for r in sizes:  # in order of the id's hash, as the rows were chosen
        room[r["y"]] -= r["bytes"]
        if room[r["y"]] >= 0:
            used.append((r["doc_id"],))
    kept = docs.sparkSession.createDataFrame(used, "doc_id long")
    prior = 0.5 if share is None else float(share)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
        rows.sort(key=lambda r: r[0])
        model = fit([np.frombuffer(f.as_buffer(), np.int32) for _, _, f in rows], np.array([y for _, y, _ in rows], np.int64), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    chosen = sets.join(F.broadcast(kept), "doc_id").select("doc_id", "y", "f").coalesce(1)  # max_bytes at most
    models = chosen.mapInArrow(learn, "model binary").collect()
    drop(sets)
    return pickle.loads(models[0]["model"]) if models else fit([], np.zeros(0, np.int64), prior)


def score(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """``docs`` with a last column ``name``: the probability of label 1, from the text alone. Null and empty texts get the
    score of no features; all other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights, whatever the corpus
    where, names = docs.columns.index("text"), [*docs.columns, name]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.probabilities(m.margins(j - i, r, f)) for i, j, r, f in features(batch.column(where))]
            scores = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names)

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row of ``docs`` (doc_id, text)."""
    base = docs.select("doc_id", "text")
    scored = score(base, train(base, labels, max_train))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; rows with equal texts fare alike, null and
    empty texts by the score of no features, and an empty table gives no rows."""
    (name,) = unused(docs.columns, "_score")
    return score(docs, train(docs, labels, max_train), name).where(F.col(name) >= threshold).drop(name)
