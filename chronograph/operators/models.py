"""Small neural classifiers, trained in NumPy in one task and scored everywhere.

Training is sequential by nature (mini-batch descent). A table of any size (:func:`dealt`) is trained on in a task that writes
its rows to a local file and reads them piece by piece; a set that fits on the driver is held whole, which a check enforces
(:func:`matrices`). Scoring needs only the weights and runs over any number of rows.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograph.functions.rand import uniform32
from chronograph.functions.tables import written

PIECE = 2_000_000  # numbers of a dealt training set that are held at once, 4 bytes each
MAX_TRAIN = 200_000_000  # numbers in the training set that the driver holds, 8 bytes each


@dataclass
class Network:
    """Layers of weights and optional biases. kind "link": ReLU layers and a sigmoid. kind "node": dropout before each
    layer, ReLU after every layer (the last too unless relu_logits is off), log-softmax."""

    sizes: list[int]
    kind: str = "link"
    bias: bool = True
    dropout: float = 0.0
    relu_logits: bool = True
    seed: int = 1
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            limit = 1 / np.sqrt(a)
            self.weights.append(rng.uniform(-limit, limit, (a, b)))
            self.biases.append(rng.uniform(-limit, limit, b) if self.bias else np.zeros(b))

    def _pass(self, x: np.ndarray, rng: np.random.Generator | None) -> tuple[list, list, list]:
        inputs, linear, masks = [], [], []
        last = len(self.weights) - 1
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            mask = np.ones_like(x)
            if rng is not None and self.dropout:
                mask = (rng.random(x.shape) >= self.dropout) / (1 - self.dropout)
            x = x * mask
            inputs.append(x)
            masks.append(mask)
            z = x @ w + b
            linear.append(z)
            x = np.maximum(z, 0) if k < last or self.kind == "node" and self.relu_logits else z
        linear.append(x)
        return inputs, linear, masks

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: of label 1 for links, of each class for nodes."""
        z = self._pass(np.asarray(x, np.float64), None)[1][-1]
        if self.kind == "link":
            return 1 / (1 + np.exp(-np.clip(z[:, 0], -40, 40)))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[float, list, list]:
        inputs, linear, masks = self._pass(x, rng)
        z, n = linear[-1], len(x)
        if self.kind == "link":
            p = 1 / (1 + np.exp(-np.clip(z[:, 0], -40, 40)))
            loss = -np.mean(y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12)))
            d = ((p - y) / n)[:, None]
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            loss = -np.mean(np.log(np.maximum(p[np.arange(n), y], 1e-12)))
            d = p.copy()
            d[np.arange(n), y] -= 1
            d /= n
            if self.relu_logits:
                d = d * (linear[-2] > 0)
        gw, gb = [], []
        for k in range(len(self.weights) - 1, -1, -1):
            gw.append(inputs[k].T @ d)
            gb.append(d.sum(axis=0))
            if k:
                d = (d @ self.weights[k].T) * masks[k] * (linear[k - 1] > 0)
        return float(loss), gw[::-1], gb[::-1]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float, batch: int, adam: bool = False, valid: tuple[np.ndarray, np.ndarray] | None = None, target: float = 1.0, check_every: int = 10) -> list[dict]:
        """Mini-batch descent; every ``check_every`` epochs validation accuracy is taken, and reaching ``target`` stops.
        Returns epoch, mean batch loss and validation accuracy (if taken)."""
        x, y, state, log = np.asarray(x, np.float64), np.asarray(y), self._state(), []
        for epoch in range(epochs):
            order = state["rng"].permutation(len(x))
            loss = self._epoch(((x[at], y[at]) for at in (order[i : i + batch] for i in range(0, len(x), batch))), rate, adam, state)
            row = {"epoch": epoch, "loss": loss, "valid_accuracy": None}
            if valid is not None and (epoch + 1) % check_every == 0 and len(valid[1]):
                row["valid_accuracy"] = self.score(*valid)
            log.append(row)
            if row["valid_accuracy"] is not None and row["valid_accuracy"] >= target:
                break
        return log

    def fit_dealt(self, rows: DataFrame, epochs: int, rate: float, batch: int, adam: bool = False, check: Callable[[], float | None] | None = None, target: float = 1.0, check_every: int = 10) -> list[dict]:
        """As :meth:`fit`, of a training set by :func:`dealt`; ``check`` gives the validation accuracy. One task trains for
        ``check_every`` epochs at a time; only weights and the state of the descent travel."""
        state, log = self._state(), []
        ordered = rows.coalesce(1).sortWithinPartitions(*rows.columns).select("piece", "label", "features")
        for first in range(0, epochs, check_every):
            count, given = min(check_every, epochs - first), pickle.dumps((self, state))

            def train(batches: Iterator[pa.RecordBatch], count=count, given=given) -> Iterator[pa.RecordBatch]:
                (net, state), spool = pickle.loads(given), Rows()
                for b in batches:
                    if b.num_rows:
                        f = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                        spool.add(b.column(0).to_numpy(), np.column_stack([f, b.column(1).to_numpy()]).astype(np.float32))
                losses = [net._epoch(spool.batches(state["rng"], batch), rate, adam, state) for _ in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.weights, net.biases, state, losses))])], ["state"])

            trained, losses = ordered.mapInArrow(train, "state binary").collect(), [0.0] * count
            if trained:  # no row of an empty table
                self.weights[:], self.biases[:], state, losses = pickle.loads(trained[0]["state"])
            log += [{"epoch": first + i, "loss": loss, "valid_accuracy": None} for i, loss in enumerate(losses)]
            if check is not None and count == check_every:
                log[-1]["valid_accuracy"] = check()
                if log[-1]["valid_accuracy"] is not None and log[-1]["valid_accuracy"] >= target:
                    break
        return log

    def _params(self) -> list[np.ndarray]:
        return self.weights + (self.biases if self.bias else [])

    def _state(self) -> dict:
        """Where a descent begins: random numbers, and Adam's moments and steps."""
        return {"rng": np.random.default_rng(self.seed), "m": [np.zeros_like(p) for p in self._params()], "v": [np.zeros_like(p) for p in self._params()], "t": 0}

    def _epoch(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float, adam: bool, state: dict) -> float:
        """The mean batch loss of one pass; weights and ``state`` move on."""
        params, m, v, losses = self._params(), state["m"], state["v"], []
        for x, y in batches:
            loss, gw, gb = self.gradients(x, y.astype(np.float64 if self.kind == "link" else np.int64), state["rng"])
            losses.append(loss)
            state["t"] += 1
            for k, g in enumerate(gw + (gb if self.bias else [])):
                if adam:
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    g = m[k] / (1 - 0.9 ** state["t"]) / (np.sqrt(v[k] / (1 - 0.999 ** state["t"])) + 1e-8)
                params[k] -= rate * g
        return float(np.mean(losses)) if losses else 0.0

    def score(self, x: np.ndarray, y: np.ndarray) -> float:
        p = self.predict(x)
        return float(np.mean((p > 0.5) == (np.asarray(y) > 0.5))) if self.kind == "link" else float(np.mean(p.argmax(axis=1) == y))


def matrices(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of a bounded training set, on the driver."""
    n, width = df.agg(F.count("*"), F.max(F.size("features"))).first()
    if n * (width or 0) > MAX_TRAIN:
        raise ValueError(f"{n} training rows of {width} numbers exceed {MAX_TRAIN}; sample first")
    rows = df.select("features", "label").toArrow()
    x = rows.column("features").combine_chunks()
    width = len(x.values) // max(1, rows.num_rows) if rows.num_rows else 0
    return np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64).reshape(rows.num_rows, width), rows.column("label").to_numpy()


class Rows:
    """Rows of features and a label (single precision) in a local file that goes with this object; pieces of it are read whole."""

    def __init__(self):
        self.width, self._file, self._pieces = 0, tempfile.TemporaryFile(), {}

    def add(self, pieces: np.ndarray, rows: np.ndarray) -> None:
        """Rows (the label last) and the number of the piece of each; the rows of a piece stay in order."""
        self.width, cuts = rows.shape[1], np.flatnonzero(np.diff(pieces)) + 1
        for number, part in zip(pieces[[0, *cuts]].tolist(), np.split(rows, cuts), strict=True):
            self._pieces.setdefault(number, []).append((self._file.seek(0, 2), part.nbytes))
            self._file.write(part.tobytes())

    def piece(self, number: int) -> np.ndarray:
        parts = []
        for at, size in self._pieces[number]:
            self._file.seek(at)
            parts.append(np.frombuffer(self._file.read(size), np.float32))
        return np.concatenate(parts).reshape(-1, self.width)

    def batches(self, rng: np.random.Generator, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every row once, the pieces in drawn order and the rows of each in drawn order; what a piece leaves short of a batch
        goes before the next."""
        left = np.zeros((0, self.width), np.float32)
        for k in rng.permutation(sorted(self._pieces)):
            x = self.piece(k)
            x = np.concatenate([left, x[rng.permutation(len(x))]])
            whole = len(x) // size * size
            for i in range(0, whole, size):
                yield x[i : i + size, :-1].astype(np.float64), x[i : i + size, -1]
            left = x[whole:].copy()
        if len(left):
            yield left[:, :-1].astype(np.float64), left[:, -1]


def dealt(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """(piece, hash, key, label, features) of a training set of any size, written: a hash of the key deals rows to pieces of
    about PIECE numbers and orders them there, so neither depends on partitions."""
    n, width = df.agg(F.count("*"), F.max(F.size("features"))).first()
    pieces = max(1, -(-n * ((width or 0) + 1) // PIECE))
    x = df.withColumn("hash", uniform32(seed, F.lit("row"), *(F.col(c) for c in key)))
    piece = F.floor(F.col("hash") * pieces / 2**32).cast("int").alias("piece")
    return written(x.select(piece, "hash", *(F.col(c).alias(f"key{i}") for i, c in enumerate(key)), F.col("label").cast("float").alias("label"), "features"), "training")


def predictions(df: DataFrame, net: Network) -> DataFrame:
    """``df`` with p (the probability of label 1, or of the chosen class) and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    at, names = df.columns.index("features"), [*df.columns, "p", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            p = shared.value.predict(x)
            chosen = (p > 0.5).astype(np.int32) if p.ndim == 1 else p.argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p if p.ndim == 1 else p.max(axis=1)), pa.array(chosen)], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def logistic(features: Column, weights: list[float], bias: float) -> Column:
    """A native score with fixed weights: the sigmoid of a dot product."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    dot = F.aggregate(F.zip_with(features, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-(dot + F.lit(float(bias)))))
