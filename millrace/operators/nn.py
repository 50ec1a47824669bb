"""A small feed-forward network: one optional hidden layer of rectifiers.

Weights live on the driver. Batches follow a hash order of the rows, anew in
every epoch. Steps depend on each other, so small batches are taken in order, a
chunk of at least ``CHUNK_ROWS`` rows in one task; a chunk is a folder of its own and a job
reads that alone. A batch as large as a chunk is spread instead: each partition
sums its gradients in numpy and the partial sums meet on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vec
from millrace.operators import metrics
from millrace.operators.validate import positive_int
from millrace.plans.lineage import cut, drop
from millrace.plans.ranks import hash_key, positions
from millrace.plans.sums import matrix, vector_sum


CHUNK_ROWS = 65_536


def forward(w: dict[str, np.ndarray], x: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(output, hidden pre-activation, last input)."""
    z, h = None, x
    if "W1" in w:
        z = x @ w["W1"] + w["b1"]
        h = np.maximum(z, 0)
    out = h @ w["W2"] + w["b2"]
    if task == "classification":
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out /= out.sum(axis=1, keepdims=True)
    return out, z, h


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, task: str) -> tuple[dict[str, np.ndarray], float]:
    """Sums over rows of the loss gradients and of the losses."""
    out, z, h = forward(w, x, task)
    if task == "classification":
        i = y.astype(int)
        loss = -np.log(np.clip(out[np.arange(len(i)), i], 1e-12, 1)).sum()
        d = out.copy()
        d[np.arange(len(i)), i] -= 1
    else:
        d = out - y[:, None]
        loss = 0.5 * (d**2).sum()
    g = {"W2": h.T @ d, "b2": d.sum(axis=0)}
    if "W1" in w:
        back = (d @ w["W2"].T) * (z > 0)
        g |= {"W1": x.T @ back, "b1": back.sum(axis=0)}
    return g, float(loss)


@dataclass(frozen=True)
class NeuralNetwork:
    n_inputs: int
    hidden_size: int | None = None
    task: str = "classification"
    n_classes: int | None = None
    learning_rate: float = 0.01
    batch_size: int = 32
    max_epochs: int = 10
    shuffle: bool = True
    seed: int = 0
    features: str = "features"
    label: str = "label"
    row_id: str = "row_id"

    def __post_init__(self):
        positive_int("n_inputs", self.n_inputs)
        positive_int("batch_size", self.batch_size)
        if self.task not in ("classification", "regression"):
            raise ValueError(f"unknown task {self.task!r}")
        if self.task == "classification" and (self.n_classes is None or self.n_classes < 2):
            raise ValueError("n_classes must be at least 2")

    def initial(self) -> NetworkModel:
        """Normal weights with deviation sqrt(2 / inputs) below rectifiers and
        sqrt(1 / inputs) elsewhere; zero biases."""
        rng, outs = np.random.default_rng(self.seed), self.n_classes if self.task == "classification" else 1
        w, last = {}, self.n_inputs
        if self.hidden_size:
            w = {"W1": rng.normal(0, np.sqrt(2 / last), (last, self.hidden_size)), "b1": np.zeros(self.hidden_size)}
            last = self.hidden_size
        return NetworkModel(self, w | {"W2": rng.normal(0, np.sqrt(1 / last), (last, outs)), "b2": np.zeros(outs)}, [])

    def fit(self, df: DataFrame, start: NetworkModel | None = None, order: Callable[[int], Column] | None = None) -> NetworkModel:
        """Trains from ``start`` (a warm start) or from initial weights. An
        epoch's loss is the plain mean over its batches. ``order`` may replace
        the hash by which an epoch (from 0) sorts its rows; it sees the row id as i."""
        model = start or self.initial()
        w, losses, names = {k: v.copy() for k, v in model.weights.items()}, list(model.losses), sorted(model.weights)
        rows = df.select(F.col(self.row_id).alias("i"), F.col(self.features).cast("array<double>").alias("x"), F.col(self.label).cast("double").alias("y")).persist()
        n = rows.count()
        batches = -(-n // self.batch_size)
        per = max(1, CHUNK_ROWS // self.batch_size)  # batches in a chunk
        for epoch in range(self.max_epochs if n else 0):
            if batches == 1:
                chunks = [rows]
            else:
                key = order(epoch) if order else hash_key(self.seed + epoch, "i") if self.shuffle else F.col("i")
                dealt = positions(rows, key, F.col("i"), name="p").select("p", "x", "y", F.floor(F.col("p") / (self.batch_size * per)).alias("chunk"))
                dealt = cut(dealt, "chunk")
                chunks = [dealt.where(F.col("chunk") == c) for c in range(-(-batches // per))]
            total = 0.0
            for chunk in chunks:
                if self.batch_size >= CHUNK_ROWS:
                    got = vector_sum(chunk.select("x", "y"), _gradient_sums(w, names, self.task))
                    total += got[1] / got[0]
                    w = _step(w, names, got[2:] / got[0], self.learning_rate)
                else:
                    ordered = chunk.select("p", "x", "y") if batches > 1 else chunk.select(F.col("i").alias("p"), "x", "y")
                    r = ordered.repartition(1).sortWithinPartitions("p").select("x", "y").mapInArrow(_sequence(w, names, self.task, self.batch_size, self.learning_rate), "loss double, w array<double>").first()
                    total += r["loss"]
                    w = _unpack(np.array(r["w"]), w, names)
            if batches > 1:
                drop(dealt)
            losses.append(float(total / batches))
        rows.unpersist()
        return NetworkModel(self, w, losses)


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray], names: list[str]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[k].size for k in names])[:-1]
    return {k: v.reshape(like[k].shape) for k, v in zip(names, np.split(flat, cuts))}


def _step(w: dict[str, np.ndarray], names: list[str], mean: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    g = _unpack(mean, w, names)
    return {k: w[k] - rate * g[k] for k in w}


def _gradient_sums(w: dict[str, np.ndarray], names: list[str], task: str):
    """Rows, losses and gradients of a part of a batch, summed."""

    def step(b: pa.RecordBatch) -> np.ndarray:
        g, loss = gradients(w, matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False), task)
        return np.concatenate(([b.num_rows, loss], *(g[k].ravel() for k in names)))

    return step


def _sequence(w: dict[str, np.ndarray], names: list[str], task: str, size: int, rate: float):
    """Ordered rows -> the sum of the batches' mean losses and the weights after them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, x, y = w, 0.0, None, None

        def take(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal now, total
            g, loss = gradients(now, x, y, task)
            total += loss / len(y)
            now = {k: now[k] - rate * g[k] / len(y) for k in now}

        for b in parts:
            if not b.num_rows:
                continue
            xs, ys = matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False)
            x, y = (xs, ys) if x is None else (np.concatenate((x, xs)), np.concatenate((y, ys)))
            full = len(y) // size * size
            for i in range(0, full, size):
                take(x[i : i + size], y[i : i + size])
            x, y = x[full:], y[full:]
        if x is not None and len(y):
            take(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([float(total)]), pa.array([np.concatenate([now[k].ravel() for k in names])], pa.list_(pa.float64()))], names=["loss", "w"])

    return run


WIDE = 4096  #: weights beyond which plans hold no literals of them


def _outputs(w: dict[str, np.ndarray], task: str):
    return F.pandas_udf(lambda x: pd.Series(list(forward(w, np.stack(x.to_numpy()), task)[0])), "array<double>")


@dataclass(frozen=True)
class NetworkModel:
    params: NeuralNetwork
    weights: dict[str, np.ndarray]
    losses: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds output (probabilities, or one value) and prediction: column
        expressions over the weights, or matrix products of Arrow batches for
        more than ``WIDE`` weights."""
        x, d = F.col(self.params.features).cast("array<double>"), self.params.n_inputs
        if sum(v.size for v in self.weights.values()) > WIDE:
            out = df.withColumn("output", _outputs(self.weights, self.params.task)(x))
            return out.withColumn("prediction", vec.argmax(F.col("output")) if self.params.task == "classification" else F.col("output")[0])
        out = df.withColumn("__h", x)
        layer = lambda w, b, src, n: F.array(*(vec.dot(F.col(src), w[:, j].tolist(), n) + float(b[j]) for j in range(w.shape[1])))
        w, n = self.weights, d
        if "W1" in w:
            out = out.withColumn("__h", F.transform(layer(w["W1"], w["b1"], "__h", n), vec.relu))
            n = w["W1"].shape[1]
        out = out.withColumn("output", layer(w["W2"], w["b2"], "__h", n)).drop("__h")
        if self.params.task == "classification":
            out = out.withColumn("output", vec.softmax(F.col("output")))
            return out.withColumn("prediction", vec.argmax(F.col("output")))
        return out.withColumn("prediction", F.col("output")[0])

    def score(self, df: DataFrame) -> float:
        """Accuracy, or minus the mean squared error."""
        t = self.transform(df)
        if self.params.task == "classification":
            return t.agg(metrics.accuracy(self.params.label, "prediction")).first()[0]
        return -t.agg(metrics.mean_squared_error(self.params.label, "prediction")).first()[0]
