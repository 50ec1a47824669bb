"""Linear models trained by gradient steps.

Full-batch training is one aggregate per epoch. Row-by-row training depends on
row order: rows are dealt by their order into chunks of ``FOLD_ROWS``, each a
folder of its own, and a job for each folds its rows into the weights that the
job before it left. A lost executor costs the job that it was in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vec
from millrace.operators import metrics
from millrace.operators.validate import check_numeric
from millrace.plans.lineage import cut, drop
from millrace.plans.ranks import positions
from millrace.plans.sums import matrix, vector_sum

FOLD_ROWS = 65_536  #: rows that are in one task, and in one value, at a time


def binary_labels(df: DataFrame, label: str) -> list:
    """The two sorted labels; ValueError unless there are exactly two."""
    got = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(3).collect()]
    if len(got) != 2:
        raise ValueError("exactly two labels are needed")
    return got


def _score(w: list[float], b: float, x: Column) -> Column:
    """w.x + b with the weights as one array literal: the plan keeps its shape."""
    arr = F.array(*(F.lit(float(v)) for v in w))
    return F.aggregate(F.zip_with(x, arr, lambda a, c: a * c), F.lit(float(b)), lambda s, v: s + v)


def _logistic_sums(w: np.ndarray):
    """Rows, losses and gradients (bias last) of a batch, summed."""

    def step(b) -> np.ndarray:
        x, t = matrix(b.column("x")), b.column("t").to_numpy(zero_copy_only=False)
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -700, 700)))
        loss = -(t * np.log(p + 1e-12) + (1 - t) * np.log(1 - p + 1e-12)).sum()
        return np.concatenate(([len(t), loss], (p - t) @ x, [(p - t).sum()]))

    return step


@dataclass(frozen=True)
class LogisticRegression:
    """Gradient descent on the mean cross-entropy, exactly ``epochs`` steps."""

    learning_rate: float = 0.01
    epochs: int = 100
    features: str = "x"
    label: str = "y"
    seed: int | None = None
    initial_weights: list[float] | None = None

    def fit(self, df: DataFrame) -> LogisticModel:
        labels = binary_labels(df, self.label)
        d = vec.width(df, self.features)
        rows = df.select(F.col(self.features).cast("array<double>").alias("x"), (F.col(self.label) == F.lit(labels[1])).cast("double").alias("t")).where("t is not null").persist()
        w = list(self.initial_weights) if self.initial_weights is not None else np.random.default_rng(self.seed).normal(0, 1e-3, d + 1).tolist()
        losses = []
        for _ in range(self.epochs):
            if d > vec.UNROLL:
                got = vector_sum(rows, _logistic_sums(np.array(w)))
                losses.append(float(got[1] / got[0]))
                w = (np.array(w) - self.learning_rate * got[2:] / got[0]).tolist()
                continue
            p = rows.select("x", "t", vec.sigmoid(_score(w[:-1], w[-1], F.col("x"))).alias("p"))
            e = F.col("p") - F.col("t")
            g = p.agg(metrics.binary_cross_entropy("t", "p").alias("loss"), F.avg(e).alias("b"), *(F.avg(e * F.col("x")[i]).alias(f"g{i}") for i in range(d))).first()
            losses.append(g["loss"])
            w = [a - self.learning_rate * b for a, b in zip(w, [*(g[f"g{i}"] for i in range(d)), g["b"]])]
        rows.unpersist()
        return LogisticModel(self, w[:-1], w[-1], labels, losses)


@dataclass(frozen=True)
class LogisticModel:
    params: LogisticRegression
    w: list[float]
    b: float
    labels: list
    losses: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Adds margin, probability and prediction; a probability at the threshold is positive."""
        z = _score(self.w, self.b, F.col(self.params.features).cast("array<double>"))
        out = df.withColumn("margin", z).withColumn("probability", vec.sigmoid(F.col("margin")))
        return out.withColumn("prediction", F.when(F.col("probability") >= threshold, F.lit(self.labels[1])).otherwise(F.lit(self.labels[0])))

    def loss(self, df: DataFrame) -> float:
        """Mean cross-entropy; ValueError for a label that was not fitted."""
        y = F.col(self.params.label)
        if df.where(~y.isin(self.labels)).limit(1).count():
            raise ValueError("unseen label")
        t = self.transform(df).withColumn("__t", (y == F.lit(self.labels[1])).cast("double"))
        return t.agg(metrics.binary_cross_entropy("__t", "probability")).first()[0]

    def score(self, df: DataFrame) -> float:
        return self.transform(df).agg(metrics.accuracy(self.params.label, "prediction")).first()[0]


def _chunks(df: DataFrame, row_id: str, x: Column, t: Column) -> tuple[list[DataFrame], Callable[[], None], int]:
    """Rows (i, x, t) in chunks by their order, what frees them, and their number."""
    rows = df.select(F.col(row_id).alias("i"), x.alias("x"), t.alias("t"))
    n = rows.count()
    if n <= FOLD_ROWS:
        return [rows], lambda: None, n
    placed = positions(rows, F.col("i"), name="p").select(F.col("p").alias("i"), "x", "t", F.floor(F.col("p") / FOLD_ROWS).alias("chunk"))
    dealt = cut(placed, "chunk")
    return [dealt.where(F.col("chunk") == c).drop("chunk") for c in range(-(-n // FOLD_ROWS))], lambda: drop(dealt), n


def _passes(df: DataFrame, row_id: str, x: Column, t: Column, init: list[float], epochs: int, fold: Callable[[DataFrame, list[float]], tuple[list[float], float]]) -> tuple[list[float], list[float]]:
    """Weights after ``epochs`` passes in row order, and the mean of the errors of
    each pass. ``fold`` takes a chunk and the weights before it, and gives the
    weights after it and the sum of its rows' errors."""
    if epochs < 1:
        return list(init), []
    chunks, free, n = _chunks(df, row_id, x, t)
    w, errors = list(init), []
    for _ in range(epochs):
        total = 0.0
        for chunk in chunks:
            w, e = fold(chunk, w)
            total += e
        errors.append(total / max(n, 1))
    free()
    return w, errors


def ordered_fold(df: DataFrame, row_id: str, x: Column, t: Column, init: list[float], epochs: int, step: Callable[[Column, Column, Column], tuple[Column, Column]]) -> tuple[list[float], list[float]]:
    """A fold of column expressions: ``step(w, x, t)`` gives the next weights and a row's error."""

    def one(s: Column, r: Column) -> Column:
        w, e = step(s["w"], r["x"], r["t"])
        return F.struct(w.alias("w"), (s["e"] + e).alias("e"))

    def fold(chunk: DataFrame, w: list[float]) -> tuple[list[float], float]:
        rows = chunk.agg(F.sort_array(F.collect_list(F.struct("i", "x", "t"))).alias("rows"))
        start = F.struct(F.array(*(F.lit(float(v)) for v in w)).alias("w"), F.lit(0.0).alias("e"))
        r = rows.select(F.aggregate("rows", start, one).alias("s")).first()["s"]
        return list(r["w"]), r["e"]

    return _passes(df, row_id, x, t, init, epochs, fold)


def plain_fold(df: DataFrame, row_id: str, x: Column, t: Column, init: list[float], epochs: int, alpha: float, activation: Callable) -> tuple[list[float], list[float]]:
    """``ordered_fold`` of a neuron whose activation is a function of numbers:
    the rows of a chunk pass in order through one task, in Python."""

    def fold(chunk: DataFrame, start: list[float]) -> tuple[list[float], float]:
        def run(batches):
            w, total = np.array(start, float), 0.0
            for b in batches:
                for v, y in zip(matrix(b.column("x")) if b.num_rows else (), b.column("t").to_numpy(zero_copy_only=False)):
                    e = float(activation(float(v @ w[:-1] + w[-1]))) - y
                    w[:-1] -= alpha * e * v
                    w[-1] -= alpha * e
                    total += 0.5 * e * e
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([total])], names=["w", "e"])

        r = chunk.repartition(1).sortWithinPartitions("i").select("x", "t").mapInArrow(run, "w array<double>, e double").first()
        return list(r["w"]), r["e"]

    return _passes(df, row_id, x, t, init, epochs, fold)


def _margin(w: Column, x: Column, d: int) -> Column:
    """w holds the bias last."""
    return vec.total([w[i] * x[i] for i in range(d)]) + w[d]


def _move(w: Column, x: Column, by: Column, d: int) -> Column:
    return F.array(*(w[i] - by * x[i] for i in range(d)), w[d] - by)


def _of_columns(f: Callable) -> bool:
    try:
        return isinstance(f(F.lit(0.0)), Column)
    except Exception:  # made for numbers
        return False


@dataclass(frozen=True)
class Perceptron:
    """Rosenblatt updates in row order; a margin of 0 updates."""

    learning_rate: float = 1.0
    iterations: int = 50
    features: str = "x"
    label: str = "y"
    row_id: str = "row_id"
    seed: int | None = None
    initial_weights: list[float] | None = None

    def fit(self, df: DataFrame) -> PerceptronModel:
        labels = binary_labels(df, self.label)
        d = vec.width(df, self.features)
        w = self.initial_weights if self.initial_weights is not None else np.random.default_rng(self.seed).normal(0, 1e-6, d + 1).tolist()

        def step(w: Column, x: Column, t: Column) -> tuple[Column, Column]:
            wrong = t * _margin(w, x, d) <= 0
            return F.when(wrong, _move(w, x, -self.learning_rate * t, d)).otherwise(w), wrong.cast("double")

        t = F.when(F.col(self.label) == F.lit(labels[1]), 1.0).otherwise(-1.0)
        w, errors = ordered_fold(df, self.row_id, F.col(self.features).cast("array<double>"), t, w, self.iterations, step)
        return PerceptronModel(self, w[:-1], w[-1], labels, errors)


@dataclass(frozen=True)
class PerceptronModel:
    params: Perceptron
    w: list[float]
    b: float
    labels: list
    errors: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds margin and prediction; a margin of 0 is the larger label."""
        out = df.withColumn("margin", _score(self.w, self.b, F.col(self.params.features).cast("array<double>")))
        return out.withColumn("prediction", F.when(F.col("margin") >= 0, F.lit(self.labels[1])).otherwise(F.lit(self.labels[0])))

    def score(self, df: DataFrame) -> float:
        return self.transform(df).agg(metrics.accuracy(self.params.label, "prediction")).first()[0]

    def loss(self, df: DataFrame) -> float:
        """Number of mistakes."""
        return self.transform(df).agg(metrics.mistakes(self.params.label, "prediction")).first()[0]


@dataclass(frozen=True)
class SingleNeuron:
    """One neuron by per-row steps w -= alpha * e * x, whatever the activation's
    slope. The activation is a function of a column or of a number."""

    alpha: float = 0.01
    epochs: int = 100
    activation: Callable = lambda z: z
    features: str = "x"
    target: str = "y"
    row_id: str = "row_id"
    seed: int | None = None
    initial_weights: list[float] | None = None

    def fit(self, df: DataFrame) -> NeuronModel:
        check_numeric(df, self.target)
        d = vec.width(df, self.features)
        w = self.initial_weights if self.initial_weights is not None else np.random.default_rng(self.seed).normal(size=d + 1).tolist()

        def step(w: Column, x: Column, t: Column) -> tuple[Column, Column]:
            e = self.activation(_margin(w, x, d)) - t
            return _move(w, x, self.alpha * e, d), 0.5 * e * e

        x, t = F.col(self.features).cast("array<double>"), F.col(self.target).cast("double")
        if _of_columns(self.activation):
            w, errors = ordered_fold(df, self.row_id, x, t, w, self.epochs, step)
        else:
            w, errors = plain_fold(df, self.row_id, x, t, w, self.epochs, self.alpha, self.activation)
        return NeuronModel(self, w[:-1], w[-1], errors)


@dataclass(frozen=True)
class NeuronModel:
    params: SingleNeuron
    w: list[float]
    b: float
    errors: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        z = _score(self.w, self.b, F.col(self.params.features).cast("array<double>"))
        return df.withColumn("prediction", vec.applied(self.params.activation, z))
