"""Bagged classification trees, all grown together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import vec
from millrace.operators import metrics
from millrace.operators.tree import DecisionTreeClassifier, Node, _Classes, apply_tree, class_list, grow, importances, leaf_values, node_frame
from millrace.operators.validate import check_features, check_numeric, positive_int
from millrace.plans.ranks import positions


BLOCK = 4096  #: positions whose draws are made together


def block_draws(seed: int, tree: int, n: int, draws: int, block: int) -> np.ndarray:
    """How often each position of a block is drawn in ``draws`` draws with
    replacement from ``n`` positions. Ranges of positions are halved from the
    whole down; how many of a range's draws go to its left half is binomial, from
    a generator of the range's own, so every task finds the same numbers."""
    low, high = 0, n
    while True:
        rng = np.random.default_rng([seed, tree, low, high])
        if high - low <= BLOCK:
            return rng.multinomial(draws, np.full(high - low, 1 / (high - low)))
        middle = low + max(1, (high - low) // 2 // BLOCK) * BLOCK
        left = int(rng.binomial(draws, (middle - low) / (high - low)))
        if block * BLOCK < middle:
            high, draws = middle, left
        else:
            low, draws = middle, draws - left


def _drawn(seed: int, trees: int, n: int, draws: int):
    """Rows with their position -> each row for each tree that drew it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            at = b.column("__pos").to_numpy()
            rest = b.drop_columns("__pos")
            held, known = known, {}
            for tree in range(trees):
                w = np.zeros(len(at))
                for block in np.unique(at // BLOCK).tolist():
                    if (tree, block) not in held:
                        held[tree, block] = block_draws(seed, tree, n, draws, block)
                    known[tree, block] = held[tree, block]
                    own = np.flatnonzero(at // BLOCK == block)
                    w[own] = known[tree, block][at[own] - block * BLOCK]
                hit = np.flatnonzero(w)
                got = rest.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.full(len(hit), tree, np.int32)), pa.array(w[hit])], names=[*got.schema.names, "tree", "w"])

    return run


def bootstrap(df: DataFrame, n_trees: int, n_boot: int, seed: int, row_id: str = "row_id", draw: Column | None = None) -> DataFrame:
    """Exact-size draws with replacement: rows of ``df`` with ``tree`` and ``w``
    (how often the tree drew the row). Rows are numbered by ``row_id`` once and
    each finds its own draws; nothing of the size rows x trees is shuffled.
    ``draw`` may replace the generator; it sees the columns tree, draw and n, and
    its draws are joined to their rows."""
    n = df.count()
    placed = positions(df, F.col(row_id), name="__pos")
    if draw is None:
        shape = T.StructType([*df.schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("w", T.DoubleType())])
        return placed.select(*(F.col(f"`{c}`") for c in df.columns), "__pos").mapInArrow(_drawn(seed, n_trees, n, n_boot), shape)
    draws = df.sparkSession.range(n_trees * n_boot).select((F.col("id") % n_trees).cast("int").alias("tree"), F.floor(F.col("id") / n_trees).alias("draw"), F.lit(n).cast("long").alias("n"))
    counts = draws.select("tree", draw.cast("long").alias("__pos")).groupBy("tree", "__pos").agg(F.count("*").cast("double").alias("w"))
    return placed.join(counts, "__pos").drop("__pos")


@dataclass(frozen=True)
class BaggingClassifier:
    """Trees over bootstrap samples; the prediction is the class with the
    highest mean probability. A class that a tree never drew has probability 0 there."""

    n_estimators: int = 10
    max_samples: float = 1.0
    seed: int = 0
    base: DecisionTreeClassifier = field(default_factory=DecisionTreeClassifier)
    features: str = "features"
    label: str = "label"
    row_id: str = "row_id"

    def __post_init__(self):
        positive_int("n_estimators", self.n_estimators)
        if not 0 < self.max_samples <= 1:
            raise ValueError("max_samples must be in (0, 1]")

    def fit(self, df: DataFrame, draw: Column | None = None) -> BaggingModel:
        d = check_features(df, self.features)
        check_numeric(df, self.label)
        classes = class_list(df, self.label)
        n_boot = max(1, math.floor(self.max_samples * df.count()))
        drawn = bootstrap(df, self.n_estimators, n_boot, self.seed, self.row_id, draw)
        rows = drawn.select("tree", F.col(self.features).cast("array<double>").alias("x"), F.col(self.label).cast("double").alias("y"), "w")
        return BaggingModel(self, grow(rows, d, _Classes(classes), self.base.rules), d, classes)


@dataclass(frozen=True)
class BaggingModel:
    params: BaggingClassifier
    trees: dict[int, dict[int, Node]]
    n_features: int
    classes: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        ok = F.assert_true(F.size(self.params.features) == self.n_features, F.lit("width differs from the training width"))
        out = df.withColumn("__x", F.when(ok.isNull(), F.col(self.params.features).cast("array<double>")))
        grown = [nodes for _, nodes in sorted(self.trees.items())]
        out = out.withColumns({f"__l{i}": apply_tree(nodes, F.col("__x")) for i, nodes in enumerate(grown)})
        each = [leaf_values(nodes, F.col(f"__l{i}"), lambda n: [c / n.n for c in n.counts]) for i, nodes in enumerate(grown)]
        out = out.withColumns({f"__p{i}": p for i, p in enumerate(each)})
        mean = F.array(*(vec.total([F.col(f"__p{i}")[c] for i in range(len(each))]) / len(each) for c in range(len(self.classes))))
        out = out.withColumn("probability", mean).drop("__x", *(f"__{c}{i}" for i in range(len(each)) for c in "lp"))
        # differences beyond the twelfth decimal are ties, which go to the smaller class
        rounded = F.transform("probability", lambda v: F.round(v, 12))
        return out.withColumn("__r", rounded).withColumn("prediction", F.array(*(F.lit(c) for c in self.classes))[vec.argmax(F.col("__r"))]).drop("__r")

    def feature_importances(self) -> list[float]:
        each = [importances(nodes, self.n_features, weighted=False) for nodes in self.trees.values()]
        return [sum(v) / len(each) for v in zip(*each)]

    def node_table(self, spark) -> DataFrame:
        return node_frame(spark, self.trees)

    def score(self, df: DataFrame) -> float:
        t = self.transform(df).withColumn("__y", F.col(self.params.label).cast("double"))
        return t.agg(metrics.accuracy("__y", "prediction")).first()[0]
