"""Distance joins and k nearest neighbours.

Neighbours by a named metric are found by pivots (``nearest.py``); a metric that
is a callable, of which nothing is known, is computed for all pairs. Both sides
are dealt into blocks and each pair of blocks is a task in numpy, so no side has
to fit in a task: ``pairwise`` hands on distances by named metrics, ``KNN`` the k
best rows of each query. For a callable of columns rows are joined; there the
smaller side is broadcast only while it has at most ``BROADCAST_ROWS`` rows and
``BROADCAST_DOUBLES`` vector components.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vec
from millrace.operators.nearest import nearest
from millrace.operators.radius import exact
from millrace.operators.vote import average_label, majority_vote
from millrace.plans.sums import matrix

BROADCAST_ROWS = 20_000
BROADCAST_DOUBLES = 4_000_000
BLOCK_ROWS = 1024  #: rows of either side that meet in one task


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """At most so many rows, and so many components in their array columns."""
    arrays = [F.coalesce(F.size(c), F.lit(0)) for c, t in df.dtypes if t.startswith("array")]
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(sum(arrays, F.lit(0))), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_DOUBLES


def pairs(a: DataFrame, b: DataFrame, condition: Column | None = None, block_rows: int = 4096) -> DataFrame:
    """All pairs of rows of two frames with distinct column names (that meet ``condition``)."""
    for left, right in ((a, b), (b, a)):
        if small(right):
            got = left.join(F.broadcast(right), condition) if condition is not None else left.crossJoin(F.broadcast(right))
            return got.select(*a.columns, *b.columns)
    n = max(1, -(-a.count() // block_rows))
    left = a.withColumn("__q", F.pmod(F.xxhash64(*(c for c, t in a.dtypes if not t.startswith("map"))), F.lit(n)))
    right = b.withColumn("__q2", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    got = left.join(right, F.col("__q") == F.col("__q2"))
    return (got if condition is None else got.where(condition)).drop("__q", "__q2")


def in_blocks(a: DataFrame, b: DataFrame, f: Callable, shape: str, block_rows: int = 0) -> DataFrame:
    """Each block of ``a`` and block of ``b`` (both hold vectors ``x``) through
    ``f(key, left, right)``, a function of Arrow tables."""
    block_rows = block_rows or BLOCK_ROWS
    n, m = (max(1, -(-t.count() // block_rows)) for t in (a, b))
    deal = lambda t, k: F.pmod(F.xxhash64(*t.columns), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    key = ["__i", "__j"]
    # as many partitions as pairs of blocks: they are small, but what is computed of them is not
    left = a.withColumn("__i", deal(a, n)).withColumn("__j", every(m)).repartition(min(n * m, 4096), *key)
    right = b.withColumn("__j", deal(b, m)).withColumn("__i", every(n)).repartition(min(n * m, 4096), *key)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda k, x, y: f(k, x, y), shape)


def _whole(col: pa.ChunkedArray) -> np.ndarray:
    """Which vectors hold no null."""
    return ~col.combine_chunks().flatten().is_null().to_numpy(zero_copy_only=False).reshape(len(col), -1).any(axis=1)


def _all_distances(metrics: dict[str, str]):
    """Two blocks -> every pair and its distances; null if a vector holds a null."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = len(left), len(right)
        out = {"a_id": left.column("a_id").take(pa.array(np.repeat(np.arange(n), m))), "b_id": right.column("b_id").take(pa.array(np.tile(np.arange(m), n)))}
        x, y = matrix(left.column("x")), matrix(right.column("x"))
        void = ~(_whole(left.column("x"))[:, None] & _whole(right.column("x"))[None]).ravel() if n and m else np.zeros(0, bool)
        for name, metric in metrics.items():
            d = np.empty((n, m))
            for i in range(n if m else 0):
                d[i] = exact(np.broadcast_to(x[i], y.shape), y, metric)
            out[name] = pa.array(d.ravel(), mask=void)
        return pa.table(out)

    return run


def pairwise(a: DataFrame, b: DataFrame, metric: str | vec.Metric | dict[str, str] = "euclidean", features: str = "features", row_id: str = "row_id") -> DataFrame:
    """(a_id, b_id, dist) for every pair. Several named metrics, given as columns
    and their metrics, are computed for a pair at once."""
    d = vec.width(a, features)
    if vec.width(b, features) != d:
        raise ValueError("both sides must have the same width")
    left = a.select(F.col(row_id).alias("a_id"), F.col(features).cast("array<double>").alias("x"))
    right = b.select(F.col(row_id).alias("b_id"), F.col(features).cast("array<double>").alias("x"))
    if callable(metric):
        m = vec.metric(metric, d)
        return pairs(left.withColumnRenamed("x", "__a"), right.withColumnRenamed("x", "__b")).select("a_id", "b_id", m(F.col("__a"), F.col("__b")).alias("dist"))
    named = metric if isinstance(metric, dict) else {"dist": metric}
    for name in named.values():
        vec.metric(name, d)
    shape = f"a_id {dict(left.dtypes)['a_id']}, b_id {dict(right.dtypes)['b_id']}, " + ", ".join(f"{c} double" for c in named)
    return in_blocks(left, right, _all_distances({c: str(name).lower() for c, name in named.items()}), shape)


def _closest(k: int, metric: Callable):
    """A block of queries and one of rows -> at most k rows of each query, by (distance, id)."""

    def run(key, asks: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = matrix(asks.column("x")), matrix(rows.column("x"))
        place = pc.rank(rows.column("t"), tiebreaker="dense").to_numpy() if len(rows) else np.zeros(0, np.int64)
        each, hits, dist = list(x), [np.zeros(0, np.int64)], [np.zeros(0)]
        ask = np.repeat(np.arange(len(asks)), min(k, len(rows)))
        for v in q if len(rows) else ():
            d = np.fromiter((float(metric(v, y)) for y in each), float, len(each))
            near = np.arange(len(d))
            if len(d) > k:
                # NaN comes last
                near = np.flatnonzero(~(d > np.partition(d, k - 1)[k - 1]))
            near = near[np.lexsort((place[near], d[near]))[:k]]
            hits.append(near)
            dist.append(d[near])
        hits = pa.array(np.concatenate(hits))
        kept = {c: rows.column(c).take(hits) for c in rows.schema.names if c not in ("x", "__i", "__j")}
        return pa.table({"query_id": asks.column("q").take(pa.array(ask)), "train_id": kept.pop("t"), "dist": np.concatenate(dist)} | kept)

    return run


@dataclass(frozen=True)
class KNN:
    """k nearest neighbours by (distance, row_id)."""

    k: int = 5
    task: str = "classification"
    metric: str | vec.Metric = "euclidean"
    weights: str = "uniform"
    eps: float = 1e-12
    features: str = "features"
    label: str = "label"
    row_id: str = "row_id"

    def __post_init__(self):
        if not isinstance(self.k, int) or self.k <= 0:
            raise ValueError("k must be a positive integer")
        if self.task not in ("classification", "regression"):
            raise ValueError(f"unknown task {self.task!r}")
        if self.weights not in ("uniform", "distance"):
            raise ValueError(f"unknown weights {self.weights!r}")
        if not callable(self.metric):
            vec.metric(self.metric, 1)

    def fit(self, train: DataFrame) -> KNNModel:
        d = vec.width(train, self.features)
        n = train.count()
        if self.k > n:
            raise ValueError("k must not exceed the number of training rows")
        return KNNModel(self, train, d, n)


@dataclass(frozen=True)
class KNNModel:
    params: KNN
    train: DataFrame
    width: int
    n: int

    def kneighbors(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Long rows (query_id, rank from 1, train_id, dist, label). With a named
        metric, vectors that hold null or non-finite components take no part."""
        p, k = self.params, self.params.k if k is None else k
        if k <= 0 or k > self.n:
            raise ValueError("k must be between 1 and the number of training rows")
        ok = F.assert_true(F.size(p.features) == self.width, F.lit("query width differs from training width"))
        q = queries.select(F.col(p.row_id).alias("q"), F.when(ok.isNull(), F.col(p.features).cast("array<double>")).alias("x"))
        t = self.train.select(F.col(p.row_id).alias("t"), F.col(p.features).cast("array<double>").alias("x"), *([F.col(p.label).alias("label")] if p.label in self.train.columns else []))
        if not callable(p.metric):
            return nearest(q, t, k, p.metric.lower()).rows
        if vec.expression(p.metric, F.col("x"), F.col("x")) is None:
            kind = dict(t.dtypes)
            shape = ", ".join([f"query_id {dict(q.dtypes)['q']}", f"train_id {kind['t']}", "dist double", *(f"{c} {kind[c]}" for c in t.columns[2:])])
            near = in_blocks(q, t, _closest(k, p.metric), shape)
        else:
            m = vec.metric(p.metric, self.width)
            near = pairs(t.withColumnRenamed("x", "tx"), q).select(F.col("q").alias("query_id"), F.col("t").alias("train_id"), m(F.col("x"), F.col("tx")).alias("dist"), *t.columns[2:])
        w = Window.partitionBy("query_id").orderBy("dist", "train_id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def transform(self, queries: DataFrame, neighbors: bool = False) -> DataFrame:
        """``queries`` plus prediction (and neighbors, an array by rank)."""
        p = self.params
        near = self.kneighbors(queries)
        w = F.lit(1.0) if p.weights == "uniform" else 1.0 / (F.col("dist") + p.eps)
        f = majority_vote if p.task == "classification" else average_label
        out = f(near, ["query_id"], "label", w, "prediction")
        if neighbors:
            lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "train_id", "dist"))).alias("neighbors"))
            out = out.join(lists, "query_id")
        return queries.join(out, queries[p.row_id] == out["query_id"], "left").drop("query_id")
