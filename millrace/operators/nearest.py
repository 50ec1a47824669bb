"""Exact k-nearest-neighbour join by pivots, in two phases.

Training rows go to the cell of their nearest pivot and keep their distance from
it. A query first meets the rows of its own cell, which bounds the distance of
its k-th neighbour; by the triangle inequality it then visits only cells that
can hold a row within that bound. In a cell, and in each phase, only rows whose
distance from the pivot differs from the query's by no more than the bound are
compared, a contiguous stretch of the rows sorted by it.

Rows of a cell are dealt into blocks, queries that visit it likewise, and each
pair of blocks is one task, which hands on at most k rows of a query. Pivots and
a row of statistics for each (at most ``max_pivots``) are all that the driver
holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.radius import SLACK, distances, exact
from millrace.plans.lineage import cut
from millrace.plans.ranks import hash_key
from millrace.plans.sums import matrix


@dataclass(frozen=True)
class Neighbours:
    """``rows``: query_id, rank from 1, train_id, dist and the training rows'
    other columns; ``tasks``: how many distances each task computed."""

    rows: DataFrame
    tasks: DataFrame

    def compared(self) -> int:
        return self.tasks.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def _size(x: np.ndarray) -> float:
    return 1 + float(np.abs(x).sum(axis=1).max(initial=0))


def _to_cells(pivots: np.ndarray, metric: str):
    """Adds the nearest pivot and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                cell = distances(x, pivots, metric).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(exact(x, pivots[cell], metric))], names=[*b.schema.names, "cell", "r"])

    return run


def _visits(pivots: np.ndarray, stats: np.ndarray, k: int, metric: str, first: bool):
    """Queries -> a row for each cell to visit: the nearest that holds rows in
    the first phase; then the others that the bound allows. ``stats``: rows,
    least and largest distance from the pivot of each cell."""
    rows, low, high = stats.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"))
            d = distances(x, pivots, metric)
            d[:, rows == 0] = np.inf
            home = d.argmin(axis=1)
            slack = SLACK * (_size(x) + _size(pivots))
            if first:
                # any k rows of the cells nearest by their outer rims bound the k-th distance
                rim = d + high
                order = np.argsort(rim, axis=1, kind="stable")
                enough = (np.cumsum(rows[order], axis=1) >= k).argmax(axis=1)
                at = np.arange(len(x))
                row, to = at, home
                bound = rim[at, order[at, enough]] + slack
            else:
                bound = b.column("bound").to_numpy()
                far = np.maximum(d - high, low - d) - slack
                go = (far <= bound[:, None]) & (rows > 0)
                go[np.arange(len(x)), home] = False
                row, to = np.nonzero(go)
                bound = bound[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("q").take(take), b.column("x").take(take), pa.array(to), pa.array(d[row, to]), pa.array(bound)], names=["q", "x", "cell", "r", "bound"])

    return run


def _best(k: int, metric: str):
    """A block of queries and a block of a cell's rows -> at most k rows of each
    query within its bound, by (distance, id), and one row that counts the
    distances computed."""

    def run(key, asks: pa.Table, rows: pa.Table) -> pa.Table:
        names = [c for c in rows.schema.names if c not in ("x", "cell", "r", "lb")]
        rows = rows.sort_by("r").combine_chunks()
        r, x = rows.column("r").to_numpy(), matrix(rows.column("x"))
        place = pc.rank(rows.column("t"), tiebreaker="dense").to_numpy() if len(x) else np.zeros(0, np.int64)
        q, at, bound = matrix(asks.column("x")), asks.column("r").to_numpy(), asks.column("bound").to_numpy()
        slack = SLACK * (_size(q) + _size(x)) if len(x) and len(q) else 0.0
        start, end = np.searchsorted(r, at - bound - slack), np.searchsorted(r, at + bound + slack, side="right")
        hits, dist, n, pairs = [np.zeros(0, np.int64)], [np.zeros(0)], [], 0
        for i, (lo, hi) in enumerate(zip(start.tolist(), end.tolist())):
            pairs += hi - lo
            near = np.zeros(0, np.int64)
            if hi > lo:
                d = distances(q[i : i + 1], x[lo:hi], metric)[0]
                limit = bound[i]
                if len(d) > k:
                    limit = min(limit, np.partition(d, k - 1)[k - 1])
                near = lo + np.flatnonzero(d <= limit + slack)
                real = exact(np.broadcast_to(q[i], (len(near), q.shape[1])), x[near], metric)
                keep = np.lexsort((place[near], real))[:k]
                near, real = near[keep], real[keep]
                dist.append(real)
                hits.append(near)
            n.append(len(near))
        hits, ask = pa.array(np.concatenate(hits)), pa.array(np.repeat(np.arange(len(n)), n))
        found = pa.table({"q": asks.column("q").take(ask), "dist": np.concatenate(dist), "pairs": pa.nulls(len(hits), pa.int64())} | {c: rows.column(c).take(hits) for c in names})
        count = pa.table({c: pa.array([pairs]) if c == "pairs" else pa.nulls(1, found.schema.field(c).type) for c in found.schema.names}, schema=found.schema)
        return pa.concat_tables([found, count])

    return run


def _phase(visits: DataFrame, held: DataFrame, load: DataFrame, k: int, metric: str, block_rows: int, out: str) -> DataFrame:
    """Each block of a cell's visiting queries with each block of its rows."""
    asks = visits.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("qn"))
    load = F.broadcast(load.join(asks, "cell"))  # a row per pivot
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(load, "cell").withColumn("qb", deal("q", "qn")).withColumn("lb", every("ln")).select("q", "x", "cell", "r", "bound", "qb", "lb")
    right = held.join(load, "cell").withColumn("lb", deal("t", "ln")).withColumn("qb", every("qn")).drop("qn", "ln")
    key = ["cell", "lb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda key, a, b: _best(k, metric)(key, a, b.drop_columns("qb")), out)


def nearest(queries: DataFrame, train: DataFrame, k: int, metric: str = "euclidean", cell_rows: int = 256, max_pivots: int = 1024, block_rows: int = 4096) -> Neighbours:
    """``queries`` (q, x) and ``train`` (t, x, further columns) -> each query's k
    nearest rows by (distance, t). Vectors that are null or hold null or
    non-finite components take no part. Query ids are to be unique."""
    good = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    queries, train = queries.where(good), cut(train.where(good))
    n = train.count()
    extra = [c for c in train.columns if c not in ("t", "x")]
    kind = dict(train.dtypes) | {"q": dict(queries.dtypes)["q"]}
    out = ", ".join(f"{c} {t}" for c, t in [("q", kind["q"]), ("dist", "double"), ("pairs", "long"), ("t", kind["t"]), *((c, kind[c]) for c in extra)])
    pivots = [r["x"] for r in train.orderBy(hash_key(1, "t"), "t").limit(int(max(1, min(max_pivots, n // cell_rows)))).select("x").collect()]
    if not pivots:
        none = queries.limit(0).join(train.limit(0).withColumnRenamed("x", "__x")).withColumn("dist", F.lit(0.0))
        return Neighbours(none.select(F.col("q").alias("query_id"), F.lit(1).alias("rank"), F.col("t").alias("train_id"), "dist", *extra), none.select(F.lit(0).alias("pairs")))
    pivots = np.array(pivots)
    held = train.select("t", "x", *extra).mapInArrow(_to_cells(pivots, metric), ", ".join([f"t {kind['t']}", "x array<double>", *(f"{c} {kind[c]}" for c in extra), "cell long", "r double"]))
    held = cut(held)
    load = held.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).withColumn("ln", F.ceil(F.col("n") / block_rows).cast("int"))
    load = cut(load)
    stats = np.zeros((len(pivots), 3))
    for r in load.collect():
        stats[r["cell"]] = r["n"], r["low"], r["high"]
    load, shape = load.select("cell", "ln"), f"q {kind['q']}, x array<double>, cell long, r double, bound double"
    here = queries.select("q", "x").mapInArrow(_visits(pivots, stats, k, metric, first=True), shape)
    here = cut(here)
    near = cut(_phase(here, held, load, k, metric, block_rows, out))
    found = near.where("pairs is null")
    if len(pivots) > 1:
        ranked = _ranked(found, k)
        reached = ranked.groupBy("q").agg(F.when(F.count("*") == k, F.max("dist")).alias("reached"))
        asks = here.join(reached, "q", "left").select("q", "x", F.least("bound", "reached").alias("bound"))
        away = cut(asks.mapInArrow(_visits(pivots, stats, k, metric, first=False), shape))
        more = cut(_phase(away, held, load, k, metric, block_rows, out))
        near = near.unionByName(more)
        found = ranked.drop("rank").unionByName(more.where("pairs is null"))
    best = _ranked(found, k).select(F.col("q").alias("query_id"), "rank", F.col("t").alias("train_id"), "dist", *extra)
    return Neighbours(best, near.where("pairs is not null").select("pairs"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("dist", "t")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
