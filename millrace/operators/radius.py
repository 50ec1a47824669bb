"""All pairs of vectors within a radius, exactly, by pivot cells and blocks.

Rows go to the cell of their nearest pivot. A row of one cell can be within
``eps`` of a row of another only if it is within ``eps`` plus that cell's radius
of the other pivot (triangle inequality), so it visits only those cells, and of
two cells only that of the higher number. In a cell, rows are dealt into blocks,
and each pair of blocks is one task's matrix product; pairs near the radius are
settled by the differences themselves. Where cells leave out little, as with many
features, all rows are dealt into fewer and larger blocks instead, and each block
meets each other once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import cut
from millrace.plans.ranks import hash_key
from millrace.plans.sums import matrix

SLACK = 1e-9  #: relative; wider than the rounding of products
VISITS = 65_536  #: rows that leave a batch of visitors together
STRIP = 1 << 21  #: distances computed at a time
GATHERED = 16_384  #: pairs settled by their differences at a time


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """All distances between rows; Euclidean ones by products."""
    if metric == "manhattan":
        out = np.zeros((len(x), len(y)))
        for a, b in zip(x.T, y.T):
            out += np.abs(a[:, None] - b[None])
        return out
    d2 = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d2, 0))


def exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of matching rows, summed feature by feature."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        total += np.abs(a - b) if metric == "manhattan" else (a - b) * (a - b)
    return total if metric == "manhattan" else np.sqrt(total)


def _scale(*sets: np.ndarray) -> float:
    """How far a distance by products may be off, at most."""
    return SLACK * (1 + max(float(np.abs(s).sum(axis=1).max(initial=0)) for s in sets))


def _to_cells(pivots: np.ndarray, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(matrix(b.column("x")), pivots, metric)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1))], names=[*b.schema.names, "cell", "r"])

    return run


def _visits(pivots: np.ndarray, reach: np.ndarray, metric: str):
    """A row for the row's own cell, and one for each higher cell that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, cell = matrix(b.column("x")), b.column("cell").to_numpy()
            near = _near(x, cell, pivots, reach, metric)
            kept = [c for c in b.schema.names if c != "cell"]
            # a row may go to every cell, so few leave at a time
            step = max(1, VISITS // len(pivots))
            for i in range(0, len(x), step):
                row, to = np.nonzero(near[i : i + step])
                row += i
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in kept), pa.array(to), pa.array(to == cell[row])], names=[*kept, "cell", "own"])

    return run


def _near(x: np.ndarray, cell: np.ndarray, pivots: np.ndarray, reach: np.ndarray, metric: str) -> np.ndarray:
    """Which cells the rows visit."""
    near = distances(x, pivots, metric) <= reach[None] + _scale(x, pivots)
    near &= np.arange(len(pivots))[None] > cell[:, None]
    near[np.arange(len(x)), cell] = True
    return near


def _visitors(pivots: np.ndarray, reach: np.ndarray, metric: str):
    """How many rows visit each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pivots), np.int64)
        for b in batches:
            if b.num_rows:
                n += _near(matrix(b.column("x")), b.column("cell").to_numpy(), pivots, reach, metric).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["cell", "v"])

    return run


def close_pairs(t: pa.Table, eps: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs within ``eps`` of a block pair, each once, a strip at a time."""
    left = t.column("left").to_numpy().astype(bool)
    a, x, own = t.column("a").to_numpy(), matrix(t.column("x")), t.column("own").to_numpy().astype(bool)
    l, r = np.flatnonzero(left), np.flatnonzero(~left)
    y = x[r]
    step = max(16, STRIP // max(1, len(r)))
    for i in range(0, len(l), step):
        rows = l[i : i + step]
        d, slack = distances(x[rows], y, metric), _scale(x[rows], y)
        p, q = np.nonzero(d <= eps + slack)
        open_ = d[p, q] >= eps - slack
        p, q = rows[p], r[q]
        ok = ~own[p] | (a[p] < a[q])
        p, q, open_ = p[ok], q[ok], np.flatnonzero(open_[ok])
        ok = np.ones(len(p), bool)
        for j in range(0, len(open_), GATHERED):
            k = open_[j : j + GATHERED]
            ok[k] = exact(x[p[k]], x[q[k]], metric) <= eps
        yield p[ok], q[ok]


def _compare(eps: float, metric: str):
    def run(key, t):
        a, found = t.column("a").to_numpy(), [np.zeros((0, 2), np.int64)]
        for p, q in close_pairs(t, eps, metric):
            found.append(np.stack((np.minimum(a[p], a[q]), np.maximum(a[p], a[q])), axis=1))
        out = np.concatenate(found)
        return pa.table({"a": out[:, 0].copy(), "b": out[:, 1].copy()})

    return run


def _each_with_each(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt into ``n`` blocks, each pair of which is there once (bi <= bj);
    rows of one block are ``own``."""
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("a"), F.lit(n)))
    lefts = dealt.withColumn("bi", F.col("b")).withColumn("bj", F.explode(F.expr(f"sequence(b, {n - 1}L)"))).withColumn("left", F.lit(True))
    rights = dealt.withColumn("bi", F.explode(F.expr("sequence(0L, b)"))).withColumn("bj", F.col("b")).withColumn("left", F.lit(False))
    both = lefts.unionByName(rights).select(*rows.columns, (F.col("bi") == F.col("bj")).alias("own"), F.lit(0).cast("long").alias("cell"), "bi", "bj", "left")
    return both.repartition(min(n * (n + 1) // 2, 4096), "cell", "bi", "bj")


def blocks(rows: DataFrame, eps: float, metric: str, cell_rows: int = 512, max_pivots: int = 1024, block_rows: int = 1024, wide_rows: int = 16_384) -> DataFrame | None:
    """``rows`` (a: long, x: array<double>, further columns) -> a row for each
    block pair (cell, bi, bj) and side (``left`` or not) that a row is in; every
    two rows within ``eps`` meet on opposite sides of one pair, rows of one cell
    (``own``) twice. Where cells would compare most pairs, or copy rows more often
than larger blocks of all rows (``block_rows`` to ``wide_rows``) do, those are
taken. None without rows."""
    n = rows.count()
    k = int(max(1, min(max_pivots, n // cell_rows)))
    # at most max_pivots vectors on the driver
    pivots = [r["x"] for r in rows.orderBy(hash_key(0, "a"), "a").limit(k).select("x").collect()]
    if not pivots:
        return None
    pivots = np.array(pivots)
    shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    own = cut(rows.repartition(max(1, min(n // 256, 4096))).mapInArrow(_to_cells(pivots, metric), f"{shape}, cell long, r double"))
    reach = np.full(len(pivots), -np.inf)
    for r in own.groupBy("cell").agg(F.max("r").alias("r")).collect():
        reach[r["cell"]] = r["r"] + eps
    n_own = {r["cell"]: r["n"] for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per pivot
    visitors = {r["cell"]: r["v"] for r in own.select("x", "cell").mapInArrow(_visitors(pivots, reach, metric), "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    whole = -(-n // max(block_rows, min(wide_rows, n // 16)))
    if sum(v * n_own.get(c, 0) for c, v in visitors.items()) > 0.4 * n * n or sum(visitors.values()) > 2 * n * (whole + 1):
        return _each_with_each(own.drop("cell", "r"), whole)
    all_ = cut(own.drop("r").mapInArrow(_visits(pivots, reach, metric), f"{shape}, cell long, own boolean"))
    load = all_.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("lb"), F.ceil(F.count_if("own") / block_rows).alias("rb"))  # a row per pivot
    block = lambda n: F.pmod(F.xxhash64("a"), F.col(n))
    dealt = all_.join(F.broadcast(load), "cell")
    names = [*rows.columns, "own", "cell"]
    lefts = dealt.withColumn("bj", F.explode(F.expr("sequence(0L, rb - 1L)"))).select(*names, block("lb").alias("bi"), "bj", F.lit(True).alias("left"))
    rights = dealt.where("own").withColumn("bi", F.explode(F.expr("sequence(0L, lb - 1L)"))).select(*names, "bi", block("rb").alias("bj"), F.lit(False).alias("left"))
    return lefts.unionByName(rights)


def vector_pairs(rows: DataFrame, eps: float, metric: str, **sizes: int) -> DataFrame:
    """``rows`` (a: long, x: array<double>) -> (a, b), a < b, for rows at most ``eps`` apart."""
    met = blocks(rows, eps, metric, **sizes)
    if met is None:
        return rows.select("a", F.col("a").alias("b")).limit(0)
    return met.groupBy("cell", "bi", "bj").applyInArrow(_compare(eps, metric), "a long, b long")
