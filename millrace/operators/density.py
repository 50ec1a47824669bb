"""Density without lists of pairs: core rows, links between them, border rows.

Equal vectors are one row with a weight. Up to three features, rows lie in grid
cells within which all are neighbours: a cell of enough rows is core by its count
alone, only rows of other cells count their neighbours, and core rows of a cell
are one node. Whether two cells are linked is decided by the boxes around parts
of their rows, and only where these leave it open, and nothing else links the
two, by the rows of those parts. Wider vectors meet in pivot cells and blocks
(``radius.blocks``), once to count and once to link; a pair of blocks hands on a
count per row, then a spanning star of its core rows, and for rows that are not
core their core neighbours, of which there are fewer than ``min_samples``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.radius import blocks, close_pairs, distances, exact
from millrace.plans.components import components
from millrace.plans.lineage import cut
from millrace.plans.sums import matrix


@dataclass(frozen=True)
class Density:
    """``core`` (a, node): core rows and the node that stands for them, whose
    number is the smallest of its rows; ``edges`` (a, b) link nodes; ``border``
    (a, node): rows that are not core and the nodes that they reach."""

    core: DataFrame
    edges: DataFrame
    border: DataFrame


# ---- wide vectors -------------------------------------------------------------------


def _counts(eps: float, metric: str):
    """A block pair -> the weight of the neighbours found, by row."""

    def run(key, t):
        a, w = t.column("a").to_numpy(), t.column("w").to_numpy()
        n = np.zeros(len(a), np.int64)
        for p, q in close_pairs(t, eps, metric):
            n += np.bincount(p, w[q], len(a)).astype(np.int64) + np.bincount(q, w[p], len(a)).astype(np.int64)
        hit = np.flatnonzero(n)
        return pa.table({"a": a[hit], "n": n[hit]})

    return run


def _stars(eps: float, metric: str):
    """A block pair -> a star of each group of linked core rows, and the core
    neighbours of the other rows."""

    def run(key, t):
        a, core = t.column("a").to_numpy(), t.column("core").to_numpy().astype(bool)
        ids, row = np.unique(a, return_inverse=True)
        label, border = np.arange(len(ids)), [np.zeros((0, 2), np.int64)]
        for p, q in close_pairs(t, eps, metric):
            for x, y in ((p, q), (q, p)):
                out = ~core[x] & core[y]
                border.append(np.stack((a[x[out]], a[y[out]]), axis=1))
            both = core[p] & core[q]
            x, y = row[p[both]], row[q[both]]
            while len(x):
                lx, ly = label[x], label[y]
                apart = lx != ly
                if not apart.any():
                    break
                x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
                np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
                while (label[label] != label).any():
                    label = label[label]
        leaf = np.flatnonzero(label != np.arange(len(ids)))
        border = np.concatenate(border)
        return pa.table({"a": np.concatenate((ids[leaf], border[:, 0])), "b": np.concatenate((ids[label[leaf]], border[:, 1])), "star": np.arange(len(leaf) + len(border)) < len(leaf)})

    return run


def by_blocks(rows: DataFrame, eps: float, min_samples: int, metric: str, **sizes: int) -> Density:
    """``rows`` (a, x, w) of any width."""
    none = rows.select("a", F.col("a").alias("b")).limit(0)
    met = blocks(rows, eps, metric, **sizes)
    if met is None:
        return Density(none.withColumnRenamed("b", "node"), none, none.withColumnRenamed("b", "node"))
    key = ["cell", "bi", "bj"]
    n = met.groupBy(*key).applyInArrow(_counts(eps, metric), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    core = cut(rows.select("a", "w").join(n, "a", "left").where(F.coalesce("n", F.lit(0)) + F.col("w") >= min_samples).select("a"))
    flagged = met.join(core.withColumn("core", F.lit(True)), "a", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    found = cut(flagged.groupBy(*key).applyInArrow(_stars(eps, metric), "a long, b long, star boolean"))
    return Density(core.withColumn("node", F.col("a")), found.where("star").select("a", "b"), found.where("not star").select("a", F.col("b").alias("node")))


# ---- up to three features -----------------------------------------------------------


def _offsets(d: int, metric: str) -> list[tuple[int, ...]]:
    """Cells that can hold a neighbour of a row of cell 0, itself included. Sides
    are eps / sqrt(d), or eps / d for sums, less a little."""
    far = 1 + (math.isqrt(d) if metric == "euclidean" else d)
    gap = (lambda o: sum(max(abs(v) - 1, 0) ** 2 for v in o)) if metric == "euclidean" else (lambda o: sum(max(abs(v) - 1, 0) for v in o))
    return [o for o in itertools.product(range(-far, far + 1), repeat=d) if gap(o) <= d]


def _moved(offsets: list[tuple[int, ...]]) -> Column:
    """One row for each offset of the cell ``c``."""
    return F.explode(F.array(*(F.array(*(F.col("c")[i] + v for i, v in enumerate(o))) for o in offsets)))


def _reached(eps: float, metric: str, links: bool):
    """Visitors and rows of a cell -> how much weight each visitor reaches, or
    the cell's node if it reaches any."""

    def run(key, asks: pa.Table, rows: pa.Table) -> pa.Table:
        a, x, y = asks.column("a").to_numpy(), matrix(asks.column("x")), matrix(rows.column("x"))
        w = rows.column("w").to_numpy()
        n = np.zeros(len(a), np.int64)
        for i in range(len(a) if len(w) else 0):
            n[i] = w[exact(np.broadcast_to(x[i], y.shape), y, metric) <= eps].sum()
        hit = np.flatnonzero(n)
        return pa.table({"a": a[hit], "n": n[hit] if not links else np.repeat(rows.column("node").to_numpy()[:1], len(hit))})

    return run


def _visit(asks: DataFrame, rows: DataFrame, offsets: list[tuple[int, ...]], eps: float, metric: str, links: bool, block_rows: int) -> DataFrame:
    """``asks`` (a, x, c) look into the cells around theirs; (a, n)."""
    held = rows.withColumn("b", F.floor(F.col("i") / block_rows).cast("int"))
    there = held.groupBy("c").agg(F.max("b").alias("last"))
    visits = asks.select("a", "x", _moved(offsets).alias("c")).join(there, "c").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("last")))).select("a", "x", "c", "b")
    visits = visits.toDF(*visits.columns)  # as columns of its own, for both sides come from the same rows
    return visits.groupBy("c", "b").cogroup(held.select("c", "b", "x", "w", "node").groupBy("c", "b")).applyInArrow(lambda k, l, r: _reached(eps, metric, links)(k, l, r), "a long, n long")


def _gaps(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance between any rows of two sets of boxes."""
    near = far = 0.0
    for a, b, c, e in zip(low.T, high.T, low2.T, high2.T):
        g = np.maximum(np.maximum(c[None] - b[:, None], a[:, None] - e[None]), 0)
        f = np.maximum(e[None] - a[:, None], b[:, None] - c[None])
        near, far = (near + g, far + f) if metric == "manhattan" else (near + g * g, far + f * f)
    return (near, far) if metric == "manhattan" else (np.sqrt(near), np.sqrt(far))


def _decide(eps: float, metric: str, d: int):
    """Two cells' boxes -> linked (true, or null where boxes leave it open) and
    the parts of both in question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                low, high, low2, high2 = (np.array([[v[f"{n}{i}"] for i in range(d)] for v in r[s]]) for s in ("p", "p2") for n in ("l", "h"))
                near, far = _gaps(low, high, low2, high2, metric)
                if (far <= eps).any():
                    out.append({"a": r["node"], "b": r["node2"], "linked": True, "s": None, "s2": None})
                elif (near <= eps).any():
                    s, s2 = np.nonzero(near <= eps)
                    out.append({"a": r["node"], "b": r["node2"], "linked": None, "s": [r["p"][i]["s"] for i in np.unique(s)], "s2": [r["p2"][i]["s"] for i in np.unique(s2)]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("s", pa.list_(pa.int32())), ("s2", pa.list_(pa.int32()))]))

    return run


def _touch(eps: float, metric: str):
    """Blocks of two cells' rows -> the cells' nodes if any two are neighbours."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = matrix(left.column("x")), matrix(right.column("x"))
        hit = False
        for i in range(0, len(x) if len(y) else 0, 256):
            part = x[i : i + 256]
            d = distances(part, y, metric)
            # products round; what is near the radius is settled by the differences
            p, q = np.nonzero(d <= eps + 1e-9 * (1 + np.abs(part).sum(axis=1).max() + np.abs(y).sum(axis=1).max()))
            if len(p) and (exact(part[p], y[q], metric) <= eps).any():
                hit = True
                break
        return pa.table({"a": pa.array([key[0].as_py()] * hit, pa.int64()), "b": pa.array([key[1].as_py()] * hit, pa.int64())})

    return run


def by_grid(rows: DataFrame, d: int, eps: float, min_samples: int, metric: str, parts: int = 8, block_rows: int = 4096) -> Density:
    """``rows`` (a, x, w) of up to three features."""
    side = eps / (math.sqrt(d) if metric == "euclidean" else d) * (1 - 1e-9)
    offsets = _offsets(d, metric)
    at = F.transform("x", lambda v: F.floor(v / side))
    rows = rows.withColumn("c", at)
    # the part of its cell that a row is in, and its place among the cell's rows for blocks
    grain = parts if d == 2 else 4 if d == 3 else parts * parts
    sub = sum((F.least(F.floor((F.col("x")[i] / side - F.col("c")[i]) * grain), F.lit(grain - 1)) * grain**i for i in range(d)), F.lit(0)).cast("int")
    cells = rows.groupBy("c").agg(F.sum("w").alias("cw"), F.count("*").alias("cn"), F.min("a").alias("node"))
    spread = F.pmod(F.xxhash64("a"), F.greatest(F.col("cn"), F.lit(1)))
    rows = cut(rows.join(cells, "c").select("a", "x", "w", "c", "cw", "cn", "node", sub.alias("s"), spread.alias("i")))
    sparse = rows.where(F.col("cw") < min_samples)
    seen = _visit(sparse.select("a", "x", "c"), rows, offsets, eps, metric, False, block_rows).groupBy("a").agg(F.sum("n").alias("n"))
    more = sparse.join(seen, "a").where(F.col("n") >= min_samples).select(*rows.columns)
    core = rows.where(F.col("cw") >= min_samples).unionByName(more)
    own = core.groupBy("c").agg(F.min("a").alias("first"))
    core = cut(core.drop("node").join(own.withColumnRenamed("first", "node"), "c"))

    # a cell's core rows in boxes: at most grain ** d of them
    box = core.groupBy("c", "node", "s").agg(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("l", F.min), ("h", F.max))))
    box = cut(box.groupBy("c", "node").agg(F.collect_list(F.struct("s", *(f"{n}{i}" for i in range(d) for n in "lh"))).alias("p")))
    ahead = [o for o in offsets if o > (0,) * d]
    there = box.select(F.col("c").alias("c2"), F.col("node").alias("node2"), F.col("p").alias("p2"))
    both = box.select("node", "p", _moved(ahead).alias("c2")).join(there, "c2").select("node", "p", "node2", "p2")
    decided = cut(both.mapInArrow(_decide(eps, metric, d), "a long, b long, linked boolean, s array<int>, s2 array<int>"))
    sure = decided.where("linked").select("a", "b")
    open_ = decided.where("linked is null")
    if not open_.isEmpty():
        root = components(sure)
        for c in "ab":
            open_ = open_.join(root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
        open_ = cut(open_.where("ra <> rb").select("a", "b", "s", "s2"))
        piece = core.select("node", "s", "x", F.floor(F.col("i") / block_rows).cast("int").alias("k"))

        def side_of(c: str, parts: str) -> DataFrame:
            return open_.select("a", "b", F.col(c).alias("node"), F.explode(parts).alias("s")).join(piece, ["node", "s"]).select("a", "b", "x", "k").toDF("a", "b", "x", "k")

        left, right = side_of("a", "s"), side_of("b", "s2")
        nl, nr = (t.groupBy("a", "b").agg(F.max("k").alias(n)) for t, n in ((left, "nl"), (right, "nr")))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n)))
        left = left.withColumnRenamed("k", "kl").join(nr, ["a", "b"]).withColumn("kr", every("nr")).select("a", "b", "kl", "kr", "x")
        right = right.withColumnRenamed("k", "kr").join(nl, ["a", "b"]).withColumn("kl", every("nl")).select("a", "b", "kl", "kr", "x")
        key = ["a", "b", "kl", "kr"]
        sure = sure.unionByName(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda k, l, r: _touch(eps, metric)(k, l, r), "a long, b long"))
    rest = sparse.join(core.select("a"), "a", "left_anti")
    border = _visit(rest.select("a", "x", "c"), core, offsets, eps, metric, True, block_rows)
    return Density(core.select("a", "node"), sure, border.select("a", F.col("n").alias("node")))
