"""Embedding near-duplicates by spherical k-means cells and blocked products.

Centres are fitted on a bounded sample (``SAMPLE_PER_CELL`` vectors a cell).
Every vector is then assigned to its nearest cells, as many as it takes for a
vector and one turned away from it by the threshold's angle to share a cell in
``recall`` of trials on the sample. Cells that hold far more than ``cell_rows``
vectors are split again in the same way, from a sample of their own, so the rows
that a vector is compared with do not grow with the input. A pair counts in the
lowest cell that both share, and there in the lowest part that both share.

Vectors of a part are dealt into blocks of ``block_rows`` and each pair of
blocks is one matrix product in double precision, so no task holds more than two
blocks whatever a part's size. Pairs are counted where they are found and leave
as local spanning stars. Equal vectors are one vector with a weight, so a hot
copy costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.scratch import Scratch

SAMPLE_PER_CELL = 16


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows; an emptied cell restarts at the row that is
    farthest from its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        sums, count, worst = np.zeros_like(c), np.zeros(len(c), np.int64), []
        for i in range(0, len(x), 4096):
            dot = x[i : i + 4096] @ c.T
            cell = dot.argmax(axis=1)
            np.add.at(sums, cell, x[i : i + 4096])
            count += np.bincount(cell, minlength=len(c))
            far = dot.max(axis=1).argmin()
            worst.append((float(dot[far].max()), i + int(far)))
        norm = np.linalg.norm(sums, axis=1)
        c = np.where((norm > 0)[:, None], sums / np.where(norm > 0, norm, 1)[:, None], c)
        for cell, (_, row) in zip(np.flatnonzero(count == 0), sorted(worst)):
            c[cell] = x[row]
    return c


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _nearest(dot: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` best columns of each row, in column order."""
    return np.sort(np.argpartition(-dot, n - 1, axis=1)[:, :n], axis=1) if n < dot.shape[1] else np.tile(np.arange(dot.shape[1]), (len(dot), 1))


def probes_for(x: np.ndarray, c: np.ndarray, threshold: float, recall: float, seed: int, trials: int = 1024) -> int:
    """The fewest nearest cells that a unit vector and one at cosine
    ``threshold`` from it, in a random direction, share in ``recall`` of trials."""
    rng = np.random.default_rng(seed)
    x = x[rng.integers(0, len(x), trials)]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(axis=1)[:, None] * x
    size = np.linalg.norm(u, axis=1)[:, None]
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * u / np.where(size > 0, size, 1)
    rank = [np.argsort(np.argsort(-(v @ c.T), axis=1), axis=1) for v in (x, y)]
    # both reach a common cell with that many probes
    need = np.sort(np.maximum(*rank).min(axis=1) + 1)
    return int(need[min(trials - 1, int(np.ceil(recall * trials)) - 1)])


def _fit(k: int, threshold: float, recall: float, seed: int):
    """Sampled unit rows -> one row: centres (flat, row by row) and probes."""

    def fit(x: np.ndarray) -> pa.Table:
        # probes are tried on rows that the centres have not seen
        x = x[np.random.default_rng(seed).permutation(len(x))]
        apart = max(1, min(1024, len(x) // 8))
        c = spherical_kmeans(x[apart:], k, seed=seed) if len(x) > apart else x
        return pa.table({"width": pa.array([x.shape[1]], pa.int32()), "centres": pa.array([c.ravel().tolist()], pa.list_(pa.float64())), "probes": pa.array([probes_for(x[:apart], c, threshold, recall, seed)], pa.int32())})

    return fit


def _fit_rows(fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_matrix(b.column("v")) for b in batches if b.num_rows]
        if got:
            yield from fit(np.concatenate(got)).to_batches()

    return run


def _assign(models: dict[int, tuple[int, np.ndarray, int]], step: int = 2048):
    """Adds ``cells`` by the model (first cell, centres, probes) of the row's
    width; a width without one is one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column("width").to_numpy()
            for w in np.unique(width).tolist():
                own = b.filter(pa.array(width == w))
                for i in range(0, own.num_rows, step):
                    part = own.slice(i, step)
                    if w in models:
                        first, c, n = models[w]
                        cells = first + _nearest(_matrix(part.column("v")) @ c.T, n)
                    else:
                        cells = np.full((part.num_rows, 1), -w)
                    yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("node", "weight", "v")), pa.array(list(cells), pa.list_(pa.int64()))], names=["node", "weight", "v", "cells"])

    return run


def _assign_parts(rows: pa.Table, model: pa.Table) -> pa.Table:
    """Rows of one cell and its model -> the rows with their parts of the cell."""
    c = np.array(model.column("centres")[0].as_py()).reshape(-1, model.column("width")[0].as_py())
    rows, n = rows.combine_chunks(), model.column("probes")[0].as_py()
    v = _matrix(rows.column("v").combine_chunks())
    parts = [list(_nearest(v[i : i + 2048] @ c.T, n)) for i in range(0, len(v), 2048)]
    return pa.table({x: rows.column(x) for x in ("node", "weight", "v", "cells", "cell")} | {"parts": pa.array([p for x in parts for p in x], pa.list_(pa.int64()))})


def _counted(own: np.ndarray, here: int, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose lowest common number is ``here``."""
    keep = [np.zeros(0, bool)]
    for i in range(0, len(a), step):
        x, y = own[a[i : i + step]], own[b[i : i + step]]
        both = (x[:, :, None] == y[:, None, :]).any(axis=2)
        keep.append(np.where(both, x, np.iinfo(np.int64).max).min(axis=1) == here)
    ok = np.concatenate(keep)
    return a[ok], b[ok]


def _compare(threshold: float):
    """One pair of blocks of a cell -> per row its links and its local root."""

    def run(key, table):
        cell, part, bi, bj = (x.as_py() for x in key)
        table = table.combine_chunks()
        block = table.column("block").to_numpy()
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        v, cells, parts = (_matrix(table.column(c).combine_chunks()) for c in ("v", "cells", "parts"))
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for i in range(0, len(left), 256):
            rows = left[i : i + 256]
            a, b = np.nonzero(v[rows] @ v[right].T >= threshold)
            a, b = rows[a], right[b]
            ok = a < b if bi == bj else np.ones(len(a), bool)
            a, b = a[ok], b[ok]
            for own, here in ((cells, cell), (parts, part)):
                a, b = _counted(own, here, a, b)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            while len(a):
                la, lb = label[a], label[b]
                ne = la != lb
                if not ne.any():
                    break
                a, b, la, lb = a[ne], b[ne], la[ne], lb[ne]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while (label[label] != label).any():
                    label = label[label]
        hit = np.flatnonzero(links > 0)
        return pa.table({"node": node[hit], "links": links[hit], "root": node[label[hit]]})

    return run


def _cells(once: DataFrame, widths: dict[int, int], scratch: Scratch, threshold: float, cell_rows: int, max_cells: int, recall: float, seed: int) -> DataFrame:
    """``once`` (node, weight, v, h, width) -> a row for each vector and part of
    a cell that it is in: node, weight, v, cells, cell, parts, part."""
    models, first = {}, 0
    for w, n in sorted(widths.items()):
        k = min(max_cells, n // cell_rows)
        if k < 2:
            continue
        sample = once.where(F.col("width") == w).orderBy(F.xxhash64(F.lit(seed), "h"), "node").limit(SAMPLE_PER_CELL * k).select("v")
        got = sample.repartition(1).mapInArrow(_fit_rows(_fit(k, threshold, recall, seed)), "width int, centres array<double>, probes int").first()
        models[w] = (first, np.array(got["centres"]).reshape(-1, w), got["probes"])
        first += k
    cells = once.select("node", "weight", "v", "width").mapInArrow(_assign(models), "node long, weight long, v array<double>, cells array<long>")
    cells = scratch.keep(cells, "cells").withColumn("cell", F.explode("cells"))
    # at most max_cells rows for each width with a model
    load = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 64 * cell_rows).collect()
    big = [(r["cell"], min(max_cells, r["n"] // cell_rows), r["n"]) for r in load]
    whole = cells.withColumn("parts", F.array(F.lit(0).cast("long")))
    if big:
        spark, fit = once.sparkSession, lambda k: _fit(k, threshold, recall, seed + 1)
        k_of = spark.createDataFrame([(c, k, -(-n // 16384), min(1.0, SAMPLE_PER_CELL * k / n)) for c, k, n in big], "cell long, k int, salts long, share double")
        dealt = scratch.keep(cells.join(F.broadcast(k_of), "cell"), "dealt")
        # about as many rows of each cell as its centres need, by a hash of the row
        share = F.pmod(F.xxhash64(F.lit(seed), "node", "cell"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
        model = dealt.where(share).groupBy("cell", "k").applyInArrow(lambda key, t: _with_cell(key, fit(key[1].as_py())(_matrix(t.column("v").combine_chunks()))), "cell long, width int, centres array<double>, probes int")
        model = scratch.keep(model, "models")
        salted = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
        spread = model.join(F.broadcast(k_of), "cell").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1L)"))).drop("k", "salts", "share")
        parts = salted.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(_assign_parts, "node long, weight long, v array<double>, cells array<long>, cell long, parts array<long>")
        whole = whole.join(F.broadcast(k_of.select("cell")), "cell", "left_anti").select(*parts.columns).unionByName(scratch.keep(parts, "parts"))
    return whole.withColumn("part", F.explode("parts"))


def _with_cell(key, t: pa.Table) -> pa.Table:
    return t.add_column(0, "cell", pa.array([key[0].as_py()], pa.int64()))


def near_duplicates(rows: DataFrame, scratch: Scratch, threshold: float = 0.9, cell_rows: int = 512, max_cells: int = 2048, recall: float = 0.97, block_rows: int = 2048, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id and kept.

    Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing and are kept; vectors of different widths
    don't link. Lengths are taken after division by the largest component, so
    none overflows. Repeated rows link with each other; those that share the
    smallest id of a component are all marked kept. Other columns are not looked
    at. An empty table gives no rows. A sample bounds what centres are fitted
    on; all vectors are assigned and compared.
    """
    own = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    good = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = own.withColumn("m", F.when(good, F.array_max(F.transform("e", F.abs))))
    own = own.withColumn("e", F.when(F.col("m") > 0, F.transform("e", lambda x: x / F.col("m"))))
    own = own.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))).withColumn("v", F.transform("e", lambda x: x / F.col("norm") + 0.0))
    own = scratch.keep(own.select("vec_id", "v", F.xxhash64("v").alias("h")), "unit")
    # one row per different vector; its node number is made once and stored
    once = own.where(F.col("v").isNotNull()).groupBy("h", "v").agg(F.count("*").alias("weight"))
    once = scratch.keep(once.withColumn("width", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    widths = {r["width"]: r["n"] for r in once.groupBy("width").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * cell_rows).collect()}
    cells = _cells(once, widths, scratch, threshold, cell_rows, max_cells, recall, seed)
    load = cells.groupBy("cell", "part").agg(F.ceil(F.count("*") / block_rows).alias("blocks")).where("blocks > 1")
    dealt = cells.join(load, ["cell", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "cell", "part"), F.col("blocks")))
    names = ["node", "weight", "v", "cells", "parts", "cell", "part", "block"]
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)"))).select(*names, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    found = scratch.keep(dealt.groupBy("cell", "part", "bi", "bj").applyInArrow(_compare(threshold), "node long, links long, root long"), "found")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    at = once.select("h", "v", "weight", "node").join(links, "node", "left").join(roots, "node", "left")
    at = at.select("h", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    own = own.join(at, (own["h"] == at["h"]) & (own["v"] == at["v"]), "left").select("vec_id", "n_links", "root")
    own = scratch.keep(own, "labelled")
    low = scratch.keep(own.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("vec_id").alias("low")), "lows")
    out = own.join(low, "root", "left")
    comp = F.coalesce("low", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
