"""Exact top-k inner products by MaxScore over an inverted index.

Components are terms: a shard of the rows keeps, for each term, the postings of
rows whose component is not zero, with their weights and the largest and
smallest of these. A query's terms are ordered by the most that they can add to
a score. Once the terms that are left could not lift a row to the query's
threshold by themselves they are non-essential: only the postings of the terms
before them, the essential ones, are traversed, and of the rows found there the
other components are probed one by one while a row can still reach the
threshold. Bounds are strict, so rows that tie with the threshold stay.

Thresholds start from rows of large weights in a query's strongest terms and,
after a first wave over a sixteenth of the shards, from the scores found there.
Shards and query blocks have a fixed size; each pair of them is a task, and each
task hands on at most k rows of a query to the merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

CHAMPIONS = 32  #: rows of largest weight, of a term, that a first threshold is taken from
STRONGEST = 8  #: terms of a query whose champions are scored
HITS = "qnode long, query_id long, node long, vec_id long, score long"


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows as integers; shorter vectors end in zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(col.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None] < size[:, None]] = col.flatten().to_numpy()
    return out


class Index:
    """The postings of a shard, whose rows come in the order that settles ties."""

    def __init__(self, x: np.ndarray):
        self.x = np.asfortranarray(x)
        self.postings, self.champions = [], []
        for w in self.x.T:
            docs = np.flatnonzero(w)
            self.postings.append((slice(None), w) if len(docs) == len(w) else (docs, w[docs]))
            order = np.argsort(w, kind="stable")
            self.champions.append((order[:CHAMPIONS], order[-CHAMPIONS:]))
        self.high = x.max(axis=0, initial=0)
        self.low = x.min(axis=0, initial=0)

    def best(self, q: np.ndarray, k: int, threshold: int | None = None, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best rows but ``own``, best first, of those
        that reach ``threshold``; ties to the earlier row."""
        n = len(self.x)
        most = np.maximum(q * self.high, q * self.low)
        terms = np.flatnonzero(q)
        terms = terms[np.argsort(-most[terms], kind="stable")]
        # what the terms from each place on can add at most
        rest = np.append(np.cumsum(most[terms][::-1])[::-1], 0)
        strong = [self.champions[t][int(q[t] > 0)] for t in terms[:STRONGEST]]
        if strong:
            some = np.unique(np.concatenate(strong))
            some = some[some != own]
            if len(some) >= k:
                reached = int(np.partition(self.x[some] @ q, len(some) - k)[len(some) - k])
                threshold = reached if threshold is None else max(threshold, reached)
        if threshold is None:
            threshold = np.iinfo(np.int64).min
        weak = np.flatnonzero(rest < threshold)
        essential = int(weak[0]) if len(weak) else len(terms)
        score = np.zeros(n, np.int64)
        # rows without an essential term are out only if the others can't do alone
        seen = np.full(n, not len(weak))
        for t in terms[:essential]:
            docs, w = self.postings[t]
            score[docs] += q[t] * w
            seen[docs] = True
        if own >= 0:
            seen[own] = False
        rows = np.flatnonzero(seen & (score >= threshold - rest[essential]))
        found = score[rows]
        for i in range(essential, len(terms)):
            found = found + q[terms[i]] * self.x[rows, terms[i]]
            ok = found >= threshold - rest[i + 1]
            rows, found = rows[ok], found[ok]
        top = np.lexsort((rows, -found))[:k]
        return rows[top], found[top]


def _task(k: int):
    """A shard's rows and a block of queries -> the best rows of each query."""

    def run(t: pa.Table) -> pa.Table:
        is_query = t.column("asks").to_numpy()
        rows, asks = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
        rows = rows.sort_by([("vec_id", "ascending"), ("node", "ascending")])
        x, q = _matrix(rows.column("v")), _matrix(asks.column("v"))
        width = max(x.shape[1], q.shape[1])
        x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
        if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * (width + 1) >= 2.0**62:
            raise OverflowError("scores of these vectors do not fit 64 bits")
        index, node = Index(x), rows.column("node").to_numpy()
        order = np.argsort(node)
        qnode = asks.column("node").to_numpy()
        at = np.searchsorted(node, qnode, sorter=order)
        own = np.where(at < len(node), order[np.minimum(at, len(node) - 1)], -1) if len(node) else np.full(len(qnode), -1)
        own = np.where((own >= 0) & (node[own] == qnode), own, -1) if len(node) else own
        limits = asks.column("threshold").to_pylist()
        got = [index.best(v, k, low, int(o)) for v, low, o in zip(q, limits, own)] if len(node) else []
        hits = np.concatenate([r for r, _ in got]) if got else np.zeros(0, np.int64)
        ask = np.repeat(np.arange(len(got)), [len(r) for r, _ in got])
        take = pa.array(hits)
        return pa.table({"qnode": qnode[ask], "query_id": asks.column("vec_id").take(pa.array(ask)), "node": rows.column("node").take(take), "vec_id": rows.column("vec_id").take(take), "score": np.concatenate([s for _, s in got]) if got else np.zeros(0, np.int64)})

    return run


def search(rows: DataFrame, scratch: Scratch, asks: Column, k: int = 20, scale: int = 64, shard_rows: int = 8192, block_rows: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row that meets ``asks`` its ``k`` best others (all, if fewer) by the
    inner product of the integers floor(scale * component): query_id, rank from
    1, vec_id and score; ties to the smaller vec_id (null ids last).

    Vectors that are null or hold null or non-finite components take no part.
    A shorter vector has zeros where it ends, an empty one scores 0. Repeated
    rows are rows of their own: a query leaves out itself alone, and an id that
    asks twice is answered twice. A null ``asks`` does not ask. Scores that can't
    fit 64 bits are an error. Other columns are not looked at; an empty table or
    one without queries gives no rows.
    """
    e = F.col(f"`{embedding}`").cast("array<double>")
    own = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), e.alias("e"), F.coalesce(asks, F.lit(False)).alias("asks"))
    own = own.where(F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    own = own.select("vec_id", "asks", F.transform("e", lambda x: F.floor(x * scale)).alias("v"), F.monotonically_increasing_id().alias("node"))
    own = scratch.keep(own, "integers")
    n, n_asks = own.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asks // block_rows))
    deal = lambda name, parts: F.pmod(F.xxhash64(F.lit(name), "node"), F.lit(parts)).cast("int")
    names = ["shard", "block", "asks", "node", "vec_id", "v", "threshold"]
    every = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
    queries = own.where("asks").withColumn("block", deal("block", blocks))
    held = own.withColumn("asks", F.lit(False)).withColumn("threshold", F.lit(None).cast("long")).withColumn("shard", deal("shard", shards))

    def wave(lo: int, hi: int, queries: DataFrame) -> DataFrame:
        left = queries.withColumn("shard", every(lo, hi)).select(*names)
        right = held.where(F.col("shard").between(lo, hi - 1)).withColumn("block", every(0, blocks)).select(*names)
        found = left.unionByName(right).groupBy("shard", "block").applyInArrow(_task(k), HITS)
        return found

    first = max(1, shards // 16)
    best = scratch.keep(_merged(wave(0, first, queries.withColumn("threshold", F.lit(None).cast("long"))), k), "first")
    if first < shards:
        reached = best.groupBy("qnode").agg(F.when(F.count("*") >= k, F.min("score")).alias("threshold"))
        queries = queries.join(reached, queries["node"] == reached["qnode"], "left").drop("qnode")
        later = scratch.keep(wave(first, shards, queries), "later")
        best = _merged(best.drop("rank").unionByName(later), k)
    return best.select("query_id", "rank", "vec_id", "score")


def _merged(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qnode").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "node")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
