"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins on node ids. A hub's edges
are never gathered into one group: only the minimum of a node's neighbours is
aggregated (partial minima first). Minima are written before they are joined
back, so that the join reads two plain shuffles and adaptive execution can split
a hub's share of it. The joins are merges, for a broadcast would pass links and
labels through the driver, round after round; it sees two counts per round. Rounds end once the edges are stars around
the smallest nodes, which one aggregation by node tells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import cut
from millrace.plans.lineage import drop as drop_cut


#: Edges for each task of a round. Later rounds often have few; their tables then have few files.
TASK_EDGES = 65_536


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes that keep ``edges`` from being stars around the
    smallest nodes: those with two smaller ones, or a smaller and a larger one."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, loose = ends.agg(F.sum("up"), F.count_if(F.col("up") + F.col("down") > 1)).first()
    return n or 0, loose


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut, drop: Callable[..., None] = drop_cut, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) -> one row (node, root) for each node that is
    linked to a smaller one; root is the smallest node of its component. Self-loops,
    nulls and repeated edges are ignored; no edges give an empty frame.
    ``keep`` cuts lineage, ``drop`` frees what it made."""
    cores = edges.sparkSession.sparkContext.defaultParallelism
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = keep(e)
    n, loose = _state(e)
    for _ in range(max_rounds):
        if not loose:
            break
        tasks = max(cores, -(-n // TASK_EDGES))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks))
        large = keep(both.join(low.hint("merge"), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks))
        drop(low)
        low = keep(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks))
        small = large.join(low.hint("merge"), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks))
        drop(large, low, e)
        e = small
        n, loose = _state(e)
    else:
        if loose:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
