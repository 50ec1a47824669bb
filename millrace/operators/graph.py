"""Undirected graphs and label-propagation communities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.validate import positive_int
from millrace.plans.lineage import cut, drop
from millrace.plans.ranks import positions


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge, once each, without self-loops."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def vertex_counts(vertices: DataFrame, vid: str = "id") -> DataFrame:
    """One row: n, n_distinct and is_unique."""
    return vertices.agg(F.count("*").alias("n"), F.countDistinct(vid).alias("n_distinct")).withColumn("is_unique", F.col("n") == F.col("n_distinct"))


def dangling(vertices: DataFrame, edges: DataFrame, vid: str = "id") -> DataFrame:
    """Endpoints of edges that are no vertex."""
    ends = edges.select(F.col("src").alias(vid)).unionByName(edges.select(F.col("dst").alias(vid))).distinct()
    return ends.join(vertices.select(vid), vid, "left_anti")


def neighbour_vote(edges: DataFrame, labels: DataFrame, seed: int | None = None) -> DataFrame:
    """(id, label): each vertex's commonest neighbour label. Ties go to the
    smallest label, or with a seed to a hash of (seed, vertex, label)."""
    hist = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    tie = F.col("label") if seed is None else F.xxhash64(F.lit(seed), "src", "label")
    return hist.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), tie, F.col("label"))).alias("label"))


def compress(labels: DataFrame) -> DataFrame:
    """Numeric labels renumbered from 0 in their order, over the distinct labels alone."""
    small = positions(labels.select("label").distinct(), F.col("label"), name="community")
    return labels.join(small, "label").select("id", "community")


def communities(labels: DataFrame) -> DataFrame:
    """(label, members): a community is one value here; ``labels`` itself is the
    long form, for communities too large for a row."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_set("id")).alias("members"))


def changed_fraction(before: DataFrame, after: DataFrame) -> float:
    """Share of the vertices (id, label) whose label changed; 0 for none."""
    both = before.select("id", F.col("label").alias("old")).join(after.select("id", "label"), "id")
    return both.agg(F.coalesce(F.avg((F.col("label") != F.col("old")).cast("double")), F.lit(0.0))).first()[0]


#: Colours fit the bits of a long.
MAX_COLORS = 63


def color_classes(vertices: DataFrame, links: DataFrame, seed: int = 0) -> DataFrame:
    """(id, wave): a colour for each vertex (id), other than its neighbours' by
    ``links`` (both directions of each edge).

    Of the vertices without a colour those go next whose random priority is
    above that of all such neighbours; each takes the lowest colour that none of
    its neighbours has, so the work of a round is all at once. ValueError beyond
    ``MAX_COLORS`` colours, which only graphs with very dense parts need."""
    # priorities are distinct, for the id settles equal hashes
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("i"))
    done = cut(vertices.select("id").limit(0).withColumn("wave", F.lit(0)))
    left = cut(vertices.select("id"))
    near = cut(links.select("src", "dst"))
    while not left.isEmpty():
        top = near.groupBy(F.col("src").alias("id")).agg(F.max(rank("dst")).alias("top"))
        own = cut(left.join(top, "id", "left").where(F.col("top").isNull() | (rank("id") > F.col("top"))).select("id"))
        taken = links.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(done.select(F.col("id").alias("dst"), "wave"), "dst").groupBy(F.col("src").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, wave)")).alias("bits"))
        # the lowest bit that is not set
        free = F.coalesce(F.col("bits"), F.lit(0).cast("long"))
        free = F.bit_count(F.bitwise_not(free).bitwiseAND(free + 1) - 1)
        new = cut(own.join(taken, "id", "left").select("id", free.cast("int").alias("wave")))
        if new.where(F.col("wave") >= MAX_COLORS).limit(1).count():
            raise ValueError(f"the graph needs more than {MAX_COLORS} colours")
        done, old = cut(done.unionByName(new)), (done, left, near, own, new)
        left = cut(left.join(new, "id", "left_anti"))
        near = cut(near.join(new.select(F.col("id").alias("src")), "src", "left_anti").join(new.select(F.col("id").alias("dst")), "dst", "left_anti"))
        drop(*old)
    return done


@dataclass(frozen=True)
class LabelPropagation:
    """Communities by label propagation, wave after wave: the vertices of a wave
    vote at once, and later waves see their labels. Only vertices next to a
    change vote again. Ends when the changed share of all vertices is at most
    ``epsilon``, or after ``max_iters`` rounds.

    With ``order`` "colors" neighbours are never in one wave, so the result is
    that of a loop over the vertices one after the other, by (wave, id) in any
    order within a wave. With "waves" a hash deals vertices into ``waves`` waves;
    that is fewer, whatever the graph, but neighbours in one wave vote at once.

    With colours ``max_iters`` may be None. That ends: a change gains ends of
    edges with equal labels, or, as many, a label that goes first among ties."""

    max_iters: int | None = 50
    epsilon: float = 0.0
    waves: int = 4
    seed: int = 0
    order: str = "waves"

    def __post_init__(self):
        if self.max_iters is not None:
            positive_int("max_iters", self.max_iters)
        elif self.order != "colors":
            raise ValueError("only the order of colours ends by itself, so that max_iters may be None")
        positive_int("waves", self.waves)
        if not 0 <= self.epsilon <= 1:
            raise ValueError("epsilon must be between 0 and 1")
        if self.order not in ("waves", "colors"):
            raise ValueError(f"unknown order {self.order!r}")

    def run(self, vertices: DataFrame, edges: DataFrame, wave: Column | None = None, ties: str = "random") -> DataFrame:
        """``vertices`` (id, pos) and ``edges`` (src, dst) -> (id, label); an
        isolated vertex keeps its position as label. ``wave`` may replace the
        order; ``ties`` go to a hash of seed, vertex and label (``random``) or to
        the ``smallest`` label. ValueError for repeated vertices and for edges to
        vertices that are not there."""
        return self.trace(vertices, edges, wave, ties)[0].select("id", "label")

    def trace(self, vertices: DataFrame, edges: DataFrame, wave: Column | None = None, ties: str = "random") -> tuple[DataFrame, list[dict]]:
        """(id, label, wave), and for each round how many vertices voted and changed."""
        if ties not in ("random", "smallest"):
            raise ValueError(f"unknown ties {ties!r}")
        if self.max_iters is None and wave is not None:
            raise ValueError("max_iters is needed for a given order")
        n, _, unique = vertex_counts(vertices).first()
        if not unique:
            raise ValueError("vertices must be unique")
        if dangling(vertices, edges).limit(1).count():
            raise ValueError("an edge ends in an unknown vertex")
        links = cut(undirected(edges))
        own = vertices.select("id", F.col("pos").cast("long").alias("label"))
        if wave is None and self.order == "colors":
            labels = own.join(color_classes(vertices, links, self.seed), "id")
        else:
            labels = own.withColumn("wave", F.pmod(F.xxhash64(F.lit(self.seed), "id"), F.lit(self.waves)) if wave is None else wave)
        labels = cut(labels.select("id", "label", F.col("wave").cast("int").alias("wave"), F.lit(True).alias("awake")))
        waves = sorted(r[0] for r in labels.select("wave").distinct().collect())
        seed, rounds = self.seed if ties == "random" else None, []
        while n and (self.max_iters is None or len(rounds) < self.max_iters):
            voted = changed = 0
            for k in waves:
                asks = labels.where((F.col("wave") == k) & F.col("awake")).select(F.col("id").alias("src"))
                here = asks.count()
                if not here:
                    continue
                votes = neighbour_vote(links.join(asks, "src", "left_semi"), labels, seed).withColumnRenamed("label", "new")
                moved = cut(labels.join(votes, "id").where(F.col("new") != F.col("label")).select("id", "new"))
                # who is next to a change votes again; the wave itself rests till then
                near = links.join(moved.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(True).alias("near")).distinct()
                awake = F.coalesce("near", F.col("awake") & (F.col("wave") != k))
                labels, before = cut(labels.join(moved, "id", "left").join(near, "id", "left").select("id", F.coalesce("new", "label").alias("label"), "wave", awake.alias("awake"))), labels
                voted, changed = voted + here, changed + moved.count()
                drop(before, moved)
            rounds.append({"voted": voted, "changed": changed})
            if changed / n <= self.epsilon:
                break
        return labels.select("id", "label", "wave"), rounds
