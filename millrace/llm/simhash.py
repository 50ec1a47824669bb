"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are made per document, reduced to distinct values, and dealt out
by shared blocks: two fingerprints that differ in at most ``max_bits`` bits
agree in one of ``max_bits + 1`` blocks. Inside a block group the values are
sorted by Gray rank, so that neighbours share long bit patterns. Sixteen rows
form a node that stores the bits its members share (mask and pattern), sixteen
nodes a node above it, and so on. A search walks down, adding the differences in
the bits that a node fixes beyond its parent, and drops a whole node once the
sum exceeds ``max_bits``.

Links are not written out as pairs: each group reports a spanning star for each
of its local components, and the stars are joined into global components.

Bounds: a group of more than ``group_rows`` distinct fingerprints is dealt anew
by blocks of its remaining bits, and one that is still larger is compared in
chunks, each pair of chunks in a task of its own; no link is lost either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.llm.components import components
from millrace.llm.scratch import Scratch, first_of, named, parts, renamed, row_key

FAN = 16
CHUNK = 1 << 15


# ---- fingerprints ---------------------------------------------------------


def majority(hashes: np.ndarray) -> int:
    """Signed fingerprint of 64-bit hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].astype(">u8", copy=False).view(np.uint8)).reshape(-1, 64)
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the ``size``-word shingles of a text; 0 for a
    text that is null or has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    ends = starts + lens
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_digest
    got = b"".join([digest(line[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())])
    return majority(np.frombuffer(got, ">u8"))


def with_fingerprint(df: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """``df`` (id columns and ``text``) -> the other columns plus ``fp`` long."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), size) for t in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fps], names=[*keep, "fp"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{fields + ', ' if fields else ''}fp bigint")


# ---- the index within groups ----------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit value in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchy over fingerprints sorted by (group, Gray rank). Nodes never
    straddle groups; ``levels[0]`` are the rows themselves."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp, ones = fp, np.uint64(0xFFFFFFFFFFFFFFFF)
        first = np.zeros(len(fp), np.int64)
        g, lo, hi = group, fp, fp
        self.levels = [{"mask": np.full(len(fp), ones), "pat": fp, "last": np.arange(len(fp)), "first": first, "end": first}]
        while True:
            cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            sizes = np.diff(np.concatenate((cut, [len(g)])))
            if len(self.levels) > 1 and sizes.max(initial=0) <= 1:
                break
            at = np.arange(len(g)) - np.repeat(cut, sizes)
            start = np.flatnonzero(at % FAN == 0)
            end = np.concatenate((start[1:], [len(g)]))
            lo, hi = np.bitwise_and.reduceat(lo, start), np.bitwise_or.reduceat(hi, start)
            below = self.levels[-1]
            mask = ~(lo ^ hi)
            self.levels.append({"mask": mask, "pat": lo & mask, "first": start, "end": end, "last": below["last"][end - 1]})
            below["extra"] = below["mask"] & ~np.repeat(mask, end - start)
            g = g[start]
        self.levels[-1]["extra"] = self.levels[-1]["mask"]
        self.root_group = g

    def pairs(self, rows: np.ndarray, root: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, of one group within ``most`` bits, i in rows."""
        q, node, acc = rows, root, np.zeros(len(rows), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            lv = self.levels[k]
            acc = acc + np.bitwise_count((self.fp[q] ^ lv["pat"][node]) & lv["extra"][node])
            ok = (acc <= most) & (lv["last"][node] > q)
            q, node, acc = q[ok], node[ok], acc[ok]
            if not k:
                return q, node
            n = lv["end"][node] - lv["first"][node]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, acc, node = np.repeat(q, n), np.repeat(acc, n), np.repeat(lv["first"][node], n) + at
        raise AssertionError


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; labels are smallest row numbers."""
    while len(a):
        la, lb = label[a], label[b]
        ne = la != lb
        if not ne.any():
            break
        a, b, la, lb = a[ne], b[ne], la[ne], lb[ne]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def local_stars(group: np.ndarray, fp: np.ndarray, most: int, work: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (member, root) of a star for each local component; rows must
    be sorted by (group, Gray rank). ``work`` bounds the pairs held at once."""
    label = np.arange(len(fp))
    if not len(fp):
        return label, label
    index = GrayIndex(group, fp)
    _, inverse, counts = np.unique(group, return_inverse=True, return_counts=True)
    _, first = np.unique(group, return_index=True)
    root = np.argsort(np.argsort(first))  # roots are in order of appearance
    rows = np.flatnonzero(counts[inverse] > 1)
    load = np.cumsum(counts[inverse][rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + work)))
        take = rows[at:to]
        i, j = index.pairs(take, root[inverse[take]], most)
        label = union(label, i, j)
        at = to
    member = np.flatnonzero(label != np.arange(len(fp)))
    return member, label[member]


def _star_rows(most: int, hold: int = 1 << 16):
    """Batches sorted by (key, rank) -> edges between fingerprints."""

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        m, r = local_stars(key, fp.view(np.uint64), most)
        return pa.RecordBatch.from_arrays([pa.array(fp[m]), pa.array(fp[r])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, n = [], [], 0
        for b in batches:
            keys.append(b.column("key").to_numpy())
            fps.append(b.column("fp").to_numpy())
            n += b.num_rows
            if n >= hold:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                to = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if to:
                    yield solve(key[:to], fp[:to])
                keys, fps, n = [key[to:]], [fp[to:]], len(key) - to
        if n:
            yield solve(np.concatenate(keys), np.concatenate(fps))

    return run


# ---- distribution ---------------------------------------------------------


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that cover ``bits`` bits from the top."""
    cuts = [bits * i // n for i in range(n + 1)]
    return [(bits - cuts[i + 1], cuts[i + 1] - cuts[i]) for i in range(n)]


def _gray_sql():
    x = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def hamming_edges(distinct: DataFrame, scratch: Scratch, max_bits: int = 3, group_rows: int = 4096) -> DataFrame:
    """Distinct ``fp`` -> edges (a, b) whose components are those of the graph
    of all pairs within ``max_bits`` bits."""
    spark, n = distinct.sparkSession, max_bits + 1
    cut = _blocks(64, n)
    value = lambda shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)
    dealt = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), value(s, w).alias("v")) for i, (s, w) in enumerate(cut)))).alias("k")).select("fp", F.col("k.i").alias("i"), F.col("k.v").alias("v"))
    # at most n * 2^16 keys, whatever the input
    counts = dealt.groupBy("i", "v").agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    dealt = dealt.join(F.broadcast(counts), ["i", "v"], "left")
    small = dealt.where(F.col("n").isNull()).select(F.col("i").cast("long").bitwiseXOR(F.shiftleft(F.col("v"), 3)).alias("key"), "fp")
    # the large ones again, by blocks of the bits that are left
    again = []
    for i, (s, w) in enumerate(cut):
        rest = [(a, b) for j, (p, q) in enumerate(cut) if j != i for a, b in _split(p, q, n, n - 1)]
        for j in range(n):
            again.append(F.when(F.col("i") == i, F.xxhash64(F.lit(i), "v", F.lit(j), *(value(a, b) for a, b in rest[j::n]))))
    deep = dealt.where(F.col("n").isNotNull()).select("fp", F.explode(F.array(*(F.coalesce(*again[j::n]) for j in range(n)))).alias("key"))
    size = deep.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    deep = deep.join(size, "key", "left").select("fp", "key", F.coalesce(F.ceil(F.col("n") / group_rows), F.lit(1)).alias("k"))
    c = F.pmod(F.xxhash64("fp"), F.col("k"))
    deep = deep.select("fp", "key", "k", c.alias("c")).select("fp", "key", "k", "c", F.explode(F.expr("sequence(0L, k - 1L)")).alias("d"))
    pair = F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")))
    rows = small.unionByName(deep.select(pair.alias("key"), "fp"))
    rows = rows.repartition(parts(spark), "key").withColumn("gray", _gray_sql()).sortWithinPartitions("key", "gray").select("key", "fp")
    return rows.mapInArrow(_star_rows(max_bits), "a bigint, b bigint")


def _split(shift: int, width: int, n: int, others: int) -> list[tuple[int, int]]:
    """A block cut into n pieces, top first; piece j of every remaining block
    goes to the j-th key of the second deal."""
    return [(shift + s, w) for s, w in _blocks(width, n)]


def near_duplicates(docs: DataFrame, scratch: Scratch, max_bits: int = 3, size: int = 3, group_rows: int = 4096, doc_id: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, ``extra`` columns, fp and component_id,
    the smallest doc_id reachable over links of at most ``max_bits`` bits.

    Null and wordless texts have fingerprint 0 and link like others; repeated
    rows each give a row; a null doc_id takes part and never names a component
    unless the component has no other id; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *extra)
    fps = scratch.keep(with_fingerprint(own, "text", size), "fingerprints")
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(hamming_edges(distinct, scratch, max_bits, group_rows), scratch)
    label = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    best = label.groupBy("root").agg(F.min("low").alias("component_id"))
    label = scratch.keep(label.join(best, "root").select("fp", "component_id", "root"), "labels")
    return fps.join(label, "fp").select("doc_id", *extra, "fp", "component_id", "root")


def hex64(col):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def links(nodes: DataFrame, scratch: Scratch, max_bits: int = 3, group_rows: int = 4096) -> DataFrame:
    """(node, fp) -> pairs (a, b) of nodes, at most two for each: stars of equal
    fingerprints, and those of the index's local components."""
    first = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("node")), "firsts")
    same = nodes.join(first.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    stars = scratch.keep(hamming_edges(first.select("fp"), scratch, max_bits, group_rows).distinct(), "stars")
    for side in "ab":
        stars = stars.join(first.select(F.col("fp").alias(side), F.col("node").alias(f"n{side}")), side)
    return same.unionByName(stars.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, max_bits: int = 3, size: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one row of each component kept: that of the
    smallest doc_id (ties: smallest row key; nulls last). Of rows equal in id
    and text one stays. All columns are kept, whatever their names; null and
    wordless texts are one text; an empty table gives no rows.

    Texts link at ``max_bits`` bits or fewer. With a ``similarity`` they link at
    that Jaccard similarity of their shingles instead: the fingerprints propose,
    the shingles decide, and an exact search (``shingles``) covers the pairs
    whose fingerprints differ in more bits.
    """
    if similarity is not None:
        return shingles.drop_similar(docs, scratch, lambda nodes: links(nodes, scratch, max_bits), lambda found: majority(found.view(np.uint64)), similarity, size)
    plain, back = renamed(docs)
    own = plain.select(F.col(back["doc_id"]).alias("doc_id"), F.col(back["text"]).alias("text")).withColumn("row", row_key())
    found = near_duplicates(own, scratch, max_bits, size, extra=("row",))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("k"))).alias("m")
    keep = scratch.keep(found.groupBy("root").agg(best).select(F.col("m.k").alias("row")), "kept")
    return first_of(plain.withColumn("row", row_key(back["doc_id"], back["text"])).join(keep, "row", "left_semi"), "row").select(*named(back))
