"""Exact removal of strings that occur more than once.

A depth-limited most-significant-digit radix sort over the windows of
``threshold`` symbols (bytes, or words) of all documents. Every pass splits
groups of windows by a further digit of them; windows alone in their group drop
out, and groups that stay together over the whole depth are exactly the
repeated windows.

* First digit, an anchor string of half the depth. Of any ``threshold`` symbols
  the anchor is chosen by content alone (the least hashed string in the window,
  rightmost on ties), so equal windows have equal anchors at equal places, and
  one row stands for all windows that share an anchor. Anchors that occur once
  in the corpus end here.
* Occurrences of an anchor that are equal in all that its windows can touch
  (128-bit digests) are repeated in full and are one member from here on.
* The other members of a group are ordered in a task: symbol by symbol through
  the anchor, and outwards from it through both sides. Classes are refined by
  the symbols themselves, so a match is a match of symbols and not of hashes.
* A group of more members than three tasks hold on average (``group_rows``) is
  dealt out again before that, by the next digits: of the windows that start 0..s symbols before an anchor,
  the nearer half shares s/2 symbols behind it and the farther half s/2 before
  it. Halves are digested (128 bits), members equal in all that a half can touch
  become one, singles drop out, and what is left goes to a task or is halved
  again. After log2(s) passes a half is one window.

Whole texts are moved once, those with candidates twice more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch, parts

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i]), 7) for i in range(256)), ">u8").astype(np.uint64)
CHUNK = 1 << 18
MOST_ROWS = 20_000  #: members of a group that one task may order
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & _M
    return np.multiply.accumulate(out)


_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(_BASE, 2 * CHUNK), _powers(_INVERSE, 2 * CHUNK)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _word_hashes(arr: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, first bytes) of the words of texts that begin at ``starts``
    of a byte array, all of a part at once."""
    if not len(arr):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[arr]
    edge = np.zeros(len(arr) + 1, bool)
    edge[starts], edge[-1] = True, True
    edge[1:] |= space  # a word may begin behind these, and end before the next
    ends = edge[1:].copy()
    ends[:-1] |= space[1:]
    first, last = np.flatnonzero(edge[:-1] & ~space), np.flatnonzero(ends & ~space) + 1
    out, i = [], 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + CHUNK, "right")))
        part, f, e = arr[first[i] : last[j - 1]], first[i:j] - first[i], last[i:j] - first[i]
        n = len(part)
        up, down = (_UP[:n], _DOWN) if n < len(_UP) else (_powers(_BASE, n), _powers(_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * up, out=sums[1:])
        h = (sums[e] - sums[f]) * down[f]
        h ^= h >> _U(32)
        h *= _U(0x9FB21C651E98DF25)
        out.append((h ^ (h >> _U(28))) + (e - f).astype(np.uint64))
        i = j
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), first


def symbols(text: str | None, unit: str) -> np.ndarray:
    """The bytes of a text, or the 64-bit hashes of its words."""
    arr = np.frombuffer(_bytes(text), np.uint8)
    return arr if unit == "byte" else _word_hashes(arr, np.zeros(1, np.int64))[0]


def joined_symbols(texts: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts of a column, where each begins and the last ends)."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    arr = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if unit == "byte":
        return arr, at
    h, first = _word_hashes(arr, at[:-1][at[:-1] < len(arr)])
    return h, np.searchsorted(first, at)


class Depth:
    """Lengths of the digits of one threshold, and powers for its hashes."""

    def __init__(self, threshold: int, unit: str = "byte"):
        if threshold < 2 or unit not in ("byte", "word"):
            raise ValueError("threshold must be at least 2, unit byte or word")
        self.t, self.unit = threshold, unit
        self.item = 1 if unit == "byte" else 8
        self.k = threshold // 2
        self.side = threshold - self.k
        self.w = self.side + 1
        n = CHUNK + 2 * threshold
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def anchors(self, arr: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, 64-bit keys) of the anchors of all windows of the texts
        that begin at ``at`` (the last of it is the end) of an array of symbols."""
        found, n, ends = [], len(arr) - self.t + 1, at[1:]
        for s in range(0, max(n, 0), CHUNK):
            e = min(s + CHUNK, n)
            # windows end within their text
            lo, hi = np.searchsorted(ends, s, "right"), np.searchsorted(ends, e - 1, "right") + 1
            cuts = np.minimum(ends[lo:hi], e)
            last = np.repeat(ends[lo:hi], np.diff(np.concatenate(([s], cuts))))
            whole = np.arange(s, e) + self.t <= last
            if whole.any():
                found.append(s + self._chunk(arr[s : e + self.t - 1], whole))
        pos = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        data = arr.tobytes()
        return pos, np.array([xxhash.xxh64_intdigest(data[p : p + self.k * self.item]) for p in (pos * self.item).tolist()], np.uint64)

    def _chunk(self, arr: np.ndarray, whole: np.ndarray) -> np.ndarray:
        n, k, w = len(arr), self.k, self.w
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE[arr] if self.unit == "byte" else arr) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> _U(31)
        h *= _U(0xBF58476D1CE4E5B9)
        low = _U((1 << 20) - 1)
        m = len(h)
        h = (h & ~low) | (low - np.arange(m, dtype=np.uint64))  # the rightmost of equals is least
        rows = -(-m // w)
        grid = np.full(rows * w, _U(_M))
        grid[:m] = h
        grid = grid.reshape(rows, w)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(tail[: m - w + 1], head[w - 1 : m])
        pos = (low - (least & low)).astype(np.int64)[whole]
        return pos[np.concatenate(([True], pos[1:] != pos[:-1]))]


def _grouped(it: Iterator[pa.RecordBatch], rows: int = 20000) -> Iterator[pa.RecordBatch]:
    """Small batches put together, to spare per-batch costs."""
    hold, n = [], 0
    for b in it:
        hold.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(hold).combine_chunks().to_batches()
            hold, n = [], 0
    if hold:
        yield from pa.Table.from_batches(hold).combine_chunks().to_batches()


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    """Columns of values or arrays, typed by a Spark schema string."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


# ---- first digit: anchors and what surrounds them -------------------------------------

_ANCHOR = "rid binary, pos long, key long"
_OCC = "rid binary, doc_id long, pos long, first long, last long, key long, ctx binary"
_MEMBER = "key binary, ctx binary, alone boolean, lo long, hi long, left binary, gram binary, right binary"


def _anchor_rows(d: Depth):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr, at = joined_symbols(b.column("text"), d.unit)
            pos, keys = d.anchors(arr, at)
            if len(pos):
                row = np.searchsorted(at[:-1], pos, "right") - 1
                yield _batch(_ANCHOR, [b.column("rid").take(pa.array(row)), pos - at[row], keys.view(np.int64)])

    return rows


def _occurrences(d: Depth):
    """Active anchors of a document -> their key and their neighbourhood's digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, doc, text, at in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("at").to_pylist()):
                arr = symbols(text, d.unit)
                n, data, w = len(arr), arr.tobytes(), d.item
                out = []
                for p in at:
                    s, e = max(0, p - d.side), min(n, p + d.k + d.side)
                    if p + d.k > n or e - s < d.t:
                        continue
                    out.append((p, s, e, xxhash.xxh64_intdigest(data[p * w : (p + d.k) * w]), xxhash.xxh3_128_digest(b"%d:" % (p - s) + data[s * w : e * w])))
                if out:
                    p, s, e, key, ctx = zip(*out)
                    yield _batch(_OCC, [[rid] * len(p), [doc] * len(p), p, s, e, np.array(key, np.uint64).view(np.int64), ctx])

    return lambda batches: _grouped(rows(batches))


def _members(d: Depth):
    """One occurrence of each neighbourhood -> its symbols before the anchor
    (nearest first), in it and behind it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist()):
                arr = symbols(text, d.unit)
                p, n = [x["pos"] for x in at], len(at)
                yield _batch(
                    _MEMBER,
                    [[x["key"].to_bytes(8, "big", signed=True) for x in at], [x["ctx"] for x in at], [x["alone"] for x in at], [0] * n, [d.side] * n]
                    + [[arr[max(0, x - d.side) : x][::-1].tobytes() for x in p], [arr[x : x + d.k].tobytes() for x in p], [arr[x + d.k : x + d.k + d.side].tobytes() for x in p]],
                )

    return lambda batches: _grouped(rows(batches), 4000)


# ---- further digits, in a task --------------------------------------------------------


def _grid(values: list[bytes], item: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths in symbols, a row of small symbol codes for each value)."""
    width = max(item, -(-max(map(len, values), default=0) // item) * item)
    flat = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8 if item == 1 else np.uint64).reshape(len(values), -1)
    lens = -(-np.fromiter(map(len, values), np.int64, len(values)) // item)
    return lens, flat if item == 1 else np.unique(flat, return_inverse=True)[1].reshape(flat.shape)


def _ladder(values: list[bytes], item: int, start: np.ndarray, width: int) -> np.ndarray:
    """Classes of rows by their class at the start and their first 0..width
    symbols, a column for each; -1 for rows that are alone or too short. One
    radix pass a column, over the rows that are still in company."""
    lens, grid = _grid(values, item)
    out = np.full((len(values), width + 1), -1, np.int64)
    size = int(grid.max(initial=0)) + 1
    act, cls = np.flatnonzero(start >= 0), start[start >= 0]
    for j in range(width + 1):
        if j:
            long = lens[act] >= j
            act, cls = act[long], cls[long]
        if not len(act):
            break
        if j:
            cls = cls * size + grid[act, j - 1]
        _, cls, n = np.unique(cls, return_inverse=True, return_counts=True)
        act, cls = act[n[cls] > 1], cls[n[cls] > 1]
        out[act, j] = cls
    return out


def _resolve(d: Depth, hold: int = 4096):
    """Groups of members, sorted by key -> for those that occur once, how far
    their outermost windows that others share reach beyond the anchor."""

    def solve(t: pa.RecordBatch) -> pa.RecordBatch:
        n = t.num_rows
        _, start = np.unique(np.array(t.column("key").to_pylist(), object), return_inverse=True)
        lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
        gram = t.column("gram").to_pylist()
        start = _ladder(gram, 8, start, -(-d.k * d.item // 8))[:, -1]
        before = _ladder(t.column("left").to_pylist(), d.item, start, int(hi.max()))
        after = _ladder(t.column("right").to_pylist(), d.item, start, int(d.side - lo.min()))
        most, least = np.full(n, -1), np.full(n, d.side + 1)
        for a in range(int(lo.min()), int(hi.max()) + 1):
            x, y = before[:, a], after[:, d.side - a]
            rows = np.flatnonzero((x >= 0) & (y >= 0) & (lo <= a) & (a <= hi))
            if len(rows):
                _, cls, count = np.unique(x[rows] * n + y[rows], return_inverse=True, return_counts=True)
                rows = rows[count[cls] > 1]
                most[rows] = a
                least[rows] = np.minimum(least[rows], a)
        keep = np.flatnonzero((most >= 0) & t.column("alone").to_numpy(zero_copy_only=False))
        return _batch("ctx binary, left long, right long", [t.column("ctx").take(pa.array(keep)), most[keep], d.side - least[keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= hold:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = t.column("key").to_pylist()
                to = key.index(key[-1])  # the last group may go on
                if to:
                    yield solve(t.slice(0, to))
                held, n = [t.slice(to)], n - to
        if n:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


# ---- further digits, for groups that are too large for one task -------------------------

_HALF = _MEMBER + ", sub binary"


def _halves(d: Depth):
    """Members -> the two halves of their windows lo..hi: the digest of what all
    windows of the half share, and of all that they can touch."""
    h = xxhash.xxh3_128_digest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = d.item
        for b in batches:
            out = []
            for x in b.to_pylist():
                left, right = x["left"], x["right"]
                most, least = min(x["hi"], len(left) // w), max(x["lo"], d.side - len(right) // w)
                mid = (x["lo"] + x["hi"]) // 2
                for lo, hi in ((x["lo"], mid), (mid + 1, x["hi"])):
                    if lo <= hi and max(lo, least) <= min(hi, most):
                        key = h(b"%d:%d:" % (lo, hi) + left[: lo * w] + x["gram"] + right[: (d.side - hi) * w])
                        sub = h(b"%d:" % len(left[: hi * w]) + left[: hi * w] + right[: (d.side - lo) * w])
                        out.append((key, x["ctx"], x["alone"], lo, hi, left, x["gram"], right, sub))
            if out:
                yield _batch(_HALF, list(zip(*out)))

    return rows


def _dealt(members: DataFrame, scratch: Scratch, d: Depth, group_rows: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(found, small): windows settled by digests, and groups for ``_resolve``."""
    found, small, names = [], [], [x.split()[0] for x in _MEMBER.split(", ")]
    width = lambda c: F.floor(F.octet_length(c) / d.item)
    while True:
        half = scratch.keep(members.mapInArrow(_halves(d), _HALF), "halves")
        one = scratch.keep(half.groupBy("key", "sub").agg(F.count("*").alias("n"), F.min(F.struct(*names[1:])).alias("x")), "once")
        same = scratch.keep(one.where("n > 1").select("key", "sub"), "same")
        most = F.least("hi", width("left"))
        least = F.greatest("lo", d.side - width("right"))
        found.append(scratch.keep(half.where("alone").join(same, ["key", "sub"]).select("ctx", most.alias("left"), (d.side - least).alias("right")), "shared"))
        wanted = F.col("x.alone") & (F.col("n") == 1)
        sizes = scratch.keep(one.groupBy("key").agg(F.count("*").alias("m"), F.max(wanted).alias("any")).where("m > 1 and any").select("key", "m"), "sizes")
        rest = one.select("key", wanted.alias("w"), "x").join(sizes, "key").select("key", "x.ctx", F.col("w").alias("alone"), *(f"x.{c}" for c in names[3:]), "m")
        rest = scratch.keep(rest, "rest")
        scratch.drop(half, one, same, sizes)
        small.append(rest.where(F.col("m") <= group_rows).select(*names))
        members = rest.where(F.col("m") > group_rows).select(*names)
        if members.isEmpty():
            return found, small


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left, maximal removed runs)."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    left, at = [], 0
    for s, e in runs:
        left.append(data[at:s])
        at = e
    left.append(data[at:])
    return b"".join(left), [(s, e) for s, e in runs]


_CUT = "rid binary, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rid, text, spans in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "spans"))):
            left, runs = remove_spans(_bytes(text), [(x["s"], x["e"]) for x in spans])
            out.append((rid, sum(e - s for s, e in runs), len(runs), hashlib.sha256(left).hexdigest(), left))
        if out:
            yield _batch(_CUT, list(zip(*out)))


def repeated_spans(docs: DataFrame, scratch: Scratch, threshold: int = 400, unit: str = "byte", group_rows: int | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(candidate documents, spans, tables): ``docs`` has rid, doc_id and text; the
    first has those columns for documents with a repeated anchor, the second a
    row (rid, spans) for documents with a repeated window, in symbols; both read
    the tables, which may be dropped after them. Groups of
    more than ``group_rows`` members (by default three times what a task gets on
    average, within 512 and ``MOST_ROWS``) are split."""
    spark, d = docs.sparkSession, Depth(threshold, unit)
    anchors = scratch.keep(docs.select("rid", "text").mapInArrow(_anchor_rows(d), _ANCHOR), "anchors")
    # written, so that the join below reads two plain shuffles and a hot key can be split
    again = scratch.keep(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    at = anchors.join(again.hint("shuffle_hash"), "key").groupBy("rid").agg(F.collect_set("pos").alias("at"))
    work = scratch.keep(docs.select("rid", "doc_id", "text").join(at.hint("shuffle_hash"), "rid"), "candidates")
    scratch.drop(anchors, again)
    scratch.release()
    occ = scratch.keep(work.mapInArrow(_occurrences(d), _OCC), "occurrences")

    rep = F.min(F.struct("rid", "pos")).alias("rep")
    ctx = scratch.keep(occ.groupBy("key", "ctx").agg(F.count("*").alias("n"), rep), "neighbourhoods")
    mixed = scratch.keep(ctx.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("low")).where("m > 1 and low = 1").select("key", "m"), "mixed")
    if group_rows is None:
        total = mixed.agg(F.sum("m")).first()[0] or 0
        group_rows = min(MOST_ROWS, max(512, 3 * total // parts(spark)))
    need = ctx.join(mixed.hint("shuffle_hash"), "key").select(F.col("rep.rid").alias("rid"), "m", F.struct(F.col("rep.pos").alias("pos"), "key", "ctx", (F.col("n") == 1).alias("alone")).alias("x"))

    def members(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("rid").agg(F.collect_list("x").alias("at"))
        # repeated rows of documents share a rid; one of them is enough
        return work.select("rid", "text").join(lists, "rid").dropDuplicates(["rid"]).mapInArrow(_members(d), _MEMBER)

    small = members(need.where(F.col("m") <= group_rows))
    many = need.where(F.col("m") > group_rows)
    known = [ctx.where("n > 1").select("ctx", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))]
    if not many.isEmpty():
        found, rest = _dealt(members(many), scratch, d, group_rows)
        known += found
        for r in rest:
            small = small.unionByName(r)
    some = small.repartition(parts(spark), "key").sortWithinPartitions("key").mapInArrow(_resolve(d), "ctx binary, left long, right long")
    known.append(scratch.keep(some, "resolved"))
    scratch.drop(mixed)
    # occurrences of a neighbourhood that is found twice are repeated in full
    every = known[0]
    for k in known[1:]:
        every = every.unionByName(k)
    every = scratch.keep(every, "known")
    span = F.struct(F.coalesce(F.col("pos") - F.col("left"), F.col("first")).alias("s"), F.coalesce(F.col("pos") + d.k + F.col("right"), F.col("last")).alias("e"))
    spans = occ.select("rid", "pos", "first", "last", "ctx").join(every.hint("shuffle_hash"), "ctx").groupBy("rid").agg(F.collect_set(span).alias("spans"))
    return work, spans, [work, occ, ctx, every]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # two 64-bit hashes of the row that start apart: rows equal in both are repeated rows
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "doc_id", "text")), 16, "0")
    return own.withColumn("rid", F.unhex(F.concat(half(1), half(2))))


def drop_repeats(docs: DataFrame, scratch: Scratch, threshold: int = 400, group_rows: int | None = None, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False, passage_words: int = 0) -> DataFrame:
    """Remove every byte covered by a ``threshold``-byte string that starts
    anywhere else, in the same document or another.

    One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    (and kept, the bytes left, where ``keep_bytes``; null where nothing was
    removed). With ``passage_words`` also n_passage_words: the words covered by
    runs of that many words that start anywhere else too, whatever their bytes;
    a report, nothing is removed for it.

    A null text counts as empty; a document shorter than the threshold loses
    nothing; texts of any length are read whole, in parts; repeated rows repeat
    all their windows; a null doc_id is kept as null; other columns are not
    looked at; an empty table gives no rows.
    """
    own = _rows(docs, doc_id, text)
    work, spans, tables = repeated_spans(own, scratch, threshold, "byte", group_rows)
    cut = work.join(spans, "rid").select("rid", "doc_id", "text", "spans").dropDuplicates(["rid"]).mapInArrow(_cut, _CUT)
    cut = scratch.keep(cut.select("rid", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes), "cut")
    scratch.drop(*tables)
    out = own.select("doc_id", "rid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("sha")).join(cut, "rid", "left")
    found = ["n_removed", "n_spans"]
    if passage_words:
        scratch.release()
        _, runs, tables = repeated_spans(own, scratch, passage_words, "word", group_rows)
        covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")))
        words = scratch.keep(runs.select("rid", covered["n"].alias("n_passage_words")), "passages")
        scratch.drop(*tables)
        out = out.join(words, "rid", "left")
        found.append("n_passage_words")
    return out.select("doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in found), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *["kept"] * keep_bytes)
