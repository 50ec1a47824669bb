"""Phrase collocations by contiguous pattern growth over projected occurrences.

A phrase is frequent only if all its words and all its pairs of neighbours are.
Words, then pairs, are counted, and their hashes set bits in two maps of bounded
size, so that an occurrence is projected only where a frequent pair may begin,
and only as far as pairs stay frequent (a map may say yes too often, never no).
The pointer that a prefix gets is the stretch of up to five words from there;
equal stretches are one pointer with a weight, summed before they travel.

Each prefix is a task's group: its pointers are grown to the right depth first,
one word at a time, while they are frequent. A prefix with more pointers than
``group_rows`` is grown by one word across tasks instead, and those prefixes in
turn, so that no task holds more; such prefixes are again named by a bit map.

Scores and containment are equi-joins between the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

BUCKET = 32768  #: bits of a map that are one row
PAIR_BITS = 40  #: of a pair's hash, by which pairs are counted

#: Letters in lower case; what ends a piece as a line feed, a tab as a space.
AS_READ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def bit_map(items: DataFrame, hashed: Column) -> np.ndarray:
    """Hashes as a map of bits, some eight for each item but 2 ** 30 (128 MB) at
    most; beyond that it says yes more often. Rows of 4 KB come to the driver."""
    bits = max(20, min(30, (8 * items.count()).bit_length()))
    at = F.pmod(hashed, F.lit(1 << bits)).cast("long")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in items.select(at.alias("at")).groupBy(F.floor(F.col("at") / BUCKET).cast("int").alias("k")).agg(F.bitmap_construct_agg((F.col("at") % BUCKET).cast("long")).alias("m")).toLocalIterator():
        out[r["k"] * BUCKET // 8 : r["k"] * BUCKET // 8 + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C159E3779B9))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


class Words:
    """All words of a batch of texts in a line: ``codes`` into the different
    ones (``known``), text numbers, hashes of language and word, and whether the
    next word follows in the same piece."""

    def __init__(self, b: pa.RecordBatch):
        text, lang = b.column("text").cast(pa.large_string()), b.column("lang").dictionary_encode()
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].tobytes().translate(AS_READ)
        ends = ends - ends[0]
        at = np.frombuffer(data, np.uint8)
        line = at == 10
        gap = (at == 32) | line
        first, last = np.append(True, gap[:-1])[: len(at)], np.append(gap[1:], True)[: len(at)]
        own = ends[1:] > ends[:-1]
        first[ends[:-1][own]] = True
        last[ends[1:][own] - 1] = True
        start = np.flatnonzero(~gap & first)
        size = np.flatnonzero(~gap & last) + 1 - start
        offsets = np.append(0, np.cumsum(size)).astype(np.int64)
        each = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(at[~gap].tobytes())).dictionary_encode()
        self.known, self.codes = each.dictionary, each.indices.to_numpy()
        self.text = np.searchsorted(ends[1:], start, side="right")
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy()[self.text]
        lines = np.searchsorted(np.flatnonzero(line), start)
        self.follows = np.append((self.text[1:] == self.text[:-1]) & (lines[1:] == lines[:-1]), np.zeros(min(1, len(start)), bool))
        digest = lambda values: np.array([xxhash.xxh64_intdigest(v) for v in values.to_pylist()], np.uint64)
        self.h = _mix(digest(self.langs)[self.lang], digest(self.known)[self.codes])


def _slices(batches: Iterator[pa.RecordBatch], step: int = 1 << 22) -> Iterator[Words]:
    """The words of some four megabytes of texts at a time, and of at least one text."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy()
        ends = np.cumsum(size.astype(np.int64)) // step
        start = 0
        for end in [*(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]:
            if end > start:
                yield Words(b.slice(start, end - start))
            start = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> each different word of a batch with its count."""
    for w in _slices(batches):
        if len(w.codes):
            key, at, n = np.unique(w.lang.astype(np.int64) * len(w.known) + w.codes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[at])), w.known.take(pa.array(w.codes[at])).cast(pa.string()), pa.array(w.h[at]), pa.array(n)], names=["lang", "phrase", "h", "a"])


def _pairs(words: np.ndarray, held: int = 1 << 21):
    """Texts -> hashes of the pairs of maybe frequent words, counted for some
    millions of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, n = [], 0

        def out():
            p, n = np.unique(np.concatenate(wait), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["p", "n"])

        for w in _slices(batches):
            if len(w.h) > 1:
                ok = has(words, w.h)
                at = np.flatnonzero(w.follows[:-1] & ok[:-1] & ok[1:])
                wait.append(_mix(w.h[at], w.h[at + 1]) & ((1 << PAIR_BITS) - 1))
                n += len(at)
            if n >= held:
                yield out()
                wait, n = [], 0
        if n:
            yield out()

    return run


def _pointers(pairs: np.ndarray, longest: int):
    """Texts -> the stretch from each word on, as far as pairs may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _slices(batches):
            if len(w.h) < 2:
                continue
            ok = np.append(w.follows[:-1] & has(pairs, _mix(w.h[:-1], w.h[1:]) & ((1 << PAIR_BITS) - 1)), False)
            # how many pairs in a row, from each word on, up to longest - 1
            go = np.zeros(len(ok), np.int64)
            for _ in range(longest - 1):
                go = np.where(ok, 1 + np.append(go[1:], 0), 0)
            at = np.flatnonzero(go)
            size = go[at] + 1
            width = np.append(0, np.cumsum(pc.binary_length(w.known).to_numpy()[w.codes] + 1))
            ends = np.cumsum(width[at + size] - width[at])
            # strings of a batch stay within half a gigabyte
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ends >> 29)) + 1):
                own, n = at[part], size[part]
                start = np.append(0, np.cumsum(n))
                take = np.arange(start[-1]) - np.repeat(start[:-1], n) + np.repeat(own, n)
                phrase = pa.ListArray.from_arrays(pa.array(start, pa.int32()), w.known.take(pa.array(w.codes[take])).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[own])), pc.binary_join(phrase, " ")], names=["lang", "p"])

    return run


def _grow(support: int, longest: int):
    """The pointers of one prefix -> its frequent extensions, depth first."""

    def run(key, t):
        lang, prefix = key[0].as_py(), key[1].as_py()
        words = [p.split(" ") for p in t.column("p").to_pylist()]
        weight = t.column("n").to_pylist()
        found, stack = [], [(prefix, prefix.count(" ") + 1, range(len(words)))]
        while stack:
            phrase, depth, at = stack.pop()
            total = sum(weight[i] for i in at)
            if total < support:
                continue
            found.append((phrase, total))
            if depth == longest:
                continue
            grown: dict[str, list[int]] = {}
            for i in at:
                if len(words[i]) > depth:
                    grown.setdefault(words[i][depth], []).append(i)
            stack += [(f"{phrase} {w}", depth + 1, own) for w, own in grown.items()]
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "phrase": pa.array([p for p, _ in found], pa.string()), "a": pa.array([a for _, a in found], pa.int64())})

    return run


def _words(p: str) -> Column:
    """How many words a phrase has."""
    return F.length(p) - F.length(F.replace(F.col(p), F.lit(" "), F.lit(""))) + 1


def _prefix(k: int) -> Column:
    return F.substring_index("p", " ", k)


def frequent_phrases(texts: DataFrame, scratch: Scratch, support: int, longest: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """``texts`` (lang, text) -> (lang, phrase, a) for all phrases of 1 to
    ``longest`` words that occur ``support`` times, and (lang, n): all words."""
    counts = texts.mapInArrow(_counts, "lang string, phrase string, h long, a long").groupBy("lang", "phrase", "h").agg(F.sum("a").alias("a"))
    often = F.col("a") >= support
    counts = counts.groupBy("lang", F.when(often, F.col("phrase")).alias("phrase"), F.when(often, F.col("h")).alias("h")).agg(F.sum("a").alias("a"))
    counts = scratch.keep(counts, "words")  # those that are rare are one row of a language
    total = counts.groupBy("lang").agg(F.sum("a").cast("decimal(19,0)").alias("n"))
    words = counts.where("phrase is not null")
    pairs = texts.mapInArrow(_pairs(bit_map(words, F.col("h"))), "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    pairs = scratch.keep(pairs, "pairs")
    rows = texts.mapInArrow(_pointers(bit_map(pairs, F.col("p")), longest), "lang string, p string").groupBy("lang", "p").agg(F.count("*").alias("n"))
    rows = scratch.keep(rows, "pointers")
    out, whole = [words], F.lit(True)
    for depth in range(1, longest):
        # a pointer goes to the prefix of this depth, or deeper where that has too many
        here = rows.where(whole & (_words("p") >= depth)).withColumn("prefix", _prefix(depth))
        load = scratch.keep(here.groupBy("lang", "prefix").agg(F.count("*").alias("rows"), F.sum("n").alias("a")).where(F.col("rows") > group_rows), "large")
        many = bit_map(load, F.xxhash64("lang", "prefix"))
        large = _is_set(many, F.xxhash64("lang", "prefix"))
        small = here.where(~large)
        out.append(small.groupBy("lang", "prefix").applyInArrow(_grow(support, longest), "lang string, phrase string, a long").where(F.col("phrase").contains(" ")))
        if load.isEmpty():
            break
        rows = here.where(large)
        if depth > 1:
            out.append(rows.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("a")).where(F.col("a") >= support))
        rows = scratch.keep(rows.drop("prefix"), "deeper")
    else:
        # whole stretches need no growing, only a sum
        full = rows.where(_words("p") == longest)
        out.append(full.groupBy("lang", F.col("p").alias("phrase")).agg(F.sum("n").alias("a")).where(F.col("a") >= support))
    found = out[0].select("lang", "phrase", "a")
    for x in out[1:]:
        found = found.unionByName(x.select("lang", "phrase", "a"))
    return scratch.keep(found, "phrases"), total


def _is_set(bits: np.ndarray, h: Column) -> Column:
    """Whether a hash's bit is set in a map that the plan carries."""
    if not bits.any():
        return F.lit(False)

    @F.pandas_udf("boolean")
    def look(x):
        return pd.Series(has(bits, x.to_numpy()))

    return look(h)


def mine(docs: DataFrame, scratch: Scratch, support: int = 100, longest: int = 5, top: int = 2000, share: int = 100, group_rows: int = 1 << 17, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r,
    n and score, as the cut with the lowest score has them.

    A phrase of 2 to ``longest`` words within a piece of a text counts from
    ``support`` occurrences on, overlapping ones included; its score at a cut is
    floor(1000 * a * n / (l * r)) of the parts' counts and the language's words,
    the first of the lowest cuts counts. Phrases inside a longer one that occurs
    at least ``share`` percent as often are left out. Ranks go by score, count
    and the phrase's bytes. Null texts are empty, a null language is ``und``;
    repeated rows count as often as they stand there; texts and words may have
    any length. Other columns are not looked at. An empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    phrases, total = frequent_phrases(texts, scratch, support, longest, group_rows)
    if total.limit(10_001).count() <= 10_000:
        total = F.broadcast(total)
    found = phrases.where(F.col("phrase").contains(" ")).withColumn("m", _words("phrase"))
    cuts = found.select("lang", "phrase", "a", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - m)")})
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("num", whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("den", whole("l") * whole("r"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("num div den").alias("score"), "k", "l", "r", "n")).alias("s"))
    # one word more is enough: what lies between occurs no less often than the longer one
    inner = found.where("m > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * whole("within") < share * whole("a")))
    kept = kept.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.n").cast("long").alias("n"), F.col("s.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    for by in (["lang", "salt"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
