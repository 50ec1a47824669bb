"""Packing of tokenised documents into fixed-length sequences by cutting-stock
column generation.

Documents longer than a sequence are cut at multiples of its length; each full
piece is a sequence of its own. What is left, one piece per document, is packed:

1. the histogram of piece lengths, in bins of ``bin_tokens``, is counted by the
   executors (a bounded table: bins x salts);
2. a linear program over patterns (how many pieces of each bin share a
   sequence) is solved on the driver: a simplex basis prices the bins, an
   unbounded-knapsack dynamic programme finds the pattern with the best price,
   which enters the basis, until none pays;
3. pattern counts are rounded down, the few pieces left over are packed first
   fit, and the plan becomes a table of rank ranges per bin;
4. pieces are ranked within their bin (per salt, with prefix sums between
   salts) and look their sequence up by rank.

Token ids never leave the pass that makes them: it emits lengths and checksums.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.blas import single_thread
from millrace.llm.scratch import Scratch

_CACHE_WORDS = 600_000


#: Words of lower-case letters, then any ASCII symbols: the split of the
#: tokenizer below parts them there, and normalisation leaves the letters as they are.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)[!-/:-@\[-`{-~]*")
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class WordEncoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its white-space-separated words in order; words are
    encoded once and remembered, up to a bounded number. Letters before symbols
    are remembered by themselves, and with a tokenizer whose normalizer and split
    are those above they go straight to its model.
    """

    def __init__(self, path: str, end_id: int | None = 1):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.known, self.letters = Tokenizer.from_file(path), {}, None
        self.end = b"" if end_id is None else end_id.to_bytes(4, "little")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, steps = made["model"], (made["pre_tokenizer"] or {}).get("pretokenizers") or [None]
        suffix = model.get("end_of_word_suffix")
        if suffix and not model.get("dropout") and made["normalizer"] == _NORMALIZER and steps[0] == _SPLIT and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and not made["post_processor"]:
            self.letters = Tokenizer(self.tok.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            #: whether a token ends a word
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.last[[i for w, i in model["vocab"].items() if w.endswith(suffix)]] = True

    def __call__(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        # the tokenizer lower-cases; names of special tokens are matched before that
        words = (data if b"<|" in data else data.lower()).split()
        ids = list(map(self.known.get, words))
        if not all(ids):  # words without ids are b"", words not met yet None
            new = [i for i, x in enumerate(ids) if x is None]
            self._learn({words[i] for i in new})
            for i in new:
                ids[i] = self.known[words[i]]
        return b"".join(ids) + self.end

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        if len(known) + 3 * len(new) > _CACHE_WORDS:
            known.clear()
        cut = [(w, m[1], w[m.end(1) :]) for w in new if self.letters and (m := _PLAIN.fullmatch(w))]
        self._encode_letters([c for c in {c for _, c, _ in cut} if c not in known])
        self._encode([w for w in new.difference(w for w, _, _ in cut).union(s for _, _, s in cut if s) if w not in known])
        known.update((w, known[c] + known[s]) for w, c, s in cut if s)

    def _encode(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            e = self.tok.encode([w.decode("utf-8") for w in part], is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
            self._keep(part, np.array(e.ids, "<u4"), ends)

    def _encode_letters(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            ids = np.array(self.letters.encode_batch_fast([b" ".join(part).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self._keep(part, ids, ends)
            else:  # a letter is not in the vocabulary
                self._encode(part)

    def _keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        self.known.update((w, data[s:t]) for w, s, t in zip(words, at, at[1:]))


@functools.cache
def encoder(path: str, end_id: int | None) -> WordEncoder:
    """One per worker process, so that what it has learned serves later tasks."""
    return WordEncoder(path, end_id)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, size: int, end_id: int | None, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text)
                n = len(ids) // 4
                for s in range(0, n, size):
                    part = ids[4 * s : 4 * (s + size)]
                    out.append((doc, s, len(part) // 4, zlib.crc32(part), n, part if keep_ids else None))
            cols = list(zip(*out)) or [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
            names = [x.split()[0] for x in _PIECE.split(", ")]
            if keep_ids:
                arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


# ---- the plan --------------------------------------------------------------


def best_pattern(price: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of each item with the highest total price."""
    value, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(weight, c, side="right")
        value[c], taken[c] = value[c - 1], -1
        if fits:
            got = value[c - weight[:fits]] + price[:fits]
            j = int(np.argmax(got))
            if got[j] > value[c] + 1e-12:
                value[c], taken[c] = got[j], j
    count, c = np.zeros(len(weight), np.int64), room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            count[taken[c]] += 1
            c -= weight[taken[c]]
    return float(value[room]), count


def start_basis(weight: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """Patterns from a widest-first fill, each repeated until it exhausts a bin;
    the bin it exhausts is in no later pattern, so the columns are a basis."""
    m = len(weight)
    rest, live = demand.astype(float).copy(), np.ones(m, bool)
    basis = np.zeros((m, m))
    while live.any():
        column, free = np.zeros(m), room
        for seed, j in enumerate(np.flatnonzero(live)[::-1]):
            n = min(max(int(rest[j]), not seed), free // int(weight[j]))
            column[j], free = n, free - n * int(weight[j])
        some = np.flatnonzero(column)
        times = rest[some] / column[some]
        r = some[int(np.argmin(times))]
        rest[some] = np.maximum(rest[some] - column[some] * times.min(), 0)
        rest[r], live[r] = 0, False
        basis[:, r] = column
    return basis


def column_generation(weight: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4000, gap: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Fractional cutting stock: (patterns as columns, how often each is used).
    ``weight`` ascending. It ends within ``gap`` of the optimum: the total over the best pattern's
    value is a lower bound."""
    single_thread()
    basis = start_basis(weight, demand, room)
    inv = np.linalg.inv(basis)
    x = np.maximum(inv @ demand, 0)
    for step in range(rounds):
        price = inv.sum(axis=0)  # every pattern costs one sequence
        value, column = best_pattern(np.maximum(price, 0), weight, room)
        if value <= 1 + gap:
            break
        d = inv @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        basis[:, r] = column
        if step % 200 == 199:
            inv = np.linalg.inv(basis)
            x = np.maximum(inv @ demand, 0)
            continue
        row = inv[r] / d[r]
        inv -= np.outer(d, row)
        inv[r] = row
        x = np.maximum(x - d * ratio[r], 0)
        x[r] = ratio[r]
    return basis.round().astype(np.int64), np.maximum(x, 0)


@dataclass
class Plan:
    """Rank ranges per bin: (bin, lo, hi, first sequence, pieces per sequence)."""

    ranges: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def make_plan(hist: dict[int, int], room: int) -> Plan:
    """``hist``: pieces per bin (1..room); every piece gets a place."""
    plan, weight = Plan(), np.array(sorted(k for k, n in hist.items() if n), np.int64)
    if not len(weight):
        return plan
    left = np.array([hist[int(w)] for w in weight], np.int64)
    used = np.zeros(len(weight), np.int64)
    patterns, x = column_generation(weight, left.astype(float), room)

    def place(pattern: np.ndarray, times: int) -> None:
        for j in np.flatnonzero(pattern):
            n = int(pattern[j]) * times
            plan.ranges.append((int(weight[j]), int(used[j]), int(used[j]) + n, plan.sequences, int(pattern[j])))
            used[j] += n
        plan.sequences += times

    for p in np.argsort(-x):
        column = patterns[:, p]
        times = int(np.floor(x[p] + 1e-9))
        some = column > 0
        times = min(times, int(((left - used)[some] // column[some]).min(initial=times)))
        if times > 0:
            place(column, times)
    # rounding leaves at most a few pieces per basis pattern: widest first, first fit
    while (rest := left - used).any():
        column, free = np.zeros(len(weight), np.int64), room
        for j in range(len(weight) - 1, -1, -1):
            n = min(int(rest[j]), free // int(weight[j]))
            column[j], free = n, free - n * int(weight[j])
        some = column > 0
        place(column, int((rest[some] // column[some]).min()))
    return plan


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, size: int = 2048, bin_tokens: int = 8, end_id: int | None = 1, salts: int = 256, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset (and ids, little-endian 32-bit, where ``keep_ids``).

    A null or empty text has the end token alone (no row without one); repeated
    rows are packed each on its own; a null doc_id stays null; an empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = _PIECE + (", ids binary" if keep_ids else "")
    cols = [x.split()[0] for x in schema.split(", ")]
    made = own.mapInArrow(_pieces(tokenizer, size, end_id, keep_ids), schema)
    pieces = scratch.keep(made.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == size)
    tails = pieces.where(F.col("length") < size).withColumn("bin", F.ceil(F.col("length") / bin_tokens).cast("int"))
    # at most (size / bin_tokens) * salts rows
    counts = sorted((r["bin"], r["salt"], r["n"]) for r in tails.groupBy("bin", "salt").agg(F.count("*").alias("n")).collect())
    hist: dict[int, int] = {}
    prefix = []
    for b, salt, n in counts:
        prefix.append((b, salt, hist.get(b, 0)))
        hist[b] = hist.get(b, 0) + n
    plan = make_plan(hist, size // bin_tokens)
    before = spark.createDataFrame(prefix, "bin int, salt int, before long")
    ranges = spark.createDataFrame(plan.ranges, "bin int, lo long, hi long, seq long, per long")
    # ranks: longest first within a bin and salt, then by document
    w = Window.partitionBy("bin", "salt").orderBy(F.desc("length"), "doc_id", "start", "row")
    ranked = tails.join(F.broadcast(before), ["bin", "salt"]).withColumn("rank", F.row_number().over(w) - 1 + F.col("before"))
    r = F.broadcast(ranges)
    put = ranked.join(r, (ranked["bin"] == r["bin"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).withColumn("sequence_id", F.col("seq") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    put = put.withColumn("offset", F.sum("length").over(w) - F.col("length"))
    whole = whole.withColumn("sequence_id", F.col("row") + plan.sequences).withColumn("offset", F.lit(0).cast("long"))
    return put.select(*cols, "sequence_id", "offset").unionByName(whole.select(*cols, "sequence_id", "offset"))
