"""Quality classifier over learned subword embeddings.

A word contributes a learned vector for itself and one for each of its character
n-grams (with word-boundary marks), all found by hashing into one table. A
document is the average of its features' vectors; a softmax layer scores it.
Word pairs are features too, reduced to whether a word repeats the one before.
Vectors and layer are trained together by stochastic gradient descent in numpy.

Training reads at most ``train_docs`` labelled documents (those lowest in a
hash of their id), in one executor task; scoring reads all documents and all of
every text. As the average is linear, a word's share of the score is one number
and a count of features, so scoring keeps those per word and never the vectors.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import named, renamed

_CACHE_WORDS = 300_000
LONG_WORD = 64  #: longer words are hashed in parts and not remembered
PAIR_WEIGHT = 8  #: a word pair counts as that many n-grams


def features(word: str, buckets: int, low: int = 3, high: int = 4) -> list[int]:
    """Buckets of a word and of its character n-grams; for words of at most
    ``LONG_WORD`` characters."""
    h = xxhash.xxh32_intdigest
    marked = f"<{word}>"
    if word.isascii():  # bytes are characters, and slices need no encoding
        data = marked.encode("ascii")
        grams = [data[i : i + n] for n in range(low, high + 1) for i in range(len(data) - n + 1)]
    else:
        grams = [marked[i : i + n].encode("utf-8", "surrogatepass") for n in range(low, high + 1) for i in range(len(marked) - n + 1)]
    return [h(b"w" + word.encode("utf-8", "surrogatepass")) % buckets, *(h(g) % buckets for g in grams)]


def long_features(word: str, buckets: int, low: int = 3, high: int = 4, chunk: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of the same features for a word of any length, in parts
    of at most ``chunk`` characters; equal n-grams of a part are hashed once."""
    h = xxhash.xxh32_intdigest
    yield np.array([h(b"w" + word.encode("utf-8", "surrogatepass")) % buckets]), np.ones(1, np.int64)
    marked = f"<{word}>"
    for n in range(low, high + 1):
        for i in range(0, len(marked) - n + 1, chunk):
            part = marked[i : i + chunk + n - 1]
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            gram = code[: len(code) - n + 1]
            for k in range(1, n):  # numbers of distinct beginnings stay small, so the code point fits below
                gram = np.unique(gram, return_inverse=True)[1] << 21 | code[k : len(code) - n + 1 + k]
            _, first, count = np.unique(gram, return_index=True, return_counts=True)
            yield np.array([h(part[j : j + n].encode("utf-8", "surrogatepass")) % buckets for j in first.tolist()]), count


def pair_buckets(buckets: int) -> tuple[int, int]:
    """Buckets of a word that differs from the one before, and of one that repeats it."""
    return tuple(xxhash.xxh32_intdigest(g) % buckets for g in (b"pair:new", b"pair:same"))


def repeats(words: list[str]) -> int:
    return sum(map(operator.eq, words, words[1:]))


class Vocabulary:
    """Feature lists of words, remembered up to a bounded number."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, shares) of a text; shares sum to one."""
        total: dict[str, int] = {}
        words = (text or "").split()
        for w in words:
            total[w] = total.get(w, 0) + 1
        if not total:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        at, n, dense = [], [], None
        for w, c in total.items():
            if len(w) > LONG_WORD:
                dense = np.zeros(self.buckets) if dense is None else dense
                for ids, count in long_features(w, self.buckets):
                    np.add.at(dense, ids, c * count)
                continue
            f = self.known.get(w)
            if f is None:
                f = self.known[w] = features(w, self.buckets)
            at += f
            n += [c] * len(f)
        same = repeats(words)
        at += pair_buckets(self.buckets)
        n += [PAIR_WEIGHT * (len(words) - same), PAIR_WEIGHT * same]
        if dense is not None:
            ids = np.flatnonzero(dense)
            at, n = np.concatenate((at, ids)), np.concatenate((n, dense[ids]))
        ids, inverse = np.unique(np.array(at), return_inverse=True)
        share = np.bincount(inverse, np.array(n, float))
        return ids, share / share.sum()


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, dim: int = 12, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, layer, bias) by SGD, one document a step, rate falling to 0.
    The rarer class weighs as much as the other, by the root of the ratio."""
    rng = np.random.default_rng(seed)
    vec, out, bias = rng.normal(0, 1 / dim, (buckets, dim)), np.zeros((dim, 2)), np.zeros(2)
    n = np.maximum(np.bincount(labels, minlength=2), 1)
    weight = np.sqrt(n.max() / n)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vec[ids] if len(ids) else np.zeros(dim)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]] * lr
            back = out @ p
            out -= np.outer(hidden, p)
            bias -= 0.1 * p
            if len(ids):
                # shares are small; their step is scaled to the document's features
                vec[ids] -= np.outer(share / share.max(), back)
    return vec, out, bias


def _train_rows(buckets: int, dim: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, docs, labels = Vocabulary(buckets), [], []
        rows = sorted((i, t or "", y) for b in batches for i, t, y in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("label").to_pylist()))
        for _, text, y in rows:
            docs.append(vocabulary.counts(text))
            labels.append(y)
        if docs:
            vec, out, bias = train(docs, np.array(labels), buckets, dim, epochs)
            score = vec @ (out[:, 1] - out[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([score.astype("<f4").tobytes()], pa.binary()), pa.array([float(bias[1] - bias[0])])], names=["score", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, dim: int = 12, epochs: int = 8, train_docs: int = 3000, label: str = "quality") -> tuple[bytes, float]:
    """Bucket scores (float32, ``buckets`` of them) and bias. Rows whose
    crc32(doc_id) mod 4 is 2 are held out; rows with a null id, label or text
    are passed over, and of rows with the same id that of the least text is
    read; without any labelled row the scores are zero."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    y = y.groupBy("doc_id").agg(F.max("label").alias("label"))
    pick = y.orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(train_docs)  # bounded, so it may be broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # the scan stays parallel; only the picked rows, one for an id, move to the training task
    rows = own.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).repartition(1)
    got = rows.mapInArrow(_train_rows(buckets, dim, epochs), "score binary, bias double").collect()
    return (bytes(got[0]["score"]), got[0]["bias"]) if got else (bytes(4 * buckets), 0.0)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _score(model, buckets: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = np.frombuffer(model.value[0], "<f4").astype(float), model.value[1]
        known: dict[str, float] = {}
        size: dict[str, int] = {}
        other, same = (float(weights[i]) for i in pair_buckets(buckets))
        for b in batches:
            out = []
            for text in b.column("__text").to_pylist():
                words = (text or "").split()
                new = set(words).difference(known)
                if len(known) + len(new) > _CACHE_WORDS:
                    known, size, new = {}, {}, set(words)
                long = [w for w in new if len(w) > LONG_WORD]
                new.difference_update(long)
                for w in long:
                    known[w], size[w] = 0.0, 0
                    for ids, count in long_features(w, buckets):
                        known[w] += float(weights[ids] @ count)
                        size[w] += int(count.sum())
                if new:
                    each = [features(w, buckets) for w in new]
                    lens = list(map(len, each))
                    sums = np.add.reduceat(weights[np.fromiter(chain.from_iterable(each), np.int64, sum(lens))], np.cumsum([0, *lens[:-1]]))
                    known.update(zip(new, sums.tolist()))
                    size.update(zip(new, lens))
                n = sum(map(size.__getitem__, words)) + PAIR_WEIGHT * len(words)
                again = repeats(words)
                pairs = PAIR_WEIGHT * (again * same + (len(words) - again) * other)
                z = bias + ((math.fsum(map(known.__getitem__, words)) + pairs) / n if n else 0.0)
                for w in long:
                    del known[w], size[w]
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    return run


def score(docs: DataFrame, model: tuple[bytes, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score, the probability of label 1; a null, empty or
    wordless text has the score of the bias alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 4 bytes a bucket
    own = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    fields = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(_score(shared, len(model[0]) // 4, list(keep)), f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit_options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 where the
    score reaches ``threshold``). Repeated rows score alike; a null doc_id is
    scored and not held out; an empty table gives no rows."""
    model = fit(docs, labels, **fit_options)
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit_options) -> DataFrame:
    """The rows of ``docs`` that reach ``threshold``, all columns kept, whatever
    their names. Null, empty and wordless texts are scored by the bias alone;
    repeated rows stay or go together; an empty table gives no rows."""
    model = fit(docs, labels, **fit_options)
    plain, back = renamed(docs)
    found = score(plain, model, text=back["text"], keep=tuple(plain.columns))
    return found.where(F.col("score") >= threshold).select(*named(back))
