"""Compaction, top-k search and collocations against brute force, with nulls, ties,
repeated rows, empty tables, long texts and columns whose names clash."""

import datetime as dt
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations, compaction, topk
from millrace.llm.scratch import Scratch

# ---- 11 --------------------------------------------------------------------------


def plain_first_fit(sizes, most):
    groups = []
    for i, s in enumerate(sizes):
        for g in groups:
            if sum(sizes[j] for j in g) + s <= most:
                g.append(i)
                break
        else:
            groups.append([i])
    return groups


def test_group_at_a_time_equals_first_fit():
    r = random.Random(3)
    for _ in range(400):
        sizes = sorted((r.randint(1, r.choice([3, 20, 200])) for _ in range(r.randint(0, 60))), reverse=True)
        assert compaction.first_fit(sizes, 100) == plain_first_fit(sizes, 100)


def plain_files(rows):
    """Final files by (day, lot, piece): sources in joining order and rows in file order."""
    n, days = len(rows), defaultdict(list)
    share = lambda x: 1 + n // x
    for r in rows:
        days[None if r["arrived_at"] is None else (r["arrived_at"].date() - dt.date(1970, 1, 1)).days].append(r)
    out = {}
    for day, own in days.items():
        start = defaultdict(list)
        for r in own:
            h = zlib.crc32(b"" if r["click_id"] is None else str(r["click_id"]).encode())
            start[(h // 16) % (1 + len(own) // share(150)), min(h % 4, h // 4 % 4)].append(r)
        low = lambda v: (v is not None, v if v is not None else 0)
        for k in start:
            start[k].sort(key=lambda r: (low(r["arrived_at"] and r["arrived_at"].timestamp()), low(r["click_id"])))
        order = sorted(start, key=lambda k: (-len(start[k]), *k))
        small = [k for k in order if len(start[k]) < share(600)]
        groups = [[small[i] for i in g] for g in plain_first_fit([len(start[k]) for k in small], share(400))]
        for g in [*groups, *([k] for k in order if k not in small)]:
            out[day, *g[0]] = (g, [r for k in g for r in start[k]])
    return out


def check_files(spark, rows, name):
    done = compaction.compact(rows, Scratch(spark, name))
    want = plain_files([r.asDict() for r in rows.collect()])
    got = compaction.report(done, spark).collect()
    assert len(got) == len(want)
    for r in got:
        sources, held = want[r["day"], r["lot"], r["piece"]]
        ids = [x["click_id"] for x in held]
        known = [i for i in ids if i is not None]
        assert r["sources"] == ",".join(f"{a}-{b}" for a, b in sources) and r["rewritten"] == (len(sources) > 1)
        assert r["ids_sha256"] == hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
        assert (r["n_rows"], r["min_key"], r["max_key"]) == (len(ids), min(known, default=None), max(known, default=None))
        assert r["cents"] == sum(math.floor(100 * x["value"] + 0.5) for x in held if x["value"] is not None and math.isfinite(x["value"]))
        assert r["columns"] == ",".join(rows.columns)
        file = pq.ParquetFile(r["path"].removeprefix("file:").replace("//", "/"))
        assert file.schema_arrow.names == rows.columns and file.read().column("click_id").to_pylist() == ids
    files = {p for p in Path(done.folder.removeprefix("file:")).rglob("*") if p.is_file() and p.name[0] not in "._"}
    assert {str(p) for p in files} == {r["path"].removeprefix("file:").replace("///", "/") for r in got}
    return got


def test_compaction_of_all_clicks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    got = check_files(spark, rows, "t11")
    assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)
    assert sum(r["n_rows"] for r in got) == rows.count()


def test_compaction_of_odd_rows(spark):
    """Nulls in every column, repeated rows, days before 1970, a hot day and names that clash."""
    r, day = random.Random(5), dt.datetime(2024, 3, 1)
    data = []
    for i in range(900):
        at = None if i % 17 == 0 else (day if i % 3 else day + dt.timedelta(days=r.randint(-30_000, 40))) + dt.timedelta(seconds=r.randint(0, 86_399))
        data.append((None if i % 29 == 0 else r.randint(0, 400), at, r.choice([None, float("nan"), float("inf"), 1.005, -3.333]), "x", 1, 2, 3, 4, "y"))
    data += data[:40]
    schema = "click_id long, arrived_at timestamp_ntz, value double, `d_` string, day int, lot int, small int, place int, `a.b` string"
    check_files(spark, spark.createDataFrame(data, schema).repartition(3), "t11odd")


def test_compaction_of_no_rows(spark):
    none = spark.createDataFrame([], "click_id long, arrived_at timestamp_ntz, value double")
    assert compaction.report(compaction.compact(none, Scratch(spark, "t11none")), spark).count() == 0


# ---- 12 --------------------------------------------------------------------------


def plain_topk(rows, asks, k=20, scale=64):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i is not None and asks(i):
            each = [(-sum(x * y for x, y in zip(q, v)), (j is None, j or 0), j) for b, (j, v) in enumerate(good) if b != a]
            out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(sorted(each, key=lambda e: e[:2])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_rows", [10_000, 16])
def test_topk_of_odd_rows(spark, shard_rows):
    """Null and broken vectors, zeros, ties, repeated rows, null ids, several widths, all scores negative."""
    r = random.Random(9)
    rows = [(i, [r.choice([0.0, 0.0, r.uniform(-2, 2)]) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[i][1]) for i in range(8)] + [(200 + i, rows[4][1]) for i in range(30)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None]), (304, [float("nan")]), (305, [float("inf"), 0.0]), (310, [0.5]), (None, [1.0] * 6), (400, [-1.0] * 9)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, node int, shard int, score int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    got = topk.search(df, Scratch(spark, "t12"), F.col("vec_id") % 10 == 0, k=7, shard_rows=shard_rows, block_rows=8)
    assert found(got) == plain_topk(rows, lambda i: i % 10 == 0, 7)
    away = [(i, [-1.0 - i % 5 if i % 4 else 1.0] * 3) for i in range(40)]
    df = spark.createDataFrame(away, "vec_id long, embedding array<double>")
    got = topk.search(df, Scratch(spark, "t12"), F.col("vec_id") % 4 == 0, k=30, shard_rows=shard_rows)
    assert found(got) == plain_topk(away, lambda i: i % 4 == 0, 30)


def test_topk_of_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(none, Scratch(spark, "t12"), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(one, Scratch(spark, "t12"), F.col("vec_id") % 20 == 0).count() == 0


def test_non_essential_terms_are_not_traversed():
    """On sparse rows most postings of a query stay unread, and the result is that of all rows."""
    rng = np.random.default_rng(4)
    x = rng.integers(1, 40, (4000, 60)) * (rng.random((4000, 60)) < 0.05)
    index = topk.Index(x)
    read = []

    class Watched(list):
        def __getitem__(self, t):
            read.append(t)
            return super().__getitem__(t)

    index.postings, terms = Watched(index.postings), 0
    for i in range(0, 4000, 200):
        q = x[i] * 1
        q[: 30] += rng.integers(0, 2, 30)
        terms += np.count_nonzero(q)
        rows, scores = index.best(q, 10, own=i)
        every = x @ q
        every[i] = -1
        want = np.lexsort((np.arange(4000), -every))[:10]
        assert rows.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    assert len(read) < 0.5 * terms


# ---- 13 --------------------------------------------------------------------------


def plain_phrases(rows, support, longest, top, share=100):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\f\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    f = {k: a for k, a in f.items() if a >= support}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out, langs = [], {lang for lang, _ in f}
    for lang in langs:
        own = {p: a for (x, p), a in f.items() if x == lang}
        got = []
        for p, a in own.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= share * a and inside(p, q) for q, b in own.items()):
                continue
            s, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            got.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(got)[:top], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("group_rows", [100_000, 5])
def test_collocations_of_odd_rows(spark, group_rows):
    """Hot words and passages, nulls, repeated rows, long words and texts, clashing names; small groups
    make prefixes of every depth be grown across tasks."""
    r = random.Random(11)
    words = ["of", "the", "of", "The", "sea", "éa", "x" * 5000, "b-c", "\x01", "q"]
    text = lambda m: "".join(r.choice(words) + r.choice([" "] * 9 + [", ", "\n", "\t", " . ", "  "]) for _ in range(m))
    rows = [(text(r.randint(0, 40)), r.choice(["en", "en", "fr", None])) for _ in range(90)]
    rows += [("one two three four five six seven", "en")] * 30 + [(None, "en"), ("", None), (" \t\n", "fr"), ("of the " * 3000, "de")]
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, a int, n int").repartition(3)
    for share in (100, 60):
        got = collocations.mine(df, Scratch(spark, "t13"), support=6, top=25, share=share, group_rows=group_rows)
        assert mined(got) == plain_phrases(rows, 6, 5, 25, share)


def test_collocations_of_none(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.mine(none, Scratch(spark, "t13")).count() == 0


def test_scores_beyond_64_bits(spark):
    """num div den is exact up to 38 digits."""
    df = spark.range(1).select(F.lit(9_000_000_000_000).cast("decimal(19,0)").alias("a"), F.lit(12_345_678_901_234).cast("decimal(19,0)").alias("n"))
    got = df.select(F.expr("(a * n * cast(1000 as decimal(4,0))) div (a * cast(7 as decimal(19,0)))").alias("s")).first()["s"]
    assert got == 1000 * 12_345_678_901_234 // 7
