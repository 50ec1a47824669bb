"""The pipeline's stages against their inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import secrets, shingles, simhash
from millrace.llm.scratch import Scratch


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "sequence_packing":
            assert docs.columns == first
            assert docs.count() == docs.dropDuplicates(["doc_id"]).count()
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "secret_scan", "source_mixing", "sequence_packing"]
    assert seen["secret_scan"].count() == seen["near_dedup"].count()
    assert secrets.scan(seen["secret_scan"]).where("is_secret").count() == 0
    ids = {r[0] for r in seen["source_mixing"].select("doc_id").collect()}
    assert {r[0] for r in docs.select("doc_id").collect()} == ids
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").join(seen["quality_classifier"], "doc_id", "left_anti").count()
    assert good <= 1


def test_run_gives_the_rows_of_its_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    rows = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    run = corpus_pipeline.run(spark, sf_dir)
    assert rows(run) == rows(docs)
    fill = run.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in fill) <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_odd_rows(spark, sf_dir, name):
    """Nulls in any column, empty and long texts, repeated rows, names that clash, no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeghilnorst") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    some = [x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()]
    texts = [*some, None, "", " \n\t", prose(40_000), "x" * 200_000, prose(80), f'token = "{"ab12cd34" * 5}"', *some[:2]]
    rows = [(None if i == 5 else i % 37, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "web", None if i % 3 == 0 else 7, f"k{i % 37}", i % 37, None, "h", 0.5) for i, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, `__row_key` string, `a.b` int, `__hits` string, `k` string, `score` double"
    df = spark.createDataFrame([*rows, rows[3], rows[3]], kinds).repartition(3)
    out = stage(spark, df, sf_dir)
    got = out.collect()
    assert stage(spark, df.limit(0), sf_dir).count() == 0
    if name == "sequence_packing":
        assert {x["doc_id"] for x in got} == {x[0] for x in rows} and sum(x["start"] == 0 for x in got) == len(rows) + 2
        return
    assert out.columns == df.columns
    given = {x[5]: x for x in rows}
    for x in got:
        assert x["a.b"] == given[x["__row_key"]][6] and x["__hits"] is None and x["k"] == "h" and x["score"] == 0.5
    if name == "secret_scan":
        assert len(got) == len(rows) + 2 and sum("[SECRET]" in (x["text"] or "") for x in got) >= 1
        assert sum(x["text"] is None for x in got) == 1
    if name == "near_dedup":
        assert len(got) == len({(x["doc_id"], x["text"]) for x in got}) < len(rows)


def test_near_dedup_links_all_similar_texts(spark, sf_dir):
    """Against brute force over five-word shingles, on the documents and on edited copies."""
    r = random.Random(7)
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    base = [t for _, t in rows if len(t.split()) > 60][:8]
    for text in base:
        for edits in (1, 2, 3, 6, 10):
            words = text.split()
            for _ in range(edits):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            rows.append((10_000 + len(rows), " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "two words"), (20_003, "Two  words")]

    def sets(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    have, ids = [sets(t) for _, t in rows], [i for i, _ in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    links = [[j for j in range(len(rows)) if alike(have[i], have[j])] for i in range(len(rows))]
    label = list(ids)
    while True:
        new = [min(label[j] for j in links[i]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, df, sf_dir)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(label))
    assert len(set(label)) < len(ids) - 20


def test_common_members_are_few_for_the_driver(spark):
    """The commonest, about as many as asked for, whatever the number of tasks."""
    tokens = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 3000)
    counts = 1 + np.arange(3000) % 12
    rows = spark.createDataFrame([(int(t),) for t, n in zip(tokens, counts) for _ in range(n)], "token long").repartition(20)
    got = shingles.common_members(rows, Scratch(spark, "t"), most=600)
    top, ties = tokens[counts > 10], np.sort(tokens[counts == 10])
    assert 560 < len(got) < 640
    assert got.tolist() == sorted([*top.tolist(), *ties[: len(got) - 500].tolist()])
    assert shingles.common_members(rows, Scratch(spark, "t")).tolist() == sorted(tokens[counts > 3].tolist())
    assert len(shingles.common_members(rows.limit(0), Scratch(spark, "t"))) == 0


def test_a_large_group_of_near_copies_costs_few_comparisons(spark):
    """1500 texts, most pairs just under the similarity: the classes of brute force, by few set comparisons."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeghilnorst") for _ in range(r.randint(3, 9)))
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(1500):
        own = base[:]
        for i in r.sample(range(300), 4):
            own[i] = word()
        texts.append(" ".join(own))
    sets = [shingles.shingles(t) for t in texts]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((1500, codes.max() + 1), np.float32)
    held[np.repeat(np.arange(1500), [len(s) for s in sets]), codes] = 1
    both, n = held @ held.T, np.array([len(s) for s in sets])
    close = both / (n[:, None] + n - both) >= 0.8 - 1e-9
    label = np.arange(1500)
    for _ in range(60):
        label = np.array([label[c].min() for c in close])
    scratch = Scratch(spark, "t")
    once = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string").repartition(4)
    none = spark.createDataFrame([], "node long, root long")
    rows = shingles.members_of(once.mapInArrow(shingles._prefixes(5, 0.8, np.zeros(0, np.int64)), shingles.PREFIX), none)
    found = shingles.settle_large(rows, once, scratch, 0.8, 5, block_nodes=400)
    tried = found.where("a is null").agg(F.sum("tried")).first()[0]
    parent = list(range(1500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in found.where("a is not null").collect():
        assert close[e["a"], e["b"]]
        x, y = find(e["a"]), find(e["b"])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(1500)] == label.tolist()
    assert tried < 20_000 and found.count() < 10_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs, Scratch(spark, "t"), size=5, similarity=0.8)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(label.tolist()))
