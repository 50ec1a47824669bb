"""Operators that are meant for many rows: ranks, neighbours, density, communities,
draws and wide components against plain versions, with skewed and repeated rows."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.functions import vec
from millrace.operators import cluster, decomposition, density, ensemble, graph, linear, nearest, nn, tree
from millrace.plans import components as linked
from millrace.plans import lineage, ranks


def vectors(spark, x, first=0, name="row_id"):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(np.asarray(x, float))], f"{name} long, features array<double>").repartition(5)


def many(spark, x):
    return spark.createDataFrame(pa.table({"row_id": np.arange(len(x)), "features": pa.array(list(x))})).repartition(8)


def dist(x, y, metric):
    """Feature by feature, as the kernels sum."""
    total = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        d = np.abs(a[:, None] - b[None])
        total += d if metric == "manhattan" else d * d
    return total if metric == "manhattan" else np.sqrt(total)


# ---- ranks -------------------------------------------------------------------------


def test_positions_of_skewed_keys_spread_over_tasks(spark):
    """One outlier and one key with half of the rows: no range above three times the average."""
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") == 7, 1e12).when(F.col("id") % 2 == 0, 3.0).otherwise(F.rand(1)).alias("k"))
    got = ranks.positions(df, F.col("k"), F.col("id"), parts=8)
    rows = got.select("id", "k", "pos").toPandas().sort_values("pos")
    assert rows["pos"].tolist() == list(range(n)) and rows.sort_values(["k", "id"])["pos"].is_monotonic_increasing
    by = ["k", "id"]
    sizes = df.repartitionByRange(8, *by).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 3 * n / 8


def test_positions_of_few_null_and_equal_rows(spark):
    df = spark.createDataFrame([(None,), (2,), (2,), (1,), (None,)], "k int")
    got = [(r["k"], r["pos"]) for r in ranks.positions(df, F.col("k")).orderBy("pos").collect()]
    assert got == [(None, 0), (None, 1), (1, 2), (2, 3), (2, 4)]
    assert ranks.positions(df.limit(0), F.col("k")).count() == 0
    named = ranks.positions(df.withColumn("a.b", F.lit(1)), F.col("k"), F.col("`a.b`"))
    assert named.columns == ["k", "a.b", "pos"]


# ---- neighbours --------------------------------------------------------------------


def plain_knn(q, x, k, metric):
    d = dist(q, x, metric)
    return [[(int(t), float(r[t])) for t in np.lexsort((np.arange(len(x)), r))[:k]] for r in d]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("sizes", [{"cell_rows": 20, "block_rows": 16}, {"cell_rows": 300}, {"cell_rows": 10_000}])
def test_knn_by_pivots_is_all_of_it(spark, metric, sizes):
    """Clusters, ties on a lattice, copies beyond k, and queries far from all rows."""
    r = np.random.default_rng(2)
    x = np.concatenate((r.normal(size=(200, 3)), 8 + 0.1 * r.normal(size=(150, 3)), np.array(list(itertools.product(range(4), repeat=3)), float), np.tile([[20.0, 1.0, 1.0]], (40, 1))))
    q = np.concatenate((x[::23], [[100.0, 0, 0], [0.5, 0.5, 0.5], [20, 1, 1]]))
    got = nearest.nearest(vectors(spark, q, name="q").withColumnRenamed("features", "x"), vectors(spark, x, name="t").withColumnRenamed("features", "x"), 7, metric, **sizes)
    found = {}
    for row in got.rows.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["train_id"], row["dist"]))
    assert [found[i] for i in range(len(q))] == plain_knn(q, x, 7, metric)


def test_knn_asks_for_more_than_a_cell_holds(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 2))
    train = vectors(spark, x, name="t").withColumnRenamed("features", "x").withColumn("label", F.concat(F.lit("c"), F.col("t") % 3))
    got = nearest.nearest(vectors(spark, x[:5], name="q").withColumnRenamed("features", "x"), train, 55, cell_rows=4)
    rows = got.rows.orderBy("query_id", "rank").collect()
    assert [(r["train_id"], r["label"]) for r in rows] == [(t, f"c{t % 3}") for own in plain_knn(x[:5], x, 55, "euclidean") for t, _ in own]


def test_knn_of_broken_and_no_rows(spark):
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 0.0]), (4, [None, 0.0])], "t long, x array<double>")
    got = nearest.nearest(bad.withColumnRenamed("t", "q"), bad, 3)
    assert [(r["query_id"], r["train_id"]) for r in got.rows.collect()] == [(1, 1)]
    assert nearest.nearest(bad.limit(0).withColumnRenamed("t", "q"), bad, 1).rows.count() == 0
    assert nearest.nearest(bad.withColumnRenamed("t", "q"), bad.limit(0), 1).rows.count() == 0


def test_knn_compares_few_pairs_of_clustered_rows(spark):
    """100 000 rows in 200 clusters: below a fifth of all pairs, and the same neighbours."""
    r = np.random.default_rng(5)
    centers = r.normal(size=(200, 8)) * 10
    x = centers[r.integers(0, 200, 100_000)] + r.normal(size=(100_000, 8))
    df = many(spark, x).toDF("t", "x")
    q = df.where("t % 500 = 0").withColumnRenamed("t", "q")
    got = nearest.nearest(q, df, 5)
    found = {}
    for row in got.rows.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["train_id"], row["dist"]))
    assert [found[i] for i in range(0, len(x), 500)] == plain_knn(x[::500], x, 5, "euclidean")
    assert got.compared() < 0.2 * 200 * len(x)


# ---- density -----------------------------------------------------------------------


def plain_dbscan(x, eps, least, metric):
    """The textbook loop over rows in order."""
    near = [np.flatnonzero(r <= eps) for r in dist(x, x, metric)]
    label, k = np.zeros(len(x), int), 0
    for i in range(len(x)):
        if label[i] or len(near[i]) < least:
            continue
        k += 1
        label[i], queue = k, [i]
        while queue:
            for j in near[queue.pop(0)]:
                if not label[j]:
                    label[j] = k
                    if len(near[j]) >= least:
                        queue.append(j)
    return label.tolist()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_dbscan_equals_the_loop(spark, metric, d):
    """Dense cells, chains, lattice rows exactly eps apart, copies, noise."""
    r = np.random.default_rng(10 * d)
    for eps, least in (((0.5, 4), (1.0, 3))[d % 2],):
        x = np.concatenate((r.normal(size=(120, d)) * 0.4, 3 + r.normal(size=(60, d)), np.round(r.uniform(-6, 6, (80, d))) * 0.5, np.tile(r.uniform(5, 6, (1, d)), (9, 1)), r.uniform(-8, 8, (60, d))))
        got = cluster.DBSCAN(eps, least, metric).fit_predict(vectors(spark, x))
        assert [row["cluster"] for row in got.orderBy("row_id").collect()] == plain_dbscan(x, eps, least, metric)


def test_undecided_cells_are_settled_by_their_rows(spark):
    """Curved rims of two clouds whose boxes overlap the radius, in blocks of a few rows."""
    r = np.random.default_rng(6)
    t = r.uniform(0, 2 * np.pi, 1500)
    ring = np.stack((np.cos(t), np.sin(t)), axis=1) * r.uniform(0.9, 1.0, 1500)[:, None] * 3
    for gap in (0.3, 0.5):
        other = ring + [6.0 + gap, 0.0]
        x = np.concatenate((ring, other))
        rows = vectors(spark, x).select(F.col("row_id").alias("a"), F.col("features").alias("x"), F.lit(1).cast("long").alias("w"))
        got = density.by_grid(rows, 2, 0.4, 3, "euclidean", parts=2, block_rows=50)
        nodes = {r_["node"] for r_ in got.core.collect()}
        parent = {n: n for n in nodes}

        def root(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for e in got.edges.collect():
            parent[max(root(e["a"]), root(e["b"]))] = min(root(e["a"]), root(e["b"]))
        want = plain_dbscan(x, 0.4, 3, "euclidean")
        assert len({root(n) for n in nodes}) == max(want) and got.edges.count() < len(nodes) * 24


def test_dbscan_of_a_dense_cell_has_bounded_output(spark):
    """100 000 rows within one radius: no list of pairs, linear links."""
    r = np.random.default_rng(8)
    x = np.concatenate((r.uniform(0, 0.3, (100_000, 2)), 50 + r.uniform(0, 0.3, (50, 2)), [[99.0, 99.0]]))
    df = many(spark, x)
    got = cluster.DBSCAN(0.5, 5).fit_predict(df).groupBy("cluster").count().orderBy("cluster").collect()
    assert [tuple(g) for g in got] == [(0, 1), (1, 100_000), (2, 50)]
    rows = df.select(F.col("row_id").alias("a"), F.col("features").alias("x"), F.lit(1).cast("long").alias("w"))
    found = density.by_grid(rows, 2, 0.5, 5, "euclidean")
    assert found.edges.count() < 10 and found.border.count() == 0


def test_dbscan_of_dense_wide_rows_links_by_stars(spark):
    r = np.random.default_rng(9)
    x = np.concatenate((r.normal(size=(1500, 6)) * 0.01, 5 + r.normal(size=(300, 6)) * 0.01))
    rows = vectors(spark, x).select(F.col("row_id").alias("a"), F.col("features").alias("x"), F.lit(1).cast("long").alias("w"))
    found = density.by_blocks(rows, 1.0, 5, "euclidean", block_rows=256)
    assert found.edges.count() <= 10 * 1800 and found.core.count() == 1800
    got = cluster.DBSCAN(1.0, 5).fit_predict(vectors(spark, x))
    assert [row["cluster"] for row in got.orderBy("row_id").collect()] == [1] * 1500 + [2] * 300


def test_dbscan_of_null_and_no_rows(spark):
    df = spark.createDataFrame([(i, [0.0, float("nan") if i == 3 else 0.0]) for i in range(6)], "row_id long, features array<double>")
    got = cluster.DBSCAN(1.0, 2, lambda a, b: vec.manhattan(a, b, 2)).fit_predict(df)
    assert [r["cluster"] for r in got.orderBy("row_id").collect()] == [1, 1, 1, 0, 1, 1]
    lonely = cluster.DBSCAN(1.0, 7).fit_predict(df)
    assert {r["cluster"] for r in lonely.collect()} == {0}


# ---- communities -------------------------------------------------------------------


def graph_of(spark, n, pairs):
    return spark.range(n).select("id", F.col("id").alias("pos")), spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


def test_colours_differ_between_neighbours(spark):
    r = np.random.default_rng(1)
    pairs = [*{tuple(sorted(p)) for p in r.integers(0, 80, (160, 2)).tolist() if p[0] != p[1]}, *itertools.combinations(range(80, 86), 2)]
    vertices, edges = graph_of(spark, 90, pairs)
    wave = {row["id"]: row["wave"] for row in graph.color_classes(vertices, graph.undirected(edges)).collect()}
    assert len(wave) == 90 and all(wave[a] != wave[b] for a, b in pairs) and wave[89] == 0
    assert max(wave.values()) <= max(sum(v in p for p in pairs) for v in range(90))


def test_propagation_is_the_loop_over_its_order(spark):
    """Waves of colours give what one vertex after the other gives, and fewer vote each round."""
    r = np.random.default_rng(4)
    pairs = []
    for c in range(4):
        own = 20 * c + np.arange(20)
        pairs += [tuple(p) for p in r.choice(own, (70, 2)).tolist() if p[0] != p[1]]
    pairs += [(0, 25), (22, 45), (41, 65), (3, 61)]
    vertices, edges = graph_of(spark, 82, pairs)
    got, rounds = graph.LabelPropagation(seed=3, order="colors").trace(vertices, edges, ties="smallest")
    rows = {row["id"]: (row["label"], row["wave"]) for row in got.collect()}
    near = {v: set() for v in range(82)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    label = {v: v for v in range(82)}
    for _ in range(50):
        moved = 0
        for v in sorted(near, key=lambda v: (rows[v][1], v)):
            if near[v]:
                count = {}
                for u in near[v]:
                    count[label[u]] = count.get(label[u], 0) + 1
                best = min(count, key=lambda x: (-count[x], x))
                moved += best != label[v]
                label[v] = best
        if not moved:
            break
    assert {v: x for v, (x, _) in rows.items()} == label
    assert rounds[0]["voted"] == 82 and rounds[-1]["changed"] == 0 and rounds[-1]["voted"] < 82


def test_color_order_ends_when_no_label_changes(spark, tmp_path):
    """A chain of suppliers, each of which shares 30 orders with the next, takes more than two rounds."""
    from millrace.queries import QUERIES

    lines = [(30 * i + k, s) for i in range(15) for k in range(30) for s in (i, i + 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(16)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = {r["id"]: (r["label"], r["wave"]) for r in QUERIES["M12_R7_color_order"](spark, str(tmp_path)).collect()}
    label, rounds, moved = list(range(16)), 0, True
    while moved:
        moved, rounds = False, rounds + 1
        for v in sorted(range(16), key=lambda v: (rows[v][1], v)):
            near = [label[u] for u in (v - 1, v + 1) if 0 <= u < 16]
            best = min(near, key=lambda x: (-near.count(x), x))
            moved, label[v] = moved or best != label[v], best
    assert rounds > 3 and [rows[v][0] for v in range(16)] == label
    with pytest.raises(ValueError):
        graph.LabelPropagation(None)
    with pytest.raises(ValueError):
        graph.LabelPropagation(None, order="colors").run(*graph_of(spark, 3, [(0, 1)]), wave=F.lit(0))


def test_cliques_beyond_the_colours_are_refused(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_COLORS", 4)
    vertices, edges = graph_of(spark, 5, itertools.combinations(range(5), 2))
    with pytest.raises(ValueError):
        graph.color_classes(vertices, graph.undirected(edges)).count()


# ---- draws -------------------------------------------------------------------------


def test_bootstrap_draws_exactly_and_evenly(spark):
    """Exact sizes, whatever the partitions; counts by a chi-square test."""
    n, trees, draws = 20_000, 4, 15_000
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumn("x", F.col("row_id") * 2)
    got = ensemble.bootstrap(df, trees, draws, 7).toPandas()
    assert got.groupby("tree")["w"].sum().tolist() == [draws] * trees and (got["x"] == 2 * got["row_id"]).all()
    again = ensemble.bootstrap(df.repartition(7), trees, draws, 7).toPandas()
    key = ["tree", "row_id"]
    assert again.sort_values(key)["w"].tolist() == got.sort_values(key)["w"].tolist()
    for _, own in got.groupby("tree"):
        seen = np.bincount(own["row_id"] // 200, own["w"], n // 200)
        chi = ((seen - draws * 200 / n) ** 2 / (draws * 200 / n)).sum()
        assert 55 < chi < 155  # 99 degrees of freedom: beyond 0.01 % on both sides
        twice = (own["w"] >= 2).sum() / n
        assert abs(twice - (1 - np.exp(-0.75) * 1.75)) < 0.01
    assert len({tuple(g["row_id"][:50]) for _, g in got.groupby("tree")}) == trees


def test_draws_of_blocks_add_up():
    for n in (1, 5, 4096, 4097, 50_000, 131_073):
        got = [ensemble.block_draws(1, 2, n, 30_000, b) for b in range(-(-n // ensemble.BLOCK))]
        assert sum(len(g) for g in got) == n and sum(int(g.sum()) for g in got) == 30_000


# ---- connected nodes, k-means ------------------------------------------------------


@pytest.mark.parametrize("kind", ["stars", "mixed", "odd", "none"])
def test_connected_nodes(spark, kind):
    """Equal to a plain union of sets; stars need no round."""
    rng = np.random.default_rng(5)
    mixed = [(i, i + 1) for i in range(100, 160)] + [(7, int(x)) for x in rng.integers(1000, 2000, 300)] + rng.integers(3000, 3400, (150, 2)).tolist() + [(-5, 2000), (2001, -5)]
    pairs = {"stars": [(9, 1), (8, 1), (1, 7), (30, 20)], "mixed": mixed, "odd": [(3, 3), (None, 4), (5, None), (6, 2), (6, 2), (2, 6)], "none": []}[kind]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    made = []

    def keep(df):
        made.append(lineage.cut(df))
        return made[-1]

    found = linked.components(spark.createDataFrame(pairs, "a long, b long"), keep).collect()
    got = {r["node"]: r["root"] for r in found}
    assert len(found) == len(got) and got == {x: find(x) for x in parent if find(x) != x}
    assert kind == "mixed" or len(made) == 1


def test_rounds_of_components_broadcast_nothing(spark):
    """Small as they are, links and labels are joined by merges, not by way of the driver."""
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return lineage.cut(df)

    pairs = [(i, i + 1) for i in range(50)]
    found = linked.components(spark.createDataFrame(pairs, "a long, b long"), keep).collect()
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(1, 51)]
    assert sum("SortMergeJoin" in p for p in plans) > 1 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_kmeans_compares_only_rows_that_may_move(spark, metric):
    """Centres as by a plain loop, round by round; comparisons are counted and fall."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 64)) * 2)[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 64))
    df, start = many(spark, x), x[:40].tolist()
    centers = np.array(start)
    for rounds in range(1, 9):
        away = np.abs(x[:, None] - centers).sum(axis=2) if metric == "manhattan" else ((x[:, None] - centers) ** 2).sum(axis=2)
        cell = away.argmin(axis=1)
        centers = np.array([x[cell == c].mean(axis=0) if (cell == c).any() else np.zeros(64) for c in range(40)])
        if rounds in (1, 2, 8):
            m = cluster.KMeans(40, metric=metric, initial_centers=start, max_iter=rounds, tol=0.0).fit(df)
            assert np.allclose(m.centers, centers, atol=1e-9) and m.n_iter == len(m.compared) == rounds
    assert m.compared[0] == 6000 and min(m.compared[-2:]) < 3000 and sum(m.compared) < 8 * 6000
    assert m.transform(df).where("cluster < 0 or cluster > 39").count() == 0


# ---- components --------------------------------------------------------------------


@pytest.mark.parametrize("scale", [True, False])
def test_pca_of_sixty_four_features(spark, scale):
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 64)) @ r.normal(size=(64, 64)) + 100
    df = vectors(spark, x)
    m = decomposition.PCA(scale=scale).fit(df)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) if scale else 1)
    values, vecs = np.linalg.eigh(z.T @ z / 499)
    assert np.allclose(m.explained_variance, values[::-1], rtol=1e-8)
    assert np.allclose(np.abs(np.array(m.components) @ vecs[:, ::-1]), np.eye(64), atol=1e-6)
    assert abs(sum(m.explained_variance_ratio) - 1) < 1e-12
    part = decomposition.PCA(0.5, scale=scale).fit(df)
    assert sum(part.explained_variance_ratio[:-1]) < 0.5 <= sum(part.explained_variance_ratio)


def test_pca_of_wide_rows_holds_no_square(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 12)) * np.arange(30, 6, -2) @ r.normal(size=(12, 2000)) + 0.1 * r.normal(size=(300, 2000))
    df = many(spark, x)
    monkeypatch.setattr(decomposition, "_by_triangles", None)
    m = decomposition.PCA(8, scale=False).fit(df)
    want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(m.singular_values, want[1][:8], rtol=1e-8)
    assert np.allclose(np.abs((np.array(m.components) * want[2][:8]).sum(axis=1)), 1, atol=1e-8)
    assert np.allclose(m.explained_variance_ratio, (want[1] ** 2 / (want[1] ** 2).sum())[:8], rtol=1e-8)


# ---- trees -------------------------------------------------------------------------


def test_trees_do_not_hang_on_how_values_are_coded(spark):
    """Lists of values or a join; one tree or several; children counted or subtracted."""
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(400, 3)), 2)
    y = np.where(x[:, 0] * x[:, 1] > 0, 1.0, 0.0) + np.where(x[:, 2] > 1, 1.0, 0.0)
    df = spark.createDataFrame([(t, v.tolist(), float(c), float(w)) for t in range(2) for v, c, w in zip(x, y, r.integers(1, 4, 400))], "tree int, x array<double>, y double, w double").repartition(3)
    stats = tree._Classes([0.0, 1.0, 2.0])
    whole = tree.grow(df, 3, stats, tree.Rules(max_depth=6))
    assert len(whole[0]) > 20 and len(whole[1]) > 20
    assert tree.grow(df, 3, stats, tree.Rules(max_depth=6), range_rows=30, dictionary=5) == whole
    stats.exact = False
    assert tree.grow(df, 3, stats, tree.Rules(max_depth=6)) == whole
    some = tree.grow(df, 3, tree._Classes([0.0, 1.0, 2.0]), tree.Rules(max_depth=4, max_features=2, seed=5))
    assert all(n.feature is None or n.feature in tree._tried(tree.Rules(max_features=2, seed=5), 3, t, k) for t, nodes in some.items() for k, n in nodes.items())


# ---- training in order, and on streams ---------------------------------------------


def test_row_order_training_in_chunks_is_the_plain_loop(spark, monkeypatch):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(500, 2)), r.normal(size=500)
    df = spark.createDataFrame([(i, v.tolist(), float(t), "b" if t > 0 else "a") for i, (v, t) in enumerate(zip(x, y))], "row_id long, x array<double>, y double, c string").repartition(4)

    def loop(f, epochs):
        w, errors = np.zeros(3), []
        for _ in range(epochs):
            total = 0.0
            for v, t in zip(x, y):
                e = f(v @ w[:2] + w[2]) - t
                w -= 0.01 * e * np.append(v, 1.0)
                total += 0.5 * e * e
            errors.append(total / len(x))
        return w, errors

    for rows in (64, 1000):
        monkeypatch.setattr(linear, "FOLD_ROWS", rows)
        for f, plain in ((lambda z: z, lambda z: z), (lambda z: vec.relu(z), lambda z: max(z, 0.0)), (math.tanh, math.tanh)):
            w, errors = loop(plain, 3)
            m = linear.SingleNeuron(0.01, 3, activation=f, initial_weights=[0.0] * 3).fit(df)
            assert np.allclose([*m.w, m.b], w, atol=1e-12) and np.allclose(m.errors, errors)
        p = linear.Perceptron(0.5, 2, "x", "c", initial_weights=[0.0] * 3).fit(df)
        w, sign = np.zeros(3), np.where(y > 0, 1.0, -1.0)
        for _ in range(2):
            for v, t in zip(x, sign):
                if t * (v @ w[:2] + w[2]) <= 0:
                    w += 0.5 * t * np.append(v, 1.0)
        assert np.allclose([*p.w, p.b], w, atol=1e-12)
    assert linear.SingleNeuron(0.01, 2, initial_weights=[1.0, 2.0, 3.0]).fit(df.limit(0).unionByName(df.limit(1))).b != 3.0


def test_stream_training_survives_a_restart(spark, tmp_path):
    """Three batches, one of them replayed after a failure: the weights of one run."""
    r = np.random.default_rng(4)
    net = nn.NeuralNetwork(2, None, "regression", learning_rate=0.1, batch_size=1 << 20, max_epochs=1)
    start = nn.NetworkModel(net, {"W2": np.zeros((2, 1)), "b2": np.zeros(1)}, [])
    parts, calls = [], []
    for k in range(3):
        x = r.normal(size=(40, 2))
        parts.append(spark.createDataFrame([(40 * k + i, v.tolist(), float(v[0] - v[1])) for i, v in enumerate(x)], "row_id long, features array<double>, label double"))

    def step(model, rows):
        calls.append(rows.count())
        if len(calls) == 2:
            raise RuntimeError("lost")
        return net.fit(rows, model)

    want = start
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        want = net.fit(part, want)
        stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/rows")
        for _ in range(2):
            q = streaming.train_stream(stream, start, step, f"{tmp_path}/checkpoint", f"{tmp_path}/model").trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception as e:
                assert "lost" in str(e)
    got = streaming.trained(spark, f"{tmp_path}/model", start)
    assert np.allclose(got.weights["W2"], want.weights["W2"], atol=1e-12) and len(calls) == 4
    assert streaming.versions(spark, f"{tmp_path}/model") == [0, 1, 2]
    with pytest.raises(ValueError):
        streaming.train_stream(parts[0], start, step, "c", "p")
