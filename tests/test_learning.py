"""Contracts of the learning operators on small frames, against closed forms and brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.functions import vec
from millrace.operators import cluster, decomposition, ensemble, graph, linear, metrics, neighbors, nn, persist, prep, radius, tree, validate, vote
from millrace.plans import lineage, sums
from millrace.sources import headerless_csv
from millrace.streaming import score_stream


def frame(spark, x, y=None):
    y = [0.0] * len(x) if y is None else y
    kind = "string" if isinstance(y[0], str) else "double"
    rows = [(i, [float(v) for v in r], t if kind == "string" else float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"row_id long, features array<double>, label {kind}")


def values(df, col, key="row_id"):
    return [r[col] for r in df.orderBy(key).collect()]


@pytest.mark.parametrize("n, size, want", [(10, 0.0, 0), (10, 1.0, 10), (5, 0.4, 2), (5, 0.5, 2), (5, 0.6, 3), (7, 0.2857, 2)])
def test_split_rounds_half_to_even(spark, n, size, want):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    train, test = prep.train_test_split(df, size, seed=4)
    a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert len(b) == want and not a & b and len(a | b) == n


def test_scalers_guard_constant_columns_and_invert(spark):
    df = frame(spark, [[1, 5, 0.1], [2, 5, 0.1], [3, 5, 0.1]])
    for s in (prep.standardize_fit(df), prep.minmax_fit(df)):
        assert s.scale[1] == s.scale[2] == 1.0
        back = s.inverse_transform(s.transform(df))
        assert np.allclose(values(back, "features"), values(df, "features"), atol=1e-12)
    assert math.isclose(prep.standardize_fit(df).scale[0], math.sqrt(2 / 3))


def test_validation_errors(spark):
    with pytest.raises(ValueError):
        validate.check_features(frame(spark, [[1, 2], [3]]))
    with pytest.raises(ValueError):
        validate.check_features(frame(spark, [[1, float("nan")]]))
    with pytest.raises(TypeError):
        validate.check_features(spark.createDataFrame([("a",)], "features string"))
    assert validate.cast_lenient(spark.createDataFrame([("1.5",)], "a string"), "a").first()[0] == 1.5
    with pytest.raises(ValueError):
        validate.cast_lenient(spark.createDataFrame([("x",)], "a string"), "a")


def test_votes_and_averages(spark):
    v = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (2, "z", 0.0), (2, "y", 0.0), (3, "q", 2.0), (3, "p", 1.0)], "g int, label string, w double")
    assert {r["g"]: r["vote"] for r in vote.majority_vote(v, ["g"], "label", "w").collect()} == {1: "a", 2: "y", 3: "q"}
    a = spark.createDataFrame([(1, 1.0, 0.0), (1, 3.0, 0.0), (2, 1.0, 3.0), (2, 5.0, 1.0)], "g int, v double, w double")
    assert {r["g"]: r["average"] for r in vote.average_label(a, ["g"], "v", "w").collect()} == {1: 2.0, 2: 2.0}


def test_metrics_of_nothing_are_nan(spark):
    none = spark.createDataFrame([], "y double, p double")
    r = none.agg(metrics.classification_error("y", "p").alias("e"), metrics.mean_squared_error("y", "p").alias("m")).first()
    assert math.isnan(r["e"]) and math.isnan(r["m"])
    same = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    assert same.agg(metrics.r2("y", "p")).first()[0] == 0.0


def test_knn_contracts(spark):
    x = [[1, 1], [2, 0], [0, 2], [1.5, 0.2]]
    df = frame(spark, x, [0, 1, 1, 1])
    q = frame(spark, [[0, 0]])
    assert values(neighbors.KNN(1).fit(df).transform(q), "prediction") == [0.0]
    assert values(neighbors.KNN(1, metric="manhattan").fit(df).transform(q), "prediction") == [1.0]
    mine = lambda a, b: 10.0 * vec.euclidean(a, b, 2)
    assert [r["train_id"] for r in neighbors.KNN(3, metric=mine).fit(df).kneighbors(q).orderBy("rank").collect()] == [0, 3, 1]
    tie = frame(spark, [[0], [0], [1], [1]], [0, 1, 0, 1])
    assert values(neighbors.KNN(2).fit(tie).transform(frame(spark, [[0.5]])), "prediction") == [0.0]
    assert neighbors.KNN(2).fit(tie).transform(frame(spark, [[0.5]]).limit(0)).count() == 0
    words = frame(spark, [[0], [0.1], [5], [5.1]], ["cat", "cat", "dog", "dog"])
    assert values(neighbors.KNN(2, weights="distance").fit(words).transform(frame(spark, [[5.0]])), "prediction") == ["dog"]
    for bad in ({"k": 0}, {"task": "x"}, {"metric": "x"}, {"weights": "x"}):
        with pytest.raises(ValueError):
            neighbors.KNN(**bad)
    with pytest.raises(ValueError):
        neighbors.KNN(5).fit(df)
    with pytest.raises(Exception):
        neighbors.KNN(1).fit(df).transform(frame(spark, [[0, 0, 0]])).collect()


def test_blocked_pairs_equal_broadcast_pairs(spark, monkeypatch):
    a, b = frame(spark, [[i] for i in range(30)]), frame(spark, [[i * 2] for i in range(20)])
    want = sorted(map(tuple, neighbors.pairwise(a, b).collect()))
    monkeypatch.setattr(neighbors, "small", lambda df, rows=0: False)
    assert sorted(map(tuple, neighbors.pairwise(a, b).collect())) == want


def test_several_distances_of_a_pair_at_once(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    rows = spark.createDataFrame([(i, [None, *v[1:].tolist()] if i == 3 else v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    got = neighbors.pairwise(rows.where("row_id < 9"), rows, {"e": "Euclidean", "m": "manhattan"})
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r["a_id"], r["b_id"]): (r["e"], r["m"]) for r in got.collect()}
    assert len(got) == 9 * 40
    for (i, j), found in got.items():
        away = x[i] - x[j]
        assert found == (None, None) if 3 in (i, j) else np.allclose(found, (np.sqrt((away**2).sum()), abs(away).sum()))


def test_callable_neighbours_leave_each_block_as_the_best(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 7)
    x = np.random.default_rng(9).integers(0, 4, size=(50, 3)).astype(float)  # many ties
    rows = frame(spark, x.tolist(), list(range(50)))
    got = neighbors.KNN(4, metric=lambda a, b: abs(a - b).max()).fit(rows).kneighbors(rows.where("row_id % 5 = 0"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Join" not in plan  # no row per pair
    got = sorted((r["query_id"], r["rank"], r["train_id"], r["dist"], r["label"]) for r in got.collect())
    want = []
    for i in range(0, 50, 5):
        near = sorted((abs(x[i] - v).max(), j) for j, v in enumerate(x))[:4]
        want += [(i, n + 1, j, d, float(j)) for n, (d, j) in enumerate(near)]
    assert got == want


def test_logistic(spark):
    df = frame(spark, [[-2], [-1], [1], [2]], ["neg", "neg", "pos", "pos"])
    m = linear.LogisticRegression(0.1, 60, "features", "label", seed=0).fit(df)
    assert m.losses[-1] < m.losses[0] and m.score(df) == 1.0
    half = linear.LogisticModel(m.params, [0.0], 0.0, m.labels)
    assert set(values(half.transform(df), "prediction")) == {"pos"}
    with pytest.raises(ValueError):
        linear.LogisticRegression(features="features", label="label").fit(frame(spark, [[1], [2], [3]], [0, 1, 2]))


def test_row_order_models_match_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    y = np.where(x @ [1.0, -2.0] + 0.3 > 0, 1.0, 0.0)
    m = linear.Perceptron(0.7, 3, "features", "label", initial_weights=[0, 0, 0]).fit(frame(spark, x, y))
    w, b = np.zeros(2), 0.0
    for _ in range(3):
        for xi, yi in zip(x, y):
            t = 1 if yi else -1
            if t * (xi @ w + b) <= 0:
                w, b = w + 0.7 * t * xi, b + 0.7 * t
    assert np.allclose(m.w, w) and math.isclose(m.b, b, abs_tol=1e-12)
    n = linear.SingleNeuron(0.1, 2, features="features", target="label", initial_weights=[0, 0, 0]).fit(frame(spark, x, x[:, 0]))
    w, b, errors = np.zeros(2), 0.0, []
    for _ in range(2):
        total = 0.0
        for xi in x:
            e = xi @ w + b - xi[0]
            total += 0.5 * e * e
            w, b = w - 0.1 * e * xi, b - 0.1 * e
        errors.append(total / len(x))
    assert np.allclose([*n.w, n.b], [*w, b]) and np.allclose(n.errors, errors)


def test_tree_step_ties_and_leaf_limits(spark):
    m = tree.DecisionTreeClassifier(max_depth=2).fit(frame(spark, [[0], [1], [2], [3]], [0, 0, 1, 1]))
    assert m.nodes[1].threshold == 1.5 and m.score(frame(spark, [[0], [3]], [0, 1])) == 1.0
    xor = frame(spark, [[0, 0], [0, 1], [1, 0], [1, 1]], [0, 1, 1, 0])
    assert list(tree.DecisionTreeClassifier().fit(xor).nodes) == [1]
    same = tree.DecisionTreeClassifier(max_depth=1).fit(frame(spark, [[0, 0], [1, 1]], [0, 1]))
    assert same.nodes[1].feature == 0
    leaf = tree.DecisionTreeClassifier(min_samples_leaf=2).fit(frame(spark, [[0], [1], [2]], [0, 1, 1]))
    assert list(leaf.nodes) == [1]
    with pytest.raises(ValueError):
        tree.DecisionTreeClassifier(max_depth=0)
    with pytest.raises(ValueError):
        tree.DecisionTreeClassifier().set_params(nope=1)


def test_regression_tree(spark):
    df = frame(spark, [[0], [1], [2], [3]], [1, 1, 3, 3])
    m = tree.DecisionTreeRegressor(max_depth=1).fit(df)
    assert values(m.transform(df), "prediction") == [1.0, 1.0, 3.0, 3.0] and m.score(df) == 1.0
    assert m.feature_importances == [1.0]
    assert list(tree.DecisionTreeRegressor(max_depth=0).fit(df).nodes) == [1]
    with pytest.raises(TypeError):
        tree.DecisionTreeRegressor(max_features=True)


def test_bagging_aligns_missing_classes(spark):
    df = frame(spark, [[i / 20] for i in range(20)], [0] * 19 + [1])
    m = ensemble.BaggingClassifier(4, 0.3, seed=1, base=tree.DecisionTreeClassifier(max_depth=2)).fit(df)
    p = np.array(values(m.transform(df), "probability"))
    assert p.shape == (20, 2) and np.allclose(p.sum(axis=1), 1)
    total = m.trees and sum(n.n for n in [t[1] for t in m.trees.values()])
    assert total == 4 * 6


def test_kmeans_and_empty_cluster(spark):
    df = frame(spark, [[0, 0], [0, 1], [5, 5], [5, 6]])
    m = cluster.KMeans(3, initial_centers=[[0.0, 0.0], [5.0, 5.0], [99.0, 99.0]], max_iter=1).fit(df)
    assert m.centers == [[0.0, 0.5], [5.0, 5.5], [0.0, 0.0]]
    assert len(set(values(cluster.KMeans(2, metric="Manhattan", seed=3).fit(df).transform(df), "cluster"))) == 2
    with pytest.raises(TypeError):
        cluster.KMeans(2, tol=1)


def brute_dbscan(x, eps, least, p):
    dist = np.linalg.norm(x[:, None] - x[None], ord=p, axis=2) <= eps
    core = dist.sum(axis=1) >= least
    label, k = np.zeros(len(x), int), 0
    for i in range(len(x)):
        if core[i] and not label[i]:
            k += 1
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j]:
                    continue
                label[j] = k
                if core[j]:
                    todo += [n for n in np.flatnonzero(dist[j]) if not label[n]]
    return label.tolist()


@pytest.mark.parametrize("metric, p, d", [("euclidean", 2, 2), ("manhattan", 1, 2), ("euclidean", 2, 4)])
def test_dbscan_matches_brute_force(spark, metric, p, d):
    x = np.round(np.random.default_rng(d).uniform(0, 4, (60, d)), 1)
    got = values(cluster.DBSCAN(0.75 * d / 2, 4, metric).fit_predict(frame(spark, x)), "cluster")
    assert got == brute_dbscan(x, 0.75 * d / 2, 4, p)


def test_pca(spark):
    x = np.random.default_rng(0).normal(size=(50, 3)) @ np.diag([3, 1, 0.1])
    df = frame(spark, x)
    m = decomposition.PCA(scale=False).fit(df)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(m.singular_values, want) and math.isclose(sum(m.explained_variance_ratio), 1)
    assert m.score(df) > -1e-20
    share = np.cumsum(want**2) / (want**2).sum()
    for part in (0.5, 0.97, 0.9999):
        assert len(decomposition.PCA(part, scale=False).fit(df).components) == int((share < part).sum()) + 1


def test_label_propagation(spark):
    v = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "id string, pos long")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("b", "a")], "src string, dst string")
    labels = graph.LabelPropagation(20).run(v, e)
    got = {r["id"]: r["community"] for r in graph.compress(labels).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"]
    with pytest.raises(ValueError):
        graph.LabelPropagation(5).run(v.union(v), e)
    with pytest.raises(ValueError):
        graph.LabelPropagation(5).run(v.limit(1), e)
    assert graph.LabelPropagation(5).run(v.limit(0), e.limit(0)).count() == 0


def test_network_matches_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(12, 3)), rng.integers(0, 3, 12)
    net = nn.NeuralNetwork(3, 4, n_classes=3, learning_rate=0.2, batch_size=5, max_epochs=2, shuffle=False)
    m = net.fit(frame(spark, x, y))
    w = {k: v.copy() for k, v in net.initial().weights.items()}
    for _ in range(2):
        for i in range(0, 12, 5):
            g, _ = nn.gradients(w, x[i : i + 5], y[i : i + 5], "classification")
            w = {k: w[k] - 0.2 * g[k] / len(x[i : i + 5]) for k in w}
    assert all(np.allclose(m.weights[k], w[k]) for k in w)
    p = np.array(values(m.transform(frame(spark, x, y)), "output"))
    assert np.allclose(p, nn.forward(w, x, "classification")[0])
    with pytest.raises(ValueError):
        nn.NeuralNetwork(2, 3)


def test_images_and_vectors(spark):
    df = spark.createDataFrame([(1, [[1, 2], [3, 4]])], "i int, image array<array<int>>")
    assert prep.flatten_images(df).first()["features"] == [1.0, 2.0, 3.0, 4.0]
    r = spark.range(1).select(vec.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"), vec.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"), vec.sigmoid(F.lit(-1e4)).alias("g")).first()
    assert r["s"] == [0.5, 0.5] and r["a"] == 1 and r["g"] == 0.0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_vector_pairs_are_all_pairs_whatever_the_cells(spark, metric):
    r = np.random.default_rng(5)
    x = np.concatenate((r.normal(size=(150, 6)), 5 + 0.3 * r.normal(size=(150, 6)), np.ones((20, 6))))
    eps = 1.0 if metric == "euclidean" else 2.0
    dist = np.linalg.norm(x[:, None] - x[None], ord=2 if metric == "euclidean" else 1, axis=2)
    want = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if dist[i, j] <= eps]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "a long, x array<double>").repartition(3)
    got = radius.vector_pairs(rows, eps, metric, cell_rows=30, block_rows=16)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert radius.vector_pairs(rows.limit(0), eps, metric).count() == 0
    far = spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0]), (2, [1e9 + 1, 0.0, 0.0, 0.0]), (3, [1e9 + 2.5, 0.0, 0.0, 0.0])], "a long, x array<double>")
    assert [tuple(p) for p in radius.vector_pairs(far, 1.0, metric).collect()] == [(1, 2)]


def test_wide_models_agree_with_narrow_plans(spark, monkeypatch):
    r = np.random.default_rng(7)
    x = r.normal(size=(80, 5))
    df = frame(spark, x, (x[:, 0] > 0).astype(float))
    start = x[:3].tolist()
    km = cluster.KMeans(3, initial_centers=start, max_iter=5).fit(df)
    narrow = values(km.transform(df), "cluster")
    m = decomposition.PCA(2).fit(df)
    p = values(m.transform(df), "pca")
    log = linear.LogisticRegression(0.3, 4, "features", "label", initial_weights=[0.1] * 6).fit(df)
    scale = prep.standardize_fit(df)
    net = nn.NeuralNetwork(5, 3, n_classes=2).initial()
    out = values(net.transform(df), "output")
    for module, name in ((cluster, "WIDE"), (decomposition, "WIDE"), (nn, "WIDE"), (vec, "UNROLL")):
        monkeypatch.setattr(module, name, 0)
    wide = cluster.KMeans(3, initial_centers=start, max_iter=5).fit(df)
    assert np.allclose(wide.centers, km.centers) and values(wide.transform(df), "cluster") == narrow
    assert np.allclose(values(m.transform(df), "pca"), p)
    assert np.allclose(values(m.inverse_transform(m.transform(df)), "restored"), np.array(p) @ np.array(m.components) * m.scaler.scale + m.scaler.shift)
    again = linear.LogisticRegression(0.3, 4, "features", "label", initial_weights=[0.1] * 6).fit(df)
    assert np.allclose([*again.w, again.b], [*log.w, log.b]) and np.allclose(again.losses, log.losses)
    assert np.allclose(prep.standardize_fit(df).scale, scale.scale) and np.allclose(values(net.transform(df), "output"), out)


def test_models_of_hundreds_of_features(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, 784)), r.integers(0, 10, 60)
    df = frame(spark, x, y)
    m = decomposition.PCA(5, scale=False).fit(df)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:5]
    assert np.allclose(m.singular_values, want) and len(values(m.transform(df), "pca")[0]) == 5
    net = nn.NeuralNetwork(784, 256, n_classes=10, batch_size=32, max_epochs=1)
    fitted = net.fit(df)
    assert np.allclose(values(fitted.transform(df), "output"), nn.forward(fitted.weights, x, "classification")[0])
    km = cluster.KMeans(4, max_iter=2).fit(df)
    assert set(values(km.transform(df), "cluster")) <= set(range(4))


def test_vector_sum(spark):
    df = spark.range(1000).repartition(7).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    wide = lambda b: np.tile(sums.matrix(b.column("x")).sum(axis=0), 10_000)
    assert np.array_equal(sums.vector_sum(df, wide, salts=2), np.tile([499500.0, 1000.0], 10_000))
    assert sums.vector_sum(df.limit(0), wide) is None


def test_trees_do_not_hang_on_value_ranges(spark):
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(300, 3)), 1)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, 0.0)
    rows = lambda df: df.select(F.lit(0).alias("tree"), F.col("features").alias("x"), F.col("label").alias("y"), F.lit(1.0).alias("w"))
    df = rows(frame(spark, x, y))
    whole = tree.grow(df, 3, tree._Classes([0.0, 1.0]), tree.Rules())
    assert tree.grow(df, 3, tree._Classes([0.0, 1.0]), tree.Rules(), range_rows=20) == whole
    assert len(whole[0]) > 20


def test_deep_and_large_trees(spark):
    n = 90
    df = frame(spark, [[2.0**-i] for i in range(n)], [i % 2 for i in range(n)])
    m = tree.DecisionTreeClassifier().fit(df)
    assert m.score(df) == 1.0 and len(tree.leaf_numbers(m.nodes)) > tree.WIDE
    assert m.node_table(spark).count() == len(m.nodes)
    assert all(sum(p) == 1 for p in values(m.transform(df), "probability"))


def test_networks_take_chunks_in_order(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=50)
    df = frame(spark, x, y)
    want = None
    for chunk in (65_536, 14, 7, 1):  # one chunk, several, one batch in each, spread batches
        monkeypatch.setattr(nn, "CHUNK_ROWS", chunk)
        m = nn.NeuralNetwork(3, 4, "regression", learning_rate=0.05, batch_size=7, max_epochs=2).fit(df)
        got = np.concatenate([m.weights[k].ravel() for k in sorted(m.weights)] + [m.losses])
        want = got if want is None else want
        assert np.allclose(got, want)


def test_wide_vectors_meet_in_blocks_once(spark):
    x = np.random.default_rng(6).normal(size=(600, 24))
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "a long, x array<double>").repartition(3)
    met = radius.blocks(rows, 5.0, "euclidean", cell_rows=15, block_rows=100)
    assert met.count() == 600 * 7  # six blocks; cells of 15 rows would be visited by most rows
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if dist[i, j] <= 5.0}
    got = [tuple(p) for p in radius.vector_pairs(rows, 5.0, "euclidean", cell_rows=15, block_rows=100).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_visitors_leave_in_small_batches():
    x = np.zeros((5000, 3))
    pivots = np.arange(300.0).reshape(100, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(np.zeros(5000, np.int64))], names=["x", "cell"])
    got = [b.num_rows for b in radius._visits(pivots, np.full(100, np.inf), "euclidean")(iter([batch]))]
    assert sum(got) == 5000 * 100 and max(got) <= radius.VISITS


def test_shared_orders_shuffle_by_the_number_of_lines(spark, sf_dir, monkeypatch):
    key, seen = "spark.sql.shuffle.partitions", []
    monkeypatch.setattr(lineage, "TASK_ROWS", 100)
    monkeypatch.setattr(queries, "cut", lambda df: seen.append(int(spark.conf.get(key))) or lineage.cut(df))
    before = spark.conf.get(key)
    queries._edges(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert seen == [-(-lines // 100)] and spark.conf.get(key) == before
    with pytest.raises(RuntimeError), lineage.spread(spark, 10):
        assert spark.conf.get(key) == before  # never fewer
        raise RuntimeError
    assert spark.conf.get(key) == before


def test_equal_vectors_are_one_row_of_sums_in_trees(spark, monkeypatch):
    r = np.random.default_rng(3)
    x, y = r.integers(0, 4, (500, 2)), r.integers(0, 50, 500)
    rows = spark.createDataFrame([(0, v.tolist(), float(t), 1.0) for v, t in zip(x.astype(float), y)], "tree int, x array<double>, y double, w double")
    stats = tree._Moments(0.0)
    held = tree.coded(rows, 2, stats=stats, cells=16)[0]
    assert held.count() == 16 and held.agg(F.sum("m0"), F.sum("m1")).first()[:] == (500.0, float(y.sum()))
    assert tree.coded(rows, 2, stats=stats, cells=15)[0].count() == 500
    rules = tree.Rules(max_depth=3, max_features=1, draw=lambda t, n: [n % 2])
    some = tree.grow(rows, 2, stats, rules)
    monkeypatch.setattr(tree, "CELLS", 0)
    assert tree.grow(rows, 2, stats, rules) == some and len(some[0]) > 5


def test_shared_orders_keep_their_partitions(spark, sf_dir, monkeypatch):
    key, seen = "spark.sql.adaptive.coalescePartitions.enabled", []
    monkeypatch.setattr(lineage, "TASK_ROWS", 100)
    monkeypatch.setattr(queries, "cut", lambda df: seen.append(df.rdd.getNumPartitions()) or lineage.cut(df))
    before = spark.conf.get(key)
    queries._edges(spark, sf_dir)
    assert seen == [-(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100)] and spark.conf.get(key) == before
    with lineage.spread(spark, 100):  # one task's worth
        assert spark.conf.get(key) == before


def test_plain_callables(spark):
    x = [[1, 1], [2, 0], [0, 2], [1.5, 0.2]]
    df = frame(spark, x, [0, 1, 1, 1])
    far = neighbors.KNN(3, metric=lambda a, b: float(np.linalg.norm(a - b))).fit(df).kneighbors(frame(spark, [[0, 0]]))
    assert [r["train_id"] for r in far.orderBy("rank").collect()] == [0, 3, 1]
    d = neighbors.pairwise(df, df, lambda a, b: max(abs(a - b))).where("a_id = 0 and b_id = 2").first()["dist"]
    assert d == 1.0
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 2))
    rows = frame(spark, v, np.tanh(v[:, 0]))
    same = [linear.SingleNeuron(0.1, 3, f, "features", "label", initial_weights=[0.2, 0.1, 0.0]).fit(rows) for f in (math.tanh, F.tanh)]
    assert np.allclose([*same[0].w, same[0].b, *same[0].errors], [*same[1].w, same[1].b, *same[1].errors])
    assert np.allclose(values(same[0].transform(rows), "prediction"), values(same[1].transform(rows), "prediction"))


def test_models_are_saved_and_loaded(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 3))
    df = frame(spark, x, (x[:, 0] > 0).astype(float))
    models = [
        tree.DecisionTreeClassifier(max_depth=3).fit(df), ensemble.BaggingClassifier(2).fit(df), cluster.KMeans(2, max_iter=3).fit(df), decomposition.PCA(2).fit(df),
        linear.LogisticRegression(0.1, 3, "features", "label", seed=1).fit(df), nn.NeuralNetwork(3, 2, n_classes=2).initial(),
    ]
    for i, m in enumerate(models):
        persist.save(spark, m, f"{tmp_path}/m{i}")
        back = persist.load(spark, f"{tmp_path}/m{i}")
        assert sorted(map(str, back.transform(df).collect())) == sorted(map(str, m.transform(df).collect()))
    with pytest.raises(TypeError):
        persist.save(spark, linear.SingleNeuron(), f"{tmp_path}/f")


def test_shaping_sampling_and_generating(spark):
    df = spark.range(20).withColumnRenamed("id", "row_id")
    assert prep.as_vectors(df, "row_id").first()["features"] == [0.0]
    with pytest.raises(ValueError):
        prep.as_vectors(df.limit(0), "row_id")
    with pytest.raises(TypeError):
        prep.as_vectors(spark.createDataFrame([("a",)], "s string"), "s")
    one = values(prep.sample_rows(df, 6, seed=2), "row_id")
    assert len(set(one)) == 6 and one == values(prep.sample_rows(df.repartition(5), 6, seed=2), "row_id") and prep.sample_rows(df, 99).count() == 20
    assert values(prep.head(df, 3, F.desc("row_id")), "row_id") == [17, 18, 19]
    g = values(prep.grid(spark, [(0, 1, 2), (0, 4, 3)]), "features")
    assert g == [[0, 0], [0, 2], [0, 4], [1, 0], [1, 2], [1, 4]]
    b = prep.blobs(spark, 400, [[0.0, 0.0], [10.0, 0.0]], 0.5, seed=1)
    x, y = np.array(values(b, "features")), np.array(values(b, "label"))
    assert np.allclose(x[y == 1].mean(axis=0), [10, 0], atol=0.15) and abs(x[y == 0].std() - 0.5) < 0.06
    x, y = np.array(values(prep.rings(spark, 200, "circles", factor=0.4), "features")), np.arange(200) % 2
    assert np.allclose(np.linalg.norm(x, axis=1), np.where(y, 0.4, 1.0))
    assert np.array(values(prep.rings(spark, 200, noise=0.05), "features")).shape == (200, 2)


def test_csv_streams_and_best_parameters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2.5,x\n2,,y\n")
    got = headerless_csv(spark, str(tmp_path / "a.csv"), {"i": "int", "v": "double", "s": "string"})
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(1, 2.5, "x"), (2, None, "y")]
    df = frame(spark, [[1.0], [-1.0]])
    df.write.parquet(f"{tmp_path}/in")
    model = linear.PerceptronModel(linear.Perceptron(features="features"), [1.0], 0.0, [0, 1])
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    score_stream(stream, model, f"{tmp_path}/check", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert values(spark.read.parquet(f"{tmp_path}/out"), "prediction") == [1, 0]
    with pytest.raises(ValueError):
        score_stream(df, model, "a", "b")
    s = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "param int, score double")
    assert metrics.best_param(s).first()["param"] == 2 and metrics.best_param(s, largest=False).first()["param"] == 1


def test_cuts_are_tables_that_can_be_dropped(spark):
    df = lineage.cut(spark.range(10))
    assert df.count() == 10
    lineage.drop(df)
    with pytest.raises(Exception):
        df.count()


def test_propagation_waves_and_ties(spark):
    v = spark.createDataFrame([(i, i) for i in range(6)], "id long, pos long")
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5), (5, 3)], "src long, dst long")
    got = {r["id"]: r["label"] for r in graph.LabelPropagation(6, waves=2).run(v, e, wave=F.col("id") % 2, ties="smallest").collect()}
    assert got[3] == got[4] == got[5] and len({got[0], got[1], got[2]}) == 1
    with pytest.raises(ValueError):
        graph.LabelPropagation(1).run(v, e, ties="x")
