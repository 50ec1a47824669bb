"""Registered queries of the learning operators and their SQL.

Keys start with the inventory ids that a query covers. Every query reads whole
tables; neighbour searches ask for the rows whose id is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import vec
from millrace.operators import cluster, decomposition, ensemble, graph, linear, metrics, neighbors, nn, prep, tree, validate, vote
from millrace.plans.lineage import cut, shared_dir, spread
from millrace.sources import headerless_csv, table
from millrace.streaming import train_stream, trained

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return prep.xy_frame(table(spark, d, "lineitem"), LINE, "l_quantity", "features", "label", *KEY)


def _r(c, digits: int = 6):
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _sr(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)::DOUBLE"


# ---- scaling, splitting, shaping ---------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_sr(f'avg({c})', 4)} AS mean, {_sr(f'CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE stddev_pop({c}) END', 4)} AS std FROM lineitem" for c in LINE))
def A1_standardize_fit(spark, d):
    s = prep.standardize_fit(_lines(spark, d))
    return spark.createDataFrame(list(zip(LINE, s.shift, s.scale)), "feature string, mean double, std double").select("feature", _r("mean", 4).alias("mean"), _r("std", 4).alias("std"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(f"{_sr(f'({c} - m{i}) / s{i}')} AS z{i}" for i, c in enumerate(LINE)) + " FROM lineitem, (SELECT " + ", ".join(f"avg({c}) AS m{i}, CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE stddev_pop({c}) END AS s{i}" for i, c in enumerate(LINE)) + " FROM lineitem)")
def P1_standardize_transform(spark, d):
    rows = _lines(spark, d)
    z = prep.standardize_fit(rows).transform(rows)
    return z.select(*KEY, *(_r(F.col("features")[i]).alias(f"z{i}") for i in range(4)))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_sr(f'min({c})', 4)} AS low, {_sr(f'CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE max({c}) - min({c}) END', 4)} AS span FROM lineitem" for c in LINE))
def A2_minmax_fit(spark, d):
    s = prep.minmax_fit(_lines(spark, d))
    return spark.createDataFrame(list(zip(LINE, s.shift, s.scale)), "feature string, low double, span double").select("feature", _r("low", 4).alias("low"), _r("span", 4).alias("span"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(f"{_sr(f'({c} - m{i}) / s{i}')} AS z{i}" for i, c in enumerate(LINE)) + " FROM lineitem, (SELECT " + ", ".join(f"min({c}) AS m{i}, CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE max({c}) - min({c}) END AS s{i}" for i, c in enumerate(LINE)) + " FROM lineitem)")
def P2_minmax_transform(spark, d):
    rows = _lines(spark, d)
    z = prep.minmax_fit(rows).transform(rows)
    return z.select(*KEY, *(_r(F.col("features")[i]).alias(f"z{i}") for i in range(4)))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(f"{_sr(c)} AS x{i}" for i, c in enumerate(LINE)) + " FROM lineitem")
def P17_inverse_scaling(spark, d):
    rows = _lines(spark, d)
    s = prep.standardize_fit(rows)
    back = s.inverse_transform(s.transform(rows))
    return back.select(*KEY, *(_r(F.col("features")[i]).alias(f"x{i}") for i in range(4)))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) <= round_even(0.25 * (SELECT count(*) FROM customer), 0) AS is_test FROM customer")
def R1_split_ordered(spark, d):
    return prep.mark_test(table(spark, d, "customer"), 0.25, shuffle=False, row_id="c_custkey").select("c_custkey", "is_test")


@query("SELECT c_custkey, row_number() OVER (ORDER BY (c_custkey * 7919 + 13) % 104729, c_custkey) <= round_even(0.3 * (SELECT count(*) FROM customer), 0) AS is_test FROM customer")
def R1_split_shuffled(spark, d):
    order = (F.col("c_custkey") * 7919 + 13) % 104729
    return prep.mark_test(table(spark, d, "customer"), 0.3, row_id="c_custkey", order=order).select("c_custkey", "is_test")


@query("SELECT p_partkey, len(x)::BIGINT AS n, x[1]::DOUBLE AS x0, x[2]::DOUBLE AS x1, p_type AS y FROM (SELECT p_partkey, [p_size::DOUBLE, p_retailprice::DOUBLE] AS x, p_type FROM part)")
def S6_xy_frame(spark, d):
    f = prep.xy_frame(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_type", "x", "y", "p_partkey")
    return f.select("p_partkey", F.size("x").cast("long").alias("n"), F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "y")


@query(f"SELECT vec_id, count(*) AS n, {_sr('sum(i * v)', 5)} AS ramp FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id")
def S7_flatten_images(spark, d):
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    flat = prep.flatten_images(table(spark, d, "embeddings").withColumn("image", image))
    ramp = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return flat.select("vec_id", F.size("features").cast("long").alias("n"), _r(ramp, 5).alias("ramp"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT isfinite(l_extendedprice) OR l_extendedprice IS NULL) AS n_bad, 4::BIGINT AS width FROM lineitem")
def S2_P15_validate(spark, d):
    rows = _lines(spark, d)
    width = validate.check_features(rows)
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~vec.finite(F.col("features"))).alias("n_bad"), F.lit(width).cast("long").alias("width"))


# ---- distances and neighbours --------------------------------------------------

_LONG = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_PAIRS = f"WITH {_LONG}, p AS (SELECT a.vec_id AS q, b.vec_id AS t, any_value(b.label) AS label, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS euc, sum(abs(a.v - b.v)) AS man FROM e a JOIN e b ON a.i = b.i WHERE a.vec_id % 100 = 0 GROUP BY ALL)"
_PAIRS = _PAIRS.replace(" GROUP BY ALL", " GROUP BY a.vec_id, b.vec_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))


@query(f"WITH {_LONG} SELECT a.vec_id, {_sr('sqrt(sum((a.v - b.v) * (a.v - b.v)))')} AS euclid, {_sr('sum(abs(a.v - b.v))')} AS manhattan FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id")
def F1_F2_distance(spark, d):
    """Distances between consecutive vectors."""
    a = _vectors(spark, d)
    b = a.select((F.col("row_id") - 1).alias("row_id"), F.col("features").alias("g"))
    both = a.join(b, "row_id")
    return both.select(F.col("row_id").alias("vec_id"), _r(vec.euclidean(F.col("features"), F.col("g"), 64)).alias("euclid"), _r(vec.manhattan(F.col("features"), F.col("g"), 64)).alias("manhattan"))


@query(f"{_PAIRS} SELECT q AS a_id, t AS b_id, {_sr('euc')} AS euclid, {_sr('man')} AS manhattan FROM p")
def J1_J2_pairwise(spark, d):
    v = _vectors(spark, d)
    q = v.where("row_id % 100 = 0")
    both = neighbors.pairwise(q, v, {"e": "euclidean", "m": "manhattan"})
    return both.select("a_id", "b_id", _r("e").alias("euclid"), _r("m").alias("manhattan"))


@query(f"{_PAIRS} SELECT q AS query_id, rank, t AS train_id, {_sr('euc')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY euc, t)::INTEGER AS rank FROM p) WHERE rank <= 7")
def J3_J4_kneighbors(spark, d):
    v = _vectors(spark, d)
    got = neighbors.KNN(7).fit(v).kneighbors(v.where("row_id % 100 = 0"))
    return got.select("query_id", "rank", "train_id", _r("dist").alias("dist"))


def _knn_sql(dist: str, weight: str, k: int, regression: bool) -> str:
    top = f"{_PAIRS}, k AS (SELECT q, label::DOUBLE AS label, {weight} AS w FROM (SELECT *, {dist} AS dist, row_number() OVER (PARTITION BY q ORDER BY {dist}, t) AS r FROM p) WHERE r <= {k})"
    if regression:
        return f"{top} SELECT q AS row_id, {_sr('sum(w * label) / sum(w)', 4)} AS prediction FROM k GROUP BY q"
    return f"{top} SELECT q AS row_id, label AS prediction FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY round(sum(w), 9) DESC, label) AS r FROM k GROUP BY q, label) WHERE r = 1"


def _knn(spark: SparkSession, d: str, **options) -> DataFrame:
    v = _vectors(spark, d)
    got = neighbors.KNN(**options).fit(v).transform(v.where("row_id % 100 = 0").drop("label"))
    return got.select("row_id", "prediction")


@query(_knn_sql("euc", "1.0", 5, False))
def M1_knn_classify_uniform(spark, d):
    return _knn(spark, d, k=5)


@query(_knn_sql("man", "1.0 / (dist + 1e-12)", 7, False))
def M1_knn_classify_distance(spark, d):
    return _knn(spark, d, k=7, metric="manhattan", weights="distance")


@query(_knn_sql("euc", "1.0", 6, True))
def M1_knn_regress(spark, d):
    got = _knn(spark, d, k=6, task="regression")
    return got.select("row_id", _r("prediction", 4).alias("prediction"))


# ---- votes ---------------------------------------------------------------------


@query("SELECT user_id, event_type AS vote FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY round(sum(value), 9) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def A3_majority_vote(spark, d):
    return vote.majority_vote(table(spark, d, "events"), ["user_id"], "event_type", "value")


@query(f"SELECT l_suppkey, {_sr('CASE WHEN sum(l_quantity) = 0 THEN avg(l_discount) ELSE sum(l_quantity * l_discount) / sum(l_quantity) END')} AS average FROM lineitem GROUP BY l_suppkey")
def A4_weighted_average(spark, d):
    got = vote.average_label(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity")
    return got.select("l_suppkey", _r("average").alias("average"))


# ---- metrics ---------------------------------------------------------------------

_SCORED = "(SELECT d.doc_id, l.quality AS y, (d.n_chars >= 1000)::INTEGER AS p, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS q FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    n = F.col("n_chars")
    return both.select("doc_id", F.col("quality").alias("y"), (n >= 1000).cast("int").alias("p"), (n / (n + F.lit(1000.0))).alias("q"))


@query(f"SELECT {_sr('1 - avg((y = p)::INTEGER)')} AS error, {_sr('avg((y = p)::INTEGER)')} AS accuracy, {_sr('sum((y <> p)::INTEGER)')} AS mistakes, {_sr('-avg(y * ln(q + 1e-12::DOUBLE) + (1 - y) * ln(1 - q + 1e-12::DOUBLE))')} AS cross_entropy FROM {_SCORED}")
def A5_A7_A10_A11_classification(spark, d):
    return _scored(spark, d).agg(_r(metrics.classification_error("y", "p")).alias("error"), _r(metrics.accuracy("y", "p")).alias("accuracy"), _r(metrics.mistakes("y", "p")).alias("mistakes"), _r(metrics.binary_cross_entropy("y", "q")).alias("cross_entropy"))


_REG = "(SELECT l_extendedprice / 1000.0::DOUBLE AS y, l_quantity * 1.5::DOUBLE AS p FROM lineitem)"


@query(f"SELECT {_sr('avg((y - p) * (y - p))', 4)} AS mse, {_sr('avg((y - p) * (y - p)) / 2', 4)} AS half_mse, {_sr('sqrt(avg((y - p) * (y - p)))', 4)} AS rmse, {_sr('-avg((y - p) * (y - p))', 4)} AS neg_mse, {_sr('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))', 4)} AS r2 FROM {_REG}")
def A6_A8_A9_A13_A41_regression(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))
    mse = metrics.mean_squared_error("y", "p")
    return rows.agg(_r(mse, 4).alias("mse"), _r(metrics.half_mse("y", "p"), 4).alias("half_mse"), _r(metrics.rmse("y", "p"), 4).alias("rmse"), _r(-mse, 4).alias("neg_mse"), _r(metrics.r2("y", "p"), 4).alias("r2"))


@query(f"WITH {_LONG}, s AS (SELECT vec_id, any_value(label) AS label, sum(exp(v)) AS z FROM e WHERE i <= 10 GROUP BY vec_id), p AS (SELECT s.vec_id, exp(e.v) / s.z AS p FROM s JOIN e ON e.vec_id = s.vec_id AND e.i = s.label + 1) SELECT {_sr('-avg(ln(greatest(p, 1e-12::DOUBLE)))')} AS cross_entropy, count(*) AS n FROM p")
def A12_F6_softmax_cross_entropy(spark, d):
    v = _vectors(spark, d).select("label", vec.softmax(F.slice("features", 1, 10)).alias("p"))
    return v.agg(_r(metrics.cross_entropy("label", "p")).alias("cross_entropy"), F.count("*").alias("n"))


@query(f"WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_type, sum(n) AS t FROM c GROUP BY p_type), m AS (SELECT p_type, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r FROM c) WHERE r = 1) SELECT c.p_type, {_sr('-sum(n / t * log2(n / t))')} AS entropy, any_value(m.p_brand) AS majority, any_value(t)::BIGINT AS n, count(*) AS n_classes FROM c JOIN t USING (p_type) JOIN m USING (p_type) GROUP BY c.p_type".replace("n / t", "n::DOUBLE / t"))
def A14_A15_A16_impurity(spark, d):
    """Entropy, majority class and class count of brands within each type."""
    got = metrics.node_counts(table(spark, d, "part"), ["p_type"], "p_brand")
    return got.select("p_type", _r("entropy").alias("entropy"), "majority", "n", "n_classes")


@query(f"SELECT y AS label, p AS predicted, count(*) AS n FROM {_SCORED} GROUP BY ALL")
def A38_confusion(spark, d):
    return metrics.confusion(_scored(spark, d), "y", "p")


@query(f"WITH s AS {_SCORED}, k AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (WHERE y = label) AS support, count(*) FILTER (WHERE p = label) AS pn, count(*) FILTER (WHERE y = label AND p = label) AS hit FROM s, k GROUP BY label) SELECT label, {_sr('hit / pn::DOUBLE')} AS precision, {_sr('hit / support::DOUBLE')} AS recall, {_sr('2.0 * hit / (pn + support)')} AS f1, support::BIGINT AS support FROM c")
def A39_class_report(spark, d):
    got = metrics.class_report(_scored(spark, d), "y", "p")
    return got.select("label", _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"), F.col("support").cast("long").alias("support"))


@query(f"WITH t AS (SELECT label AS a, vec_id % 10 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS m FROM t), l AS (SELECT sum(n * (n - 1) / 2) AS l FROM (SELECT sum(n) AS n FROM t GROUP BY a)), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM t GROUP BY b)) SELECT {_sr('(i - l * r / (m * (m - 1) / 2)) / ((l + r) / 2 - l * r / (m * (m - 1) / 2))')} AS ari FROM i, l, r")
def A40_adjusted_rand(spark, d):
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 10).alias("other"))
    return metrics.adjusted_rand(rows, "label", "other").select(_r("ari").alias("ari"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_sr(f'corr({a}, {b})')} AS corr FROM lineitem" for a in LINE for b in LINE))
def A37_correlation(spark, d):
    return metrics.correlation(table(spark, d, "lineitem"), LINE).select("a", "b", _r("corr").alias("corr"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def A35_A36_value_counts(spark, d):
    return metrics.value_counts(table(spark, d, "events"), "event_type")


@query(f"WITH {_LONG} SELECT label, (i - 1)::INTEGER AS i, {_sr('avg(v)')} AS mean FROM e GROUP BY label, i")
def A43_class_centroids(spark, d):
    return metrics.class_centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", "i", _r("mean").alias("mean"))


@query(f"SELECT o_orderkey, {_sr('abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders))', 2)} AS distance FROM orders ORDER BY abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) DESC, o_orderkey LIMIT 10")
def O6_top_by_magnitude(spark, d):
    o = table(spark, d, "orders")
    mean = o.agg(F.avg("o_totalprice")).first()[0]
    far = F.abs(F.col("o_totalprice") - mean)
    return prep.head(o, 10, F.desc(far), "o_orderkey").select("o_orderkey", _r(far, 2).alias("distance"))


_ERRORS = " UNION ALL ".join(f"SELECT {k}::INTEGER AS k, {_sr('avg((pr.prediction <> e.label)::INTEGER)')} AS error FROM ({_knn_sql('euc', '1.0', k, False)}) pr JOIN embeddings e ON e.vec_id = pr.row_id" for k in (1, 3, 5))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Error of each k, from one neighbour search."""
    v = _vectors(spark, d)
    q = v.where("row_id % 100 = 0")
    near = neighbors.KNN(5).fit(v).kneighbors(q)
    out = None
    for k in (1, 3, 5):
        p = vote.majority_vote(near.where(F.col("rank") <= k), ["query_id"], "label", None, "prediction")
        e = p.join(q, p["query_id"] == q["row_id"]).agg(_r(metrics.classification_error("label", "prediction")).alias("error")).select(F.lit(k).alias("k"), "error")
        out = e if out is None else out.unionByName(e)
    return out


@query(_ERRORS)
def O7_score_each_k(spark, d):
    return _errors(spark, d)


@query(f"SELECT * FROM ({_ERRORS}) ORDER BY error, k LIMIT 1")
def O7_choose_k(spark, d):
    """The k of the least error; of equal ones the smallest."""
    return metrics.best_param(_errors(spark, d), "k", "error", largest=False)


# ---- linear models ---------------------------------------------------------------

_Z = "z AS (SELECT (n_chars - m) / s AS x, y FROM (SELECT d.n_chars, l.quality AS y FROM documents d JOIN labels l USING (doc_id)), (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents d JOIN labels l USING (doc_id)))"


def _quality(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    rows = prep.xy_frame(both, ["n_chars"], "quality", "x", "y", "doc_id")
    return prep.standardize_fit(rows, "x").transform(rows, "x")


@query(f"WITH RECURSIVE {_Z}, g(epoch, w, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT g.epoch + 1, g.w - 0.5 * avg((1 / (1 + exp(-(g.w * x + g.b))) - y) * x), g.b - 0.5 * avg(1 / (1 + exp(-(g.w * x + g.b))) - y) FROM g, z WHERE g.epoch < 20 GROUP BY g.epoch, g.w, g.b) SELECT g.epoch::INTEGER AS epoch, {_sr('g.w')} AS w, {_sr('g.b')} AS b, {_sr('-avg(y * ln(1 / (1 + exp(-(g.w * x + g.b))) + 1e-12::DOUBLE) + (1 - y) * ln(1 - 1 / (1 + exp(-(g.w * x + g.b))) + 1e-12::DOUBLE))')} AS loss FROM g, z WHERE g.epoch = 20 GROUP BY g.epoch, g.w, g.b")
def M3_A26_logistic(spark, d):
    rows = _quality(spark, d)
    m = linear.LogisticRegression(0.5, 20, initial_weights=[0.0, 0.0]).fit(rows)
    return spark.createDataFrame([(20, m.w[0], m.b, m.loss(rows))], "epoch int, w double, b double, loss double").select("epoch", *(_r(c).alias(c) for c in ("w", "b", "loss")))


@query(f"WITH {_Z.replace('y FROM (SELECT d.n_chars', 'y, doc_id FROM (SELECT d.doc_id, d.n_chars')} SELECT doc_id, {_sr('0.8 * x + 0.25')} AS margin, {_sr('1 / (1 + exp(-(0.8 * x + 0.25)))')} AS probability, CASE WHEN 1 / (1 + exp(-(0.8 * x + 0.25))) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM z")
def P3_P5_P6_P8_F3_logistic_predict(spark, d):
    rows = _quality(spark, d)
    m = linear.LogisticModel(linear.LogisticRegression(), [0.8], 0.25, linear.binary_labels(rows, "y"))
    return m.transform(rows).select("doc_id", _r("margin").alias("margin"), _r("probability").alias("probability"), "prediction")


_PART = "t AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, (p_size - 25) / 15.0::DOUBLE AS a, (p_retailprice - 1400) / 300.0::DOUBLE AS c, p_type FROM part)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, c = (F.col("p_size") - 25) / 15.0, (F.col("p_retailprice") - 1400) / 300.0
    return p.select(F.col("p_partkey").alias("row_id"), F.array(a, c).alias("x"), c.alias("c"), F.when(F.col("p_type") >= "M", "warm").otherwise("cold").alias("y"), a.alias("a"))


@query(f"WITH RECURSIVE {_PART}, g(i, w, b, e) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT t.i, g.w - 0.01 * (g.w * t.a + g.b - t.c) * t.a, g.b - 0.01 * (g.w * t.a + g.b - t.c), g.e + 0.5 * (g.w * t.a + g.b - t.c) * (g.w * t.a + g.b - t.c) FROM g JOIN t ON t.i = g.i + 1) SELECT {_sr('w')} AS w, {_sr('b')} AS b, {_sr('e / i')} AS error FROM g ORDER BY i DESC LIMIT 1")
def M2_A34_single_neuron(spark, d):
    rows = _parts(spark, d).select("row_id", F.array("a").alias("x"), F.col("c").alias("y"))
    m = linear.SingleNeuron(0.01, 1, initial_weights=[0.0, 0.0]).fit(rows)
    return spark.createDataFrame([(m.w[0], m.b, m.errors[0])], "w double, b double, error double").select(*(_r(c).alias(c) for c in ("w", "b", "error")))


_T = "(CASE WHEN t.p_type >= 'M' THEN 1.0 ELSE -1.0 END)::DOUBLE"
_MISS = f"({_T} * (g.u * t.a + g.v * t.c + g.b) <= 0)::INTEGER::DOUBLE"


@query(f"WITH RECURSIVE {_PART}, g(i, u, v, b) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT t.i, g.u + {_MISS} * 0.5 * {_T} * t.a, g.v + {_MISS} * 0.5 * {_T} * t.c, g.b + {_MISS} * 0.5 * {_T} FROM g JOIN t ON t.i = g.i + 1) SELECT {_sr('u')} AS w0, {_sr('v')} AS w1, {_sr('b')} AS b FROM g ORDER BY i DESC LIMIT 1")
def M4_perceptron(spark, d):
    m = linear.Perceptron(0.5, 1, initial_weights=[0.0, 0.0, 0.0]).fit(_parts(spark, d))
    return spark.createDataFrame([(m.w[0], m.w[1], m.b)], "w0 double, w1 double, b double").select(*(_r(c).alias(c) for c in ("w0", "w1", "b")))


@query(f"SELECT p_partkey AS row_id, CASE WHEN 0.4 * ((p_size - 25) / 15.0::DOUBLE) - 0.3 * ((p_retailprice - 1400) / 300.0::DOUBLE) + 0.1 >= 0 THEN 'warm' ELSE 'cold' END AS prediction FROM part")
def P7_P9_perceptron_predict(spark, d):
    rows = _parts(spark, d)
    m = linear.PerceptronModel(linear.Perceptron(), [0.4, -0.3], 0.1, linear.binary_labels(rows, "y"))
    return m.transform(rows).select("row_id", "prediction")


# ---- trees -----------------------------------------------------------------------


def _typed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("features"), F.ascii("p_type").cast("double").alias("label"))


_LONGPART = "x AS (SELECT p_partkey AS id, ascii(p_type)::DOUBLE AS y, unnest([0, 1]) AS f, unnest([p_size::DOUBLE, p_retailprice::DOUBLE]) AS v FROM part)"


def _h(n: str, t: str) -> str:
    return f"CASE WHEN {n} > 0 THEN -({n} / {t}) * log2({n} / {t}) ELSE 0 END"


@query(
    f"WITH {_LONGPART}, k AS (SELECT DISTINCT y FROM x), v AS (SELECT DISTINCT f, v FROM x), c AS (SELECT v.f, v.v, k.y, count(x.id)::DOUBLE AS n FROM v CROSS JOIN k LEFT JOIN x ON x.f = v.f AND x.v = v.v AND x.y = k.y GROUP BY v.f, v.v, k.y), "
    "s AS (SELECT f, v, y, sum(n) OVER (PARTITION BY f, y ORDER BY v) AS l, sum(n) OVER (PARTITION BY f, y) AS a, lead(v) OVER (PARTITION BY f, y ORDER BY v) AS nx FROM c), "
    "t AS (SELECT *, sum(l) OVER (PARTITION BY f, v) AS lt, sum(a) OVER (PARTITION BY f, v) AS tt FROM s), "
    f"g AS (SELECT f, v, any_value(nx) AS nx, any_value(lt) AS lt, any_value(tt) AS tt, sum({_h('a', 'tt')}) AS hp, sum({_h('l', 'lt')}) AS hl, sum(CASE WHEN tt > lt THEN {_h('(a - l)', '(tt - lt)')} ELSE 0 END) AS hr FROM t GROUP BY f, v HAVING any_value(nx) IS NOT NULL AND any_value(lt) >= 5 AND any_value(tt - lt) >= 5), "
    "b AS (SELECT *, (v + nx) / 2 AS threshold, hp - lt / tt * hl - (tt - lt) / tt * hr AS gain FROM g) "
    f"SELECT f::INTEGER AS feature, {_sr('threshold')} AS threshold, {_sr('gain')} AS info_gain, {_sr('hp')} AS impurity, tt::DOUBLE AS n_samples FROM b ORDER BY round(gain, 12) DESC, f, threshold LIMIT 1"
)
def M6_A17_W3_W5_class_stump(spark, d):
    m = tree.DecisionTreeClassifier(max_depth=1, min_samples_leaf=5).fit(_typed(spark, d))
    root = m.node_table(spark).where("node_id = 1")
    return root.select("feature", _r("threshold").alias("threshold"), _r("info_gain").alias("info_gain"), _r("impurity").alias("impurity"), "n_samples")


@query(
    "WITH x AS (SELECT l_orderkey AS id, l_extendedprice / 1000.0::DOUBLE AS y, unnest([0, 1, 2]) AS f, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS v FROM lineitem), m AS (SELECT avg(y) AS m FROM x WHERE f = 0), "
    "c AS (SELECT f, v, count(*)::DOUBLE AS n, sum(y - m) AS s1, sum((y - m) * (y - m)) AS s2 FROM x, m GROUP BY f, v), "
    "s AS (SELECT f, v, lead(v) OVER w AS nx, sum(n) OVER w AS n, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2, sum(n) OVER (PARTITION BY f) AS tn, sum(s1) OVER (PARTITION BY f) AS t1, sum(s2) OVER (PARTITION BY f) AS t2 FROM c WINDOW w AS (PARTITION BY f ORDER BY v)), "
    "b AS (SELECT *, (v + nx) / 2 AS threshold, (t2 / tn - (t1 / tn) * (t1 / tn)) - ((s2 - s1 * s1 / n) + (t2 - s2 - (t1 - s1) * (t1 - s1) / (tn - n))) / tn AS gain FROM s WHERE nx IS NOT NULL) "
    f"SELECT f::INTEGER AS feature, {_sr('threshold')} AS threshold, {_sr('gain', 4)} AS info_gain, {_sr('t2 / tn - (t1 / tn) * (t1 / tn)', 4)} AS impurity, tn::DOUBLE AS n_samples FROM b ORDER BY gain DESC, f, threshold LIMIT 1"
)
def M7_A18_W1_W2_regression_stump(spark, d):
    rows = table(spark, d, "lineitem").select(F.array("l_quantity", "l_discount", "l_tax").alias("features"), (F.col("l_extendedprice") / 1000.0).alias("label"))
    m = tree.DecisionTreeRegressor(max_depth=1).fit(rows)
    root = m.node_table(spark).where("node_id = 1")
    return root.select("feature", _r("threshold").alias("threshold"), _r("info_gain", 4).alias("info_gain"), _r("impurity", 4).alias("impurity"), "n_samples")


def _tree_sql(rows: str, d: int, depth: int, least: int, regression: bool = False, tried: Callable[[str], str] = lambda f: "true") -> str:
    """CTEs that grow trees over ``r0`` (t, id, x0.., y, w): r<k> holds the node of
    each row after k levels, s<k> the splits of level k. Rows of weight 0 follow
    the splits and have no say in them."""
    xs = ", ".join(f"x{i}" for i in range(d))
    out = f"WITH r0 AS (SELECT *, 1::BIGINT AS node, true AS act FROM ({rows}))" + (", m AS (SELECT sum(w * y) / sum(w) AS m FROM r0)" if regression else ", k AS (SELECT DISTINCT y FROM r0 WHERE w > 0)")
    for k in range(depth):
        out += f", x{k} AS (SELECT * FROM (SELECT t, node, y, w, unnest([{', '.join(map(str, range(d)))}]) AS f, unnest([{xs}]) AS v FROM r{k} WHERE act AND w > 0) WHERE {tried('f')})"
        if regression:
            imp = lambda n, a, b: f"({b} / {n} - ({a} / {n}) * ({a} / {n}))"
            out += (
                f", c{k} AS (SELECT t, node, f, v, sum(w) AS n, sum(w * (y - m)) AS a, sum(w * (y - m) * (y - m)) AS b FROM x{k}, m GROUP BY t, node, f, v)"
                f", q{k} AS (SELECT t, node, f, v, lead(v) OVER o AS nx, sum(n) OVER o AS n, sum(a) OVER o AS a, sum(b) OVER o AS b, sum(n) OVER z AS tn, sum(a) OVER z AS ta, sum(b) OVER z AS tb FROM c{k} WINDOW o AS (PARTITION BY t, node, f ORDER BY v), z AS (PARTITION BY t, node, f))"
                f", g{k} AS (SELECT t, node, f, (v + nx) / 2 AS threshold, tn, {imp('tn', 'ta', 'tb')} - n / tn * {imp('n', 'a', 'b')} - (tn - n) / tn * {imp('(tn - n)', '(ta - a)', '(tb - b)')} AS gain FROM q{k} WHERE nx IS NOT NULL AND n >= {least} AND tn - n >= {least})"
            )
        else:
            out += (
                f", v{k} AS (SELECT DISTINCT t, node, f, v FROM x{k}), c{k} AS (SELECT v.t, v.node, v.f, v.v, k.y, coalesce(sum(x.w), 0)::DOUBLE AS n FROM v{k} v CROSS JOIN k LEFT JOIN x{k} x ON x.t = v.t AND x.node = v.node AND x.f = v.f AND x.v = v.v AND x.y = k.y GROUP BY v.t, v.node, v.f, v.v, k.y)"
                f", l{k} AS (SELECT t, node, f, v, y, sum(n) OVER (PARTITION BY t, node, f, y ORDER BY v) AS l, sum(n) OVER (PARTITION BY t, node, f, y) AS a, lead(v) OVER (PARTITION BY t, node, f, y ORDER BY v) AS nx FROM c{k})"
                f", q{k} AS (SELECT *, sum(l) OVER (PARTITION BY t, node, f, v) AS lt, sum(a) OVER (PARTITION BY t, node, f, v) AS tt FROM l{k})"
                f", g{k} AS (SELECT t, node, f, (v + any_value(nx)) / 2 AS threshold, any_value(tt) AS tn, sum({_h('a', 'tt')}) - any_value(lt / tt) * sum({_h('l', 'lt')}) - any_value((tt - lt) / tt) * sum(CASE WHEN tt > lt THEN {_h('(a - l)', '(tt - lt)')} ELSE 0 END) AS gain FROM q{k} WHERE nx IS NOT NULL AND lt >= {least} AND tt - lt >= {least} GROUP BY t, node, f, v)"
            )
        pick = "CASE s.f " + " ".join(f"WHEN {i} THEN r.x{i}" for i in range(d)) + " END"
        out += (
            f", s{k} AS (SELECT t, node, f, threshold, round(gain, 12) AS gain, tn FROM (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY round(gain, 12) DESC, f, threshold) AS place FROM g{k} WHERE round(gain, 12) > 0) WHERE place = 1)"
            f", r{k + 1} AS (SELECT r.t, r.id, {xs}, r.y, r.w, CASE WHEN s.t IS NULL THEN r.node ELSE 2 * r.node + ({pick} > s.threshold)::INTEGER END AS node, s.t IS NOT NULL AS act FROM r{k} r LEFT JOIN s{k} s ON s.t = r.t AND s.node = r.node AND r.act)"
        )
    return out


def _gain_shares(depth: int, weighted: bool, tree: str = "t") -> str:
    """CTE sh (t, f, share): each tree's gains by feature as shares."""
    all_ = " UNION ALL ".join(f"SELECT t, f, gain{' * tn' if weighted else ''} AS g FROM s{k}" for k in range(depth))
    return f", sg AS ({all_}), sh AS (SELECT t, f, sum(g) / any_value(total) AS share FROM sg JOIN (SELECT t, sum(g) AS total FROM sg GROUP BY t) USING (t) GROUP BY t, f)"


_PARTROWS = "SELECT 0 AS t, p_partkey AS id, p_size::DOUBLE AS x0, p_retailprice::DOUBLE AS x1, ascii(p_type)::DOUBLE AS y, 1.0::DOUBLE AS w FROM part"
_DRAWN = "SELECT a.t, a.id, a.x0, a.x1, a.y, coalesce(b.w, 0.0)::DOUBLE AS w FROM (SELECT g.t, p.*, row_number() OVER (PARTITION BY g.t ORDER BY id) - 1 AS pos FROM (SELECT p_partkey AS id, p_size::DOUBLE AS x0, p_retailprice::DOUBLE AS x1, ascii(p_type)::DOUBLE AS y FROM part) p, range(3) g(t)) a LEFT JOIN (SELECT t, (t * 7919 + draw * 104729) % (SELECT count(*) FROM part) AS pos, count(*)::DOUBLE AS w FROM range(3) g(t), range((SELECT count(*) FROM part)) e(draw) GROUP BY ALL) b USING (t, pos)"


def _draw():
    """Bootstrap draws that SQL can repeat."""
    return (F.col("tree") * F.lit(7919).cast("long") + F.col("draw") * 104729) % F.col("n")


def _bag(spark: SparkSession, d: str, depth: int, least: int) -> tuple[DataFrame, ensemble.BaggingModel]:
    rows = _typed(spark, d)
    return rows, ensemble.BaggingClassifier(3, base=tree.DecisionTreeClassifier(max_depth=depth, min_samples_leaf=least)).fit(rows, _draw())


@query(f"{_tree_sql(_PARTROWS, 2, 3, 5)}, n AS (SELECT node, y, sum(w) AS n FROM r3 GROUP BY node, y), b AS (SELECT node, y, n / sum(n) OVER (PARTITION BY node) AS p, row_number() OVER (PARTITION BY node ORDER BY n DESC, y) AS place FROM n) SELECT r3.id AS row_id, b.y AS prediction, {_sr('b.p')} AS p FROM r3 JOIN b ON b.node = r3.node AND b.place = 1")
def M6_J8_P10_tree_predict(spark, d):
    """Class and its probability by a tree of depth 3."""
    rows = _typed(spark, d)
    m = tree.DecisionTreeClassifier(max_depth=3, min_samples_leaf=5).fit(rows)
    return m.transform(rows).select("row_id", "prediction", _r(F.array_max("probability")).alias("p"))


_LINEROWS = "SELECT 0 AS t, l_orderkey AS o, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, row_number() OVER () AS id, l_quantity::DOUBLE AS x0, l_discount::DOUBLE AS x1, l_tax::DOUBLE AS x2, l_extendedprice / 1000.0::DOUBLE AS y, 1.0::DOUBLE AS w FROM lineitem"


def _regression(spark: SparkSession, d: str) -> tuple[DataFrame, tree.TreeModel]:
    rows = table(spark, d, "lineitem").select(*KEY, F.array("l_quantity", "l_discount", "l_tax").alias("features"), (F.col("l_extendedprice") / 1000.0).alias("label"))
    return rows, tree.DecisionTreeRegressor(max_depth=3, min_samples_leaf=20).fit(rows)


@query(f"{_tree_sql(_LINEROWS, 3, 3, 20, regression=True)}, n AS (SELECT node, sum(y) / sum(w) AS y FROM r3 GROUP BY node) SELECT (x0)::DOUBLE AS quantity, (x1)::DOUBLE AS discount, (x2)::DOUBLE AS tax, count(*) AS n, {_sr('any_value(n.y)', 4)} AS prediction FROM r3 JOIN n USING (node) GROUP BY x0, x1, x2")
def M7_J8_regression_tree(spark, d):
    """Predictions of a tree of depth 3 and how many rows have each."""
    rows, m = _regression(spark, d)
    x = [F.col("features")[i].alias(c) for i, c in enumerate(("quantity", "discount", "tax"))]
    return m.transform(rows).groupBy(*x).agg(F.count("*").alias("n"), _r(F.max("prediction"), 4).alias("prediction"))


@query(f"{_tree_sql(_LINEROWS, 3, 3, 20, regression=True)}{_gain_shares(3, True)} SELECT f.f::INTEGER AS feature, {_sr('coalesce(sh.share, 0)', 5)} AS importance FROM range(3) f(f) LEFT JOIN sh ON sh.f = f.f")
def A21_regression_importances(spark, d):
    _, m = _regression(spark, d)
    return spark.createDataFrame(list(enumerate(m.feature_importances)), "feature int, importance double").select("feature", _r("importance", 5).alias("importance"))


@query(f"{_tree_sql(_PARTROWS, 2, 2, 1)}{_gain_shares(2, False)} SELECT f.f::INTEGER AS feature, {_sr('coalesce(sh.share, 0)')} AS importance FROM range(2) f(f) LEFT JOIN sh ON sh.f = f.f")
def A20_tree_importances(spark, d):
    m = tree.DecisionTreeClassifier(max_depth=2).fit(_typed(spark, d))
    return spark.createDataFrame(list(enumerate(m.feature_importances)), "feature int, importance double").select("feature", _r("importance").alias("importance"))


@query(f"{_tree_sql(_DRAWN, 2, 2, 1)}{_gain_shares(2, False)} SELECT f.f::INTEGER AS feature, {_sr('coalesce(sum(sh.share), 0) / 3')} AS importance FROM range(2) f(f) LEFT JOIN sh ON sh.f = f.f GROUP BY f.f")
def A23_bagging_importances(spark, d):
    _, m = _bag(spark, d, 2, 1)
    return spark.createDataFrame(list(enumerate(m.feature_importances())), "feature int, importance double").select("feature", _r("importance").alias("importance"))


@query("WITH t AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part), d AS (SELECT tree, (tree * 7919 + draw * 104729) % (SELECT count(*) FROM part) AS pos FROM range(3) a(tree), range((SELECT count(*) FROM part)) b(draw)) SELECT d.tree::INTEGER AS tree, t.p_partkey AS row_id, count(*)::DOUBLE AS w FROM d JOIN t USING (pos) GROUP BY d.tree, t.p_partkey")
def R2_bootstrap(spark, d):
    rows = _typed(spark, d)
    return ensemble.bootstrap(rows, 3, rows.count(), 0, draw=_draw()).select("tree", "row_id", "w")


@query(f"{_tree_sql(_DRAWN, 2, 2, 5)}, n AS (SELECT t, node, y, sum(w) AS n FROM r2 GROUP BY t, node, y), p AS (SELECT t, node, y, n / sum(n) OVER (PARTITION BY t, node) AS p FROM n), a AS (SELECT r2.id, p.y, sum(p.p) / 3 AS p FROM r2 JOIN p ON p.t = r2.t AND p.node = r2.node GROUP BY r2.id, p.y) SELECT id AS row_id, y AS prediction, {_sr('p')} AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, y) AS place FROM a) WHERE place = 1")
def M8_A22_J9_bagging(spark, d):
    """Class of the highest mean probability over three bagged trees, and that probability."""
    rows, m = _bag(spark, d, 2, 5)
    return m.transform(rows).select("row_id", "prediction", _r(F.array_max("probability")).alias("p"))


# ---- clustering --------------------------------------------------------------------

_CENTERS = [[0.0, 5.0], [3.0, 10.0], [6.0, 15.0], [9.0, 20.0]]


def _kmeans_sql(rounds: int) -> str:
    out = "WITH p AS (SELECT c_custkey, c_acctbal / 1000.0::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer), c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_CENTERS)) + ") AS t(k, cx, cy))"
    assign = lambda r: f"SELECT p.*, c.k, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), k) AS r FROM p CROSS JOIN c{r} c"
    for r in range(rounds):
        out += f", a{r} AS (SELECT * FROM ({assign(r)}) WHERE r = 1), c{r + 1} AS (SELECT c0.k, coalesce(avg(x), 0.0) AS cx, coalesce(avg(y), 0.0) AS cy FROM c0 LEFT JOIN a{r} ON a{r}.k = c0.k GROUP BY c0.k)"
    return f"{out}, f AS (SELECT * FROM ({assign(rounds)}) WHERE r = 1) SELECT f.c_custkey AS row_id, f.k::INTEGER AS cluster, {_sr('c.cx')} AS cx, {_sr('c.cy')} AS cy FROM f JOIN c{rounds} c ON c.k = f.k"


@query(_kmeans_sql(4))
def M9_J6_A24_A25_kmeans(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double")).alias("features"))
    m = cluster.KMeans(4, max_iter=4, tol=0.0, initial_centers=_CENTERS).fit(rows)
    at = lambda i: F.array(*(F.lit(c[i]) for c in m.centers))[F.col("cluster")]
    return m.transform(rows).select("row_id", "cluster", _r(at(0)).alias("cx"), _r(at(1)).alias("cy"))


_DB = (
    f"WITH RECURSIVE {_LONG}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id HAVING sqrt(sum((a.v - b.v) * (a.v - b.v))) <= 1.15), "
    "core AS (SELECT a FROM p GROUP BY a HAVING count(*) + 1 >= 3), ce AS (SELECT p.a, p.b FROM p JOIN core x ON x.a = p.a JOIN core y ON y.a = p.b), "
    "reach(a, r) AS (SELECT a, a FROM core UNION SELECT ce.b, reach.r FROM reach JOIN ce ON ce.a = reach.a WHERE reach.r < ce.b), "
    "root AS (SELECT a, min(r) AS r FROM reach GROUP BY a), k AS (SELECT a, dense_rank() OVER (ORDER BY r) AS k FROM root), "
    "border AS (SELECT p.a, min(k.k) AS k FROM p JOIN k ON k.a = p.b GROUP BY p.a) "
)


def _dbscan(spark: SparkSession, d: str) -> DataFrame:
    return cluster.DBSCAN(1.15, 3).fit_predict(_vectors(spark, d))


@query(_DB + "SELECT v.vec_id, coalesce(k.k, border.k, 0)::INTEGER AS cluster FROM embeddings v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN border ON border.a = v.vec_id")
def M10_J5_X3_dbscan(spark, d):
    return _dbscan(spark, d).select(F.col("row_id").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"))


@query(_DB + "SELECT max(c)::INTEGER AS n_clusters, count(*) FILTER (WHERE c = 0) AS n_noise FROM (SELECT coalesce(k.k, border.k, 0) AS c FROM embeddings v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN border ON border.a = v.vec_id)")
def A42_cluster_summary(spark, d):
    return cluster.cluster_summary(_dbscan(spark, d))


# ---- components ---------------------------------------------------------------------

_CORR = "(SELECT corr(l_quantity, l_extendedprice) AS r, count(*)::DOUBLE AS n, stddev_pop(l_quantity) AS s0, stddev_pop(l_extendedprice) AS s1 FROM lineitem)"


def _two(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*KEY, F.array("l_quantity", "l_extendedprice").alias("features"))


@query(" UNION ALL ".join(f"SELECT {i}::INTEGER AS component, {_sr(f'(1 {s} abs(r)) * n / (n - 1)')} AS variance, {_sr(f'(1 {s} abs(r)) / 2')} AS ratio, {_sr(f'(1 + {1 - i} * abs(r)) / {2 - i}')} AS cumulative, {_sr(f'sqrt((1 {s} abs(r)) * n)', 3)} AS singular, {_sr('sqrt(0.5)')} AS loading FROM {_CORR}" for i, s in enumerate("+-")))
def M11_A32_W8_pca(spark, d):
    m = decomposition.PCA().fit(_two(spark, d))
    rows = [(i, v, r, t, s, abs(c[0])) for i, (v, r, t, s, c) in enumerate(zip(m.explained_variance, m.explained_variance_ratio, m.cumulative_variance_ratio, m.singular_values, m.components))]
    got = spark.createDataFrame(rows, "component int, variance double, ratio double, cumulative double, singular double, loading double")
    return got.select("component", _r("variance").alias("variance"), _r("ratio").alias("ratio"), _r("cumulative").alias("cumulative"), _r("singular", 3).alias("singular"), _r("loading").alias("loading"))


@query(f"SELECT {_sr('-((1 - abs(r)) / 2) * (s0 * s0 + s1 * s1) / 2 / 1000000.0', 4)} AS score FROM {_CORR}")
def A33_F14_reconstruction(spark, d):
    rows = _two(spark, d)
    m = decomposition.PCA(1).fit(rows)
    return spark.createDataFrame([(m.score(rows) / 1e6,)], "score double").select(_r("score", 4).alias("score"))


# ---- graphs -----------------------------------------------------------------------------

_EDGES = "l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), h AS (SELECT a.s AS src, b.s AS dst FROM l a JOIN l b ON a.o = b.o AND a.s < b.s GROUP BY a.s, b.s HAVING count(*) >= 30), u AS (SELECT src, dst FROM h UNION SELECT dst, src FROM h)"
_VOTE = f"WITH {_EDGES}, v AS (SELECT id, label FROM (SELECT src AS id, dst % 7 AS label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst % 7) AS r FROM u GROUP BY src, dst % 7) WHERE r = 1)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share at least 30 orders."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"))
    with spread(spark, lines.count()):
        # dealt first: made distinct where they are read, the lines of a whole split are in one hash table
        l = lines.repartition("o", "s").distinct().repartition("o")
        r = l.select("o", F.col("s").alias("t"))
        both = l.join(r, "o").where("s < t").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.count("*").alias("n"))
        return cut(both.where("n >= 30").select("src", "dst"))


@query(f"WITH {_EDGES} SELECT src, dst FROM u")
def G1_X1_undirected(spark, d):
    return graph.undirected(_edges(spark, d))


@query(f"WITH {_EDGES} SELECT count(*) AS n FROM (SELECT DISTINCT src FROM u WHERE src NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20))")
def J10_dangling(spark, d):
    few = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("id"))
    return graph.dangling(few, _edges(spark, d)).agg(F.count("*").alias("n"))


def _voted(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).alias("label"))
    return graph.neighbour_vote(graph.undirected(_edges(spark, d)), labels)


@query(f"{_VOTE} SELECT id, label FROM v")
def J7_A29_neighbour_vote(spark, d):
    return _voted(spark, d)


@query(f"{_VOTE} SELECT label, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM v GROUP BY label")
def A31_communities(spark, d):
    return graph.communities(_voted(spark, d)).select("label", F.array_join("members", ",").alias("members"))


@query(f"{_VOTE} SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS community FROM v")
def W6_compress_labels(spark, d):
    return graph.compress(_voted(spark, d))


@query(f"{_VOTE} SELECT {_sr('coalesce(avg((coalesce(v.label, s.s_suppkey % 7) <> s.s_suppkey % 7)::INTEGER), 0)')} AS changed FROM supplier s LEFT JOIN v ON v.id = s.s_suppkey")
def A30_changed_fraction(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).alias("old"))
    after = s.join(_voted(spark, d), "id", "left").select("id", F.coalesce("label", "old").alias("label"))
    return spark.createDataFrame([(graph.changed_fraction(s.withColumnRenamed("old", "label"), after),)], "changed double").select(_r("changed").alias("changed"))


def _propagation_sql(rounds: int, waves: int) -> str:
    out, at = f"WITH {_EDGES}, p0 AS (SELECT s_suppkey AS id, s_suppkey::BIGINT AS label FROM supplier)", 0
    for _ in range(rounds):
        for w in range(waves):
            out += f", q{at} AS (SELECT id, label FROM (SELECT u.src AS id, p.label, row_number() OVER (PARTITION BY u.src ORDER BY count(*) DESC, p.label) AS r FROM u JOIN p{at} p ON p.id = u.dst WHERE u.src % {waves} = {w} GROUP BY u.src, p.label) WHERE r = 1)"
            out += f", p{at + 1} AS (SELECT p.id, coalesce(q.label, p.label) AS label FROM p{at} p LEFT JOIN q{at} q USING (id))"
            at += 1
    return f"{out} SELECT id, label FROM p{at}"


@query(_propagation_sql(2, 2))
def M12_G2_G3_G4_label_propagation(spark, d):
    """Two rounds of two waves; ties to the smallest label."""
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("pos"))
    return graph.LabelPropagation(2, 0.0, waves=2).run(v, _edges(spark, d), wave=F.col("id") % 2, ties="smallest")


@query("SELECT count(*) AS n, count(DISTINCT s_suppkey) AS n_distinct, count(*) = count(DISTINCT s_suppkey) AS is_unique FROM supplier")
def X2_vertex_uniqueness(spark, d):
    return graph.vertex_counts(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


# ---- network ------------------------------------------------------------------------------


@query(f"SELECT {_sr('0.1 * avg(a * c)')} AS w0, {_sr('0.1 * avg(c * c)')} AS w1, {_sr('0.1 * avg(c)')} AS b, {_sr('0.5 * avg(c * c)')} AS loss FROM (SELECT (p_size - 25) / 15.0::DOUBLE AS a, (p_retailprice - 1400) / 300.0::DOUBLE AS c FROM part)")
def M5_A27_network_step(spark, d):
    """One full-batch step of the linear network from zero weights."""
    import numpy as np

    rows = _parts(spark, d).select("row_id", F.col("x").alias("features"), F.col("c").alias("label"))
    net = nn.NeuralNetwork(2, None, "regression", learning_rate=0.1, batch_size=1 << 30, max_epochs=1)
    m = net.fit(rows, nn.NetworkModel(net, {"W2": np.zeros((2, 1)), "b2": np.zeros(1)}, []))
    w, b = m.weights["W2"], m.weights["b2"]
    return spark.createDataFrame([(float(w[0, 0]), float(w[1, 0]), float(b[0]), m.losses[0])], "w0 double, w1 double, b double, loss double").select(*(_r(c).alias(c) for c in ("w0", "w1", "b", "loss")))


def _network_sql(step: float) -> str:
    """One full-batch step of an 8-4-10 network, and its predictions."""
    forward = lambda n, w1, w2: (
        f", z{n} AS (SELECT e.id, w.j, sum(e.v * w.w) + any_value(w.b) AS z FROM e JOIN {w1} w USING (i) GROUP BY e.id, w.j), o{n} AS (SELECT z.id, w.c, sum(greatest(z.z, 0) * w.w) + any_value(w.b) AS o FROM z{n} z JOIN {w2} w USING (j) GROUP BY z.id, w.c)"
        f", p{n} AS (SELECT id, c, exp(o - m) / sum(exp(o - m)) OVER (PARTITION BY id) AS p FROM (SELECT *, max(o) OVER (PARTITION BY id) AS m FROM o{n}))"
    )
    return (
        "WITH e AS (SELECT id, y, i, v FROM (SELECT vec_id AS id, label AS y, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE i < 8), y AS (SELECT DISTINCT id, y FROM e)"
        ", w1 AS (SELECT i, j, sin(1 + i * 4 + j) * 0.5 AS w, 0.0::DOUBLE AS b FROM range(8) a(i), range(4) b(j)), w2 AS (SELECT j, c, cos(1 + j * 10 + c) * 0.5 AS w, 0.0::DOUBLE AS b FROM range(4) a(j), range(10) b(c))"
        + forward(0, "w1", "w2")
        + ", d AS (SELECT p.id, p.c, p.p - (p.c = y.y)::INTEGER AS d FROM p0 p JOIN y USING (id)), g2 AS (SELECT z.j, d.c, avg(greatest(z.z, 0) * d.d) AS g, avg(d.d) AS gb FROM z0 z JOIN d USING (id) GROUP BY z.j, d.c)"
        ", k AS (SELECT z.id, z.j, sum(d.d * w2.w) * any_value(z.z > 0)::INTEGER AS k FROM z0 z JOIN d USING (id) JOIN w2 ON w2.j = z.j AND w2.c = d.c GROUP BY z.id, z.j), g1 AS (SELECT e.i, k.j, avg(e.v * k.k) AS g, avg(k.k) AS gb FROM e JOIN k USING (id) GROUP BY e.i, k.j)"
        f", u1 AS (SELECT i, j, w - {step} * g AS w, b - {step} * gb AS b FROM w1 JOIN g1 USING (i, j)), u2 AS (SELECT j, c, w - {step} * g AS w, b - {step} * gb AS b FROM w2 JOIN g2 USING (j, c))"
        + forward(1, "u1", "u2")
        + f" SELECT id AS row_id, c::INTEGER AS prediction, {_sr('p')} AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, c) AS r FROM p1) WHERE r = 1"
    )


@query(_network_sql(0.5))
def M5_A27_network_classify(spark, d):
    """A hidden layer of four, from fixed weights, after one full-batch step."""
    import numpy as np

    rows = _vectors(spark, d).withColumn("features", F.slice("features", 1, 8))
    net = nn.NeuralNetwork(8, 4, n_classes=10, learning_rate=0.5, batch_size=1 << 30, max_epochs=1)
    w1, w2 = np.sin(1 + np.arange(32.0)).reshape(8, 4) / 2, np.cos(1 + np.arange(40.0)).reshape(4, 10) / 2
    m = net.fit(rows, nn.NetworkModel(net, {"W1": w1, "b1": np.zeros(4), "W2": w2, "b2": np.zeros(10)}, []))
    return m.transform(rows).select("row_id", "prediction", _r(F.array_max("output")).alias("p"))


@query()
def M5_network_minibatches(spark, d):
    """64-16-10, two epochs of batches of 512 in hash order."""
    rows = _vectors(spark, d)
    net = nn.NeuralNetwork(64, 16, n_classes=10, learning_rate=0.1, batch_size=512, max_epochs=2)
    return net.fit(rows).transform(rows).select("row_id", "prediction")


# ---- small operators ------------------------------------------------------------------------


@query(f"SELECT p_partkey AS row_id, {_sr('1 / (1 + exp(-(0.7 * ((p_size - 25) / 15.0::DOUBLE) - 0.2)))')} AS prediction, {_sr('tanh(0.7 * ((p_size - 25) / 15.0::DOUBLE) - 0.2)')} AS plain FROM part")
def P4_F7_U3_neuron_predict(spark, d):
    """An activation of columns, and one of numbers."""
    import math

    rows = _parts(spark, d).select("row_id", F.array("a").alias("x"))
    model = lambda f: linear.NeuronModel(linear.SingleNeuron(activation=f), [0.7], -0.2, [])
    both = model(math.tanh).transform(model(vec.sigmoid).transform(rows).withColumnRenamed("prediction", "s"))
    return both.select("row_id", _r("s").alias("prediction"), _r("prediction").alias("plain"))


@query(f"WITH {_LONG}, p AS (SELECT a.vec_id AS q, b.vec_id AS t, max(abs(a.v - b.v)) AS dist FROM e a JOIN e b ON a.i = b.i WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id) SELECT q AS query_id, rank, t AS train_id, {_sr('dist')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t)::INTEGER AS rank FROM p) WHERE rank <= 3")
def U1_U2_callable_metric(spark, d):
    """Neighbours by a metric of two numpy vectors."""
    v = _vectors(spark, d)
    got = neighbors.KNN(3, metric=lambda a, b: abs(a - b).max()).fit(v).kneighbors(v.where("row_id % 100 = 0"))
    return got.select("query_id", "rank", "train_id", _r("dist").alias("dist"))


@query(f"SELECT p_partkey AS row_id, {_sr('greatest(0.0, (p_size - 25) / 15.0::DOUBLE)')} AS relu, CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grad FROM part")
def F4_F5_relu(spark, d):
    z = (F.col("p_size") - 25) / 15.0
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), _r(vec.relu(z)).alias("relu"), vec.relu_grad(z).alias("grad"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS largest, (list_position(embedding, list_min(embedding)) - 1)::INTEGER AS smallest FROM embeddings")
def O3_O4_arg_extremes(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", vec.argmax(e).alias("largest"), vec.argmin(e).alias("smallest"))


@query(f"SELECT p_partkey, {_sr('p_size')} AS p_size, {_sr('p_retailprice')} AS p_retailprice FROM part")
def S3_lenient_cast(spark, d):
    texts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    got = validate.cast_lenient(texts, "p_size", "p_retailprice")
    return got.select("p_partkey", _r("p_size").alias("p_size"), _r("p_retailprice").alias("p_retailprice"))


@query("SELECT c_custkey, c_nationkey, c_acctbal::DOUBLE AS c_acctbal FROM customer")
def S9_headerless_csv(spark, d):
    """The table as CSV without a header, read back."""
    from uuid import uuid4

    path = f"{shared_dir(spark)}/millrace/csv-{uuid4().hex}"
    table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double")).write.csv(path)
    kinds = dict(table(spark, d, "customer").dtypes)
    return headerless_csv(spark, path, {"c_custkey": kinds["c_custkey"], "c_nationkey": kinds["c_nationkey"], "c_acctbal": "double"})


@query("SELECT p_partkey, [p_retailprice::DOUBLE][1] AS x0, len([p_retailprice])::INTEGER AS width FROM part")
def S4_S5_as_vectors(spark, d):
    got = prep.as_vectors(table(spark, d, "part"), "p_retailprice")
    return got.select("p_partkey", F.col("features")[0].alias("x0"), F.size("features").alias("width"))


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def O8_head(spark, d):
    got = prep.head(table(spark, d, "orders"), 25, F.desc("o_totalprice"), "o_orderkey")
    return got.select("o_orderkey", F.col("o_totalprice").cast("double"))


_GRADIENT = lambda x: f"avg((1 / (1 + exp(-(g.u * a + g.v * c + g.b))) - y) * {x})"


@query(
    f"WITH RECURSIVE t AS (SELECT (p_size - 25) / 15.0::DOUBLE AS a, (p_retailprice - 1400) / 300.0::DOUBLE AS c, (p_type >= 'M')::INTEGER AS y FROM part), "
    f"g(k, u, v, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT g.k + 1, g.u - 0.5 * {_GRADIENT('a')}, g.v - 0.5 * {_GRADIENT('c')}, g.b - 0.5 * {_GRADIENT('1')} FROM g, t WHERE g.k < 5 GROUP BY g.k, g.u, g.v, g.b), "
    "l AS (SELECT min(a) AS la, max(a) AS ha, min(c) AS lc, max(c) AS hc FROM t), m AS (SELECT * FROM g WHERE k = 5), "
    "p AS (SELECT i * 50 + j AS row_id, la + i * (ha - la) / 39 AS a, lc + j * (hc - lc) / 49 AS c FROM range(40) x(i), range(50) z(j), l) "
    f"SELECT p.row_id::BIGINT AS row_id, {_sr('p.a')} AS x0, {_sr('p.c')} AS x1, {_sr('1 / (1 + exp(-(m.u * p.a + m.v * p.c + m.b)))')} AS probability FROM p, m"
)
def F15_scored_grid(spark, d):
    """A grid over the range of the parts' features, scored by a model of the parts."""
    rows = _parts(spark, d).select("row_id", "x", "a", "c", (F.col("y") == "warm").cast("int").alias("y"))
    m = linear.LogisticRegression(0.5, 5, initial_weights=[0.0, 0.0, 0.0]).fit(rows)
    la, ha, lc, hc = rows.agg(F.min("a"), F.max("a"), F.min("c"), F.max("c")).first()
    got = m.transform(prep.grid(spark, [(la, ha, 40), (lc, hc, 50)], "x"))
    return got.select("row_id", _r(F.col("x")[0]).alias("x0"), _r(F.col("x")[1]).alias("x1"), _r("probability").alias("probability"))


@query(f"WITH p AS (SELECT c_acctbal / 1000.0::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer), c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(_CENTERS))}) AS t(k, cx, cy)), a AS (SELECT k, x, y FROM (SELECT p.x, p.y, c.k, row_number() OVER (PARTITION BY p.x, p.y ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), k) AS r FROM (SELECT DISTINCT x, y FROM p) p CROSS JOIN c) WHERE r = 1), n AS (SELECT a.k, avg(p.x) AS nx, avg(p.y) AS ny FROM p JOIN a ON a.x = p.x AND a.y = p.y GROUP BY a.k) SELECT {_sr('max(sqrt((coalesce(nx, 0) - cx) * (coalesce(nx, 0) - cx) + (coalesce(ny, 0) - cy) * (coalesce(ny, 0) - cy)))')} AS shift FROM c LEFT JOIN n ON n.k = c.k")
def A25_max_shift(spark, d):
    """How far centres move in one round."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double")).alias("features"))
    m = cluster.KMeans(4, max_iter=1, tol=0.0, initial_centers=_CENTERS).fit(rows)
    return spark.createDataFrame([(cluster.max_shift(_CENTERS, m.centers),)], "shift double").select(_r("shift").alias("shift"))


@query("SELECT user_id, value::DOUBLE AS amount FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND user_id IS NOT NULL AND event_type = (SELECT min(event_type) FROM events)")
def P16_wrangle(spark, d):
    """Rows without nulls, filtered, with a renamed column."""
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type")).first()[0]
    return prep.complete(e, {"user_id": "user_id", "amount": F.col("value").cast("double")}, F.col("event_type") == least)


# ---- training in a given order, over several passes, from drawn starts ----------------------

_BATCH = 256
_ORDERED = f"t AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY (id * 7919 + 13 + e * 31) % 104729, id) - 1 AS p FROM (SELECT p_partkey AS id, (p_size - 25) / 15.0::DOUBLE AS a, (p_retailprice - 1400) / 300.0::DOUBLE AS c FROM part), range(2) x(e)), q AS (SELECT a, c, e * (SELECT (count(*) + {_BATCH - 1}) // {_BATCH} FROM part) + p // {_BATCH} AS k FROM t)"
_MISSED = "(g.u * a + g.v * c + g.b - c)"


@query(f"WITH RECURSIVE {_ORDERED}, g(k, u, v, b) AS (SELECT -1::BIGINT, 0.1::DOUBLE, 0.2::DOUBLE, 0.0::DOUBLE UNION ALL SELECT q.k, g.u - 0.05 * avg({_MISSED} * a), g.v - 0.05 * avg({_MISSED} * c), g.b - 0.05 * avg({_MISSED}) FROM g JOIN q ON q.k = g.k + 1 GROUP BY q.k, g.u, g.v, g.b) SELECT {_sr('u')} AS w0, {_sr('v')} AS w1, {_sr('b')} AS b FROM g ORDER BY k DESC LIMIT 1")
def M5_R6_ordered_minibatches(spark, d):
    """A linear network over two epochs of batches of 256 in a given order."""
    import numpy as np

    rows = _parts(spark, d).select("row_id", F.col("x").alias("features"), F.col("c").alias("label"))
    net = nn.NeuralNetwork(2, None, "regression", learning_rate=0.05, batch_size=_BATCH, max_epochs=2)
    start = nn.NetworkModel(net, {"W2": np.array([[0.1], [0.2]]), "b2": np.zeros(1)}, [])
    m = net.fit(rows, start, order=lambda e: (F.col("i") * 7919 + 13 + e * 31) % 104729)
    w, b = m.weights["W2"], m.weights["b2"]
    return spark.createDataFrame([(float(w[0, 0]), float(w[1, 0]), float(b[0]))], "w0 double, w1 double, b double").select(*(_r(c).alias(c) for c in ("w0", "w1", "b")))


_AGAIN = "(SELECT count(*) FROM part)"


@query(f"WITH RECURSIVE {_PART}, g(i, u, v, b, miss) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT g.i + 1, g.u + {_MISS} * 0.5 * {_T} * t.a, g.v + {_MISS} * 0.5 * {_T} * t.c, g.b + {_MISS} * 0.5 * {_T}, CASE WHEN t.i = 1 THEN 0 ELSE g.miss END + {_MISS} FROM g JOIN t ON t.i = g.i % {_AGAIN} + 1 WHERE g.i < 3 * {_AGAIN}) SELECT {_sr('u')} AS w0, {_sr('v')} AS w1, {_sr('b')} AS b, {_sr(f'miss / {_AGAIN}')} AS error FROM g ORDER BY i DESC LIMIT 1")
def M4_perceptron_epochs(spark, d):
    """Three passes; the share of mistakes in the last."""
    m = linear.Perceptron(0.5, 3, initial_weights=[0.0, 0.0, 0.0]).fit(_parts(spark, d))
    return spark.createDataFrame([(m.w[0], m.w[1], m.b, m.errors[2])], "w0 double, w1 double, b double, error double").select(*(_r(c).alias(c) for c in ("w0", "w1", "b", "error")))


_OFF = "(tanh(g.w * t.a + g.b) - t.c)"


@query(f"WITH RECURSIVE {_PART}, g(i, w, b, e) AS (SELECT 0::BIGINT, 0.1::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT g.i + 1, g.w - 0.01 * {_OFF} * t.a, g.b - 0.01 * {_OFF}, CASE WHEN t.i = 1 THEN 0 ELSE g.e END + 0.5 * {_OFF} * {_OFF} FROM g JOIN t ON t.i = g.i % {_AGAIN} + 1 WHERE g.i < 2 * {_AGAIN}) SELECT {_sr('w')} AS w, {_sr('b')} AS b, {_sr(f'e / {_AGAIN}')} AS error FROM g ORDER BY i DESC LIMIT 1")
def M2_U3_neuron_epochs(spark, d):
    """Two passes of a neuron whose activation is a function of numbers."""
    import math

    rows = _parts(spark, d).select("row_id", F.array("a").alias("x"), F.col("c").alias("y"))
    m = linear.SingleNeuron(0.01, 2, activation=math.tanh, initial_weights=[0.1, 0.0]).fit(rows)
    return spark.createDataFrame([(m.w[0], m.b, m.errors[1])], "w double, b double, error double").select(*(_r(c).alias(c) for c in ("w", "b", "error")))


@query(_kmeans_sql(2).replace("c0 AS (SELECT * FROM (VALUES", "c0 AS (SELECT row_number() OVER (ORDER BY (c_custkey * 7919 + 13) % 104729, c_custkey) - 1 AS k, x AS cx, y AS cy FROM p ORDER BY k LIMIT 4), c9 AS (SELECT * FROM (VALUES"))
def R4_kmeans_drawn_start(spark, d):
    """Centres that start at rows drawn without replacement, in a given order."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double")).alias("features"))
    m = cluster.KMeans(4, max_iter=2, tol=0.0).fit(rows, order=(F.col("row_id") * 7919 + 13) % 104729)
    at = lambda i: F.array(*(F.lit(c[i]) for c in m.centers))[F.col("cluster")]
    return m.transform(rows).select("row_id", "cluster", _r(at(0)).alias("cx"), _r(at(1)).alias("cy"))


@query(f"{_tree_sql(_LINEROWS, 3, 3, 20, regression=True, tried=lambda f: f'(({f}) = node % 3 OR ({f}) = (node + 1) % 3)')}, n AS (SELECT node, sum(y) / sum(w) AS y FROM r3 GROUP BY node) SELECT (x0)::DOUBLE AS quantity, (x1)::DOUBLE AS discount, (x2)::DOUBLE AS tax, count(*) AS n, {_sr('any_value(n.y)', 4)} AS prediction FROM r3 JOIN n USING (node) GROUP BY x0, x1, x2")
def R3_F12_feature_subsample(spark, d):
    """A tree of depth 3 that tries two of three features (ceil of the root) at each node."""
    rows = table(spark, d, "lineitem").select(F.array("l_quantity", "l_discount", "l_tax").alias("features"), (F.col("l_extendedprice") / 1000.0).alias("label"))
    m = tree.DecisionTreeRegressor(max_depth=3, min_samples_leaf=20, max_features="sqrt").fit(rows, draw=lambda t, n: [n % 3, (n + 1) % 3])
    x = [F.col("features")[i].alias(c) for i, c in enumerate(("quantity", "discount", "tax"))]
    return m.transform(rows).groupBy(*x).agg(F.count("*").alias("n"), _r(F.max("prediction"), 4).alias("prediction"))


@query(f"WITH {_LONG} SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, {_sr('corr(a.v, b.v) * count(*) / (count(*) - 1)')} AS covariance, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dot FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i")
def M11_A32_pca_whole_vectors(spark, d):
    """All 64 components: what they make of the covariance, and their products."""
    import numpy as np

    m = decomposition.PCA().fit(_vectors(spark, d))
    v = np.array(m.components)
    back, dots = v.T * m.explained_variance @ v, v @ v.T
    rows = [(i + 1, j + 1, float(back[i, j]), float(dots[i, j])) for i in range(len(v)) for j in range(len(v))]
    return spark.createDataFrame(rows, "i int, j int, covariance double, dot double").select("i", "j", _r("covariance").alias("covariance"), _r("dot").alias("dot"))


@query()
def M12_R7_color_order(spark, d):
    """Communities in the order of a colouring, once no label changes any more, and each vertex's place in it."""
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("pos"))
    return graph.LabelPropagation(None, 0.0, order="colors").trace(v, _edges(spark, d), ties="smallest")[0]


@query()
def S12_stream_training(spark, d):
    """A linear network trained on the parts as a stream, and what it predicts for them."""
    import numpy as np
    from uuid import uuid4

    base = f"{shared_dir(spark)}/millrace/stream-{uuid4().hex}"
    rows = _parts(spark, d).select("row_id", F.col("x").alias("features"), F.col("c").alias("label"))
    rows.write.parquet(f"{base}/rows")
    net = nn.NeuralNetwork(2, None, "regression", learning_rate=0.1, batch_size=1 << 30, max_epochs=1)
    start = nn.NetworkModel(net, {"W2": np.zeros((2, 1)), "b2": np.zeros(1)}, [])
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/rows")
    train_stream(stream, start, lambda m, batch: net.fit(batch, m), f"{base}/checkpoint", f"{base}/model").trigger(availableNow=True).start().awaitTermination()
    return trained(spark, f"{base}/model", start).transform(rows).select("row_id", _r("prediction").alias("prediction"))
