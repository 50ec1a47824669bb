"""Evaluation as aggregates. Every function gives one Column for ``agg`` or a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def _mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(NAN))


def classification_error(y: str, p: str) -> Column:
    """Share of rows where label and prediction differ; NaN of no rows."""
    return _mean((~F.col(y).eqNullSafe(F.col(p))).cast("double"))


def accuracy(y: str, p: str) -> Column:
    return _mean(F.col(y).eqNullSafe(F.col(p)).cast("double"))


def mean_squared_error(y: str, p: str) -> Column:
    d = F.col(y).cast("double") - F.col(p)
    return _mean(d * d)


def half_mse(y: str, p: str) -> Column:
    return mean_squared_error(y, p) / 2


def rmse(y: str, p: str) -> Column:
    return F.sqrt(mean_squared_error(y, p))


def r2(y: str, p: str) -> Column:
    """1 - SSres / SStot, 0 for a constant target."""
    d = F.col(y).cast("double") - F.col(p)
    tot = F.var_pop(F.col(y).cast("double")) * F.count(y)
    return F.when(F.min(y) == F.max(y), 0.0).otherwise(1 - F.sum(d * d) / F.when(tot == 0, 1.0).otherwise(tot))


def binary_cross_entropy(y: str, p: str, eps: float = 1e-12) -> Column:
    """Labels 0/1 against probabilities of 1."""
    t, q = F.col(y).cast("double"), F.col(p)
    return -_mean(t * F.log(q + eps) + (1 - t) * F.log(1 - q + eps))


def cross_entropy(y: str, p: str) -> Column:
    """Class indices against arrays of probabilities, clipped below at 1e-12."""
    return -_mean(F.log(F.greatest(F.col(p)[F.col(y).cast("int")], F.lit(1e-12))))


def mistakes(y: str, p: str) -> Column:
    return F.coalesce(F.sum((~F.col(y).eqNullSafe(F.col(p))).cast("double")), F.lit(0.0))


def entropy(counts: list[Column]) -> Column:
    """Bits of a distribution given as counts; 0 of nothing."""
    n = sum(counts[1:], counts[0])
    term = lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)
    return F.when(n > 0, sum((term(c) for c in counts[1:]), term(counts[0]))).otherwise(0.0)


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Long form: (label, predicted, n)."""
    return df.groupBy(F.col(y).alias("label"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    c = confusion(df, y, p)
    each = c.select(F.col("label").alias("c"), "n", F.lit(0).alias("pn"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    each = each.unionByName(c.select(F.col("predicted").alias("c"), F.lit(0).alias("n"), F.col("n").alias("pn"), F.lit(0).alias("hit")))
    g = each.groupBy("c").agg(F.sum("n").alias("support"), F.sum("pn").alias("pn"), F.sum("hit").alias("hit"))
    safe = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    g = g.withColumn("precision", safe(F.col("hit"), F.col("pn"))).withColumn("recall", safe(F.col("hit"), F.col("support")))
    return g.select(F.col("c").alias("label"), "precision", "recall", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` from pair counts of the contingency table."""
    t = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = t.agg(pairs(F.col("n")).alias("i"), F.sum("n").alias("all"))
    left = t.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("l"))
    right = t.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("r"))
    one = both.crossJoin(left).crossJoin(right)  # one row each
    total = F.col("all") * (F.col("all") - 1) / 2
    expected = F.col("l") * F.col("r") / total
    top = (F.col("l") + F.col("r")) / 2
    return one.select(F.when(total == 0, 1.0).when(top == expected, 1.0).otherwise((F.col("i") - expected) / (top - expected)).alias("ari"))


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long form Pearson matrix (a, b, corr) in one pass."""
    r = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)))
    cell = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias("corr")) for i, a in enumerate(cols) for j, b in enumerate(cols)))
    return r.select(F.explode(cell).alias("c")).select("c.*")


def best_param(scores: DataFrame, param: str = "param", score: str = "score", largest: bool = True) -> DataFrame:
    """The row of the best score; of equal scores the first by ``param``."""
    return scores.orderBy(F.desc(score) if largest else F.asc(score), param).limit(1)


def node_counts(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Per group: its size, number of classes, entropy of the classes and the
    commonest one (ties: the smallest). Two partial aggregations."""
    c = df.groupBy(*by, F.col(label).alias("__y")).agg(F.count("*").alias("__n"))
    s = c.groupBy(*by).agg(F.sum("__n").alias("n"), F.count("*").alias("n_classes"), F.min_by("__y", F.struct(-F.col("__n"), F.col("__y"))).alias("majority"), F.collect_list("__n").alias("__ns"))
    h = F.aggregate("__ns", F.lit(0.0), lambda a, k: a - k / F.col("n") * F.log2(k / F.col("n")))
    return s.withColumn("entropy", h).drop("__ns")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct values and how often each occurs."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def class_centroids(df: DataFrame, label: str, features: str) -> DataFrame:
    """(label, i, mean): the mean of each component within each class."""
    v = df.select(F.col(label).alias("label"), F.posexplode(features).alias("i", "v"))
    return v.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("mean"))
