"""Scaling, splitting, packing and flattening of feature frames."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import vec
from millrace.plans.ranks import hash_key, positions


def xy_frame(df: DataFrame, features: list[str], label: str, vector_col: str = "x", label_col: str = "y", *keep: str) -> DataFrame:
    """Scalar columns packed into one vector column beside the label."""
    if not features:
        raise ValueError("at least one feature column is needed")
    return df.select(*keep, F.array(*(F.col(c).cast("double") for c in features)).alias(vector_col), F.col(label).alias(label_col))


def as_vectors(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    """``col`` as vectors: an array as it is, a number as a vector of one.
    ValueError without rows, TypeError for what is neither."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.NumericType):
        got = F.array(F.col(col).cast("double"))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        got = F.col(col).cast("array<double>")
    else:
        raise TypeError(f"{col} must be a number or an array of numbers")
    if df.limit(1).count() == 0:
        raise ValueError("at least one row is needed")
    return df.withColumn(out, got)


def complete(df: DataFrame, columns: dict[str, str | Column], where: Column | None = None) -> DataFrame:
    """``columns`` (new name: column or expression) of the rows that meet
    ``where`` and have none of them null or NaN. Only what is named is read."""
    kept = df if where is None else df.where(where)
    got = kept.select(*((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))
    return got.dropna(subset=list(columns))


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows by ``order``: a partial top-n on each partition, then their merge."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), lowest in a hash of (seed, row_id)."""
    return df.orderBy(hash_key(seed, row_id), row_id).limit(n)


def grid(spark: SparkSession, axes: list[tuple[float, float, int]], out: str = "features") -> DataFrame:
    """Scoring grid: (row_id, vector) for all combinations of ``n`` evenly spaced
    values from low to high of each axis, the last axis fastest. Computed from
    the row number, so nothing is joined."""
    if not axes or min(n for _, _, n in axes) < 1:
        raise ValueError("each axis needs at least one value")
    cols, step = [], 1
    for lo, hi, n in reversed(axes):
        at = F.floor(F.col("row_id") / step) % n
        cols.append(F.lit(float(lo)) + at * ((hi - lo) / (n - 1) if n > 1 else 0.0))
        step *= n
    return spark.range(step).withColumnRenamed("id", "row_id").withColumn(out, F.array(*reversed(cols)))


def blobs(spark: SparkSession, n: int, centers: list[list[float]], deviation: float = 1.0, seed: int = 0) -> DataFrame:
    """(row_id, features, label): rows dealt to the centres in turn, with normal noise."""
    k = len(centers)
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % k).cast("int").alias("label"))
    at = lambda j: F.get(F.array(*(F.lit(float(c[j])) for c in centers)), F.col("label"))
    return rows.select("row_id", F.array(*(at(j) + _noise(seed, j) * deviation for j in range(len(centers[0])))).alias("features"), "label")


def rings(spark: SparkSession, n: int, kind: str = "moons", noise: float = 0.0, factor: float = 0.5, seed: int = 0) -> DataFrame:
    """(row_id, features, label): two interleaved half circles (``moons``) or a
    circle in another (``circles``, the inner one of radius ``factor``)."""
    if kind not in ("moons", "circles"):
        raise ValueError(f"unknown kind {kind!r}")
    turn = F.lit(math.pi) * _uniform(seed, 2) * (1 if kind == "moons" else 2)
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), turn.alias("t"))
    inner = F.col("label") == 1
    if kind == "moons":
        x, y = F.when(inner, 1 - F.cos("t")).otherwise(F.cos("t")), F.when(inner, 0.5 - F.sin("t")).otherwise(F.sin("t"))
    else:
        r = F.when(inner, float(factor)).otherwise(1.0)
        x, y = r * F.cos("t"), r * F.sin("t")
    return rows.select("row_id", F.array(x + _noise(seed, 0) * noise, y + _noise(seed, 1) * noise).alias("features"), "label")


def _uniform(seed: int, j: int) -> Column:
    """In (0, 1), by a hash of the row's id: the same whatever the partitions."""
    id_ = F.col("id") if j == 2 else F.col("row_id")
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(j), id_), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _noise(seed: int, j: int) -> Column:
    """Standard normal, from two uniform numbers."""
    return F.sqrt(-2 * F.log(_uniform(seed, 10 + 2 * j))) * F.cos(2 * math.pi * _uniform(seed, 11 + 2 * j))


def flatten_images(df: DataFrame, image: str = "image", out: str = "features") -> DataFrame:
    """Images (rows of pixels, or rows of pixels of channels) as flat vectors in row-major order."""
    depth = df.schema[image].dataType.simpleString().count("array<")
    if depth not in (2, 3):
        raise TypeError("an image is an array of arrays of pixels or of channels")
    flat = F.flatten(image) if depth == 2 else F.flatten(F.flatten(image))
    return df.withColumn(out, F.transform(flat, lambda x: x.cast("double")))


@dataclass(frozen=True)
class Scaler:
    """(x - shift) / scale per feature; a constant feature has scale 1."""

    shift: list[float]
    scale: list[float]

    def column(self, features: Column) -> Column:
        a, b = (F.array(*(F.lit(x) for x in v)) for v in (self.shift, self.scale))
        return F.zip_with(F.zip_with(features, a, lambda x, s: x - s), b, lambda x, s: x / s)

    def inverse_column(self, features: Column) -> Column:
        a, b = (F.array(*(F.lit(x) for x in v)) for v in (self.shift, self.scale))
        return F.zip_with(F.zip_with(features, b, lambda x, s: x * s), a, lambda x, s: x + s)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return df.withColumn(features, self.column(F.col(features)))

    def inverse_transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return df.withColumn(features, self.inverse_column(F.col(features)))


def _stats(df: DataFrame, features: str) -> tuple[dict, int]:
    """Mean, deviation, least and largest value of each feature, by m, s, l, h and its number."""
    d = vec.width(df, features)
    if d > vec.UNROLL:
        each = df.select(F.posexplode(F.col(features).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("l"), F.max("v").alias("h"))
        return {f"{n}{r['i']}": r[n] for r in each.collect() for n in "mslh"}, d
    x = [F.col(features)[i].cast("double") for i in range(d)]
    return df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("l", F.min), ("h", F.max)))).first(), d


def standardize_fit(df: DataFrame, features: str = "features") -> Scaler:
    """Mean and population standard deviation; 1 where all values are equal."""
    r, d = _stats(df, features)
    return Scaler([r[f"m{i}"] for i in range(d)], [r[f"s{i}"] if r[f"l{i}"] != r[f"h{i}"] else 1.0 for i in range(d)])


def minmax_fit(df: DataFrame, features: str = "features") -> Scaler:
    """Minimum and range; 1 where all values are equal. Nothing is clipped."""
    r, d = _stats(df, features)
    return Scaler([r[f"l{i}"] for i in range(d)], [(r[f"h{i}"] - r[f"l{i}"]) or 1.0 for i in range(d)])


def train_test_split(df: DataFrame, test_size: float = 0.2, shuffle: bool = True, seed: int = 0, row_id: str = "row_id", order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first round-half-even(test_size * n) rows by a hash of
    (seed, row_id), or by row_id without ``shuffle``, or by ``order``, are the test rows."""
    if not 0 <= test_size <= 1:
        raise ValueError("test_size must be between 0 and 1")
    marked = mark_test(df, test_size, shuffle, seed, row_id, order)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def mark_test(df: DataFrame, test_size: float = 0.2, shuffle: bool = True, seed: int = 0, row_id: str = "row_id", order: Column | None = None) -> DataFrame:
    n_test = round(test_size * df.count())
    key = order if order is not None else hash_key(seed, row_id) if shuffle else F.col(row_id)
    return positions(df, key, F.col(row_id), name="__pos").withColumn("is_test", F.col("__pos") < n_test).drop("__pos")
