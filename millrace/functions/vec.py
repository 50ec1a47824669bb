"""Column kernels over fixed-width ``array<double>`` features.

Up to ``UNROLL`` elements the sums are written out, so that they stay inside
whole-stage code generation; wider vectors use higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL = 128


def width(df: DataFrame, features: str = "features") -> int:
    """The one width of all vectors; ValueError if widths differ or there are none."""
    lo, hi, bad = df.agg(F.min(F.size(features)), F.max(F.size(features)), F.count_if(F.col(features).isNull())).first()
    if lo is None or lo < 1:
        raise ValueError("features must not be empty")
    if lo != hi or bad:
        raise ValueError("all feature vectors must have the same width")
    return lo


def total(terms: list[Column]) -> Column:
    return reduce(add, terms) if terms else F.lit(0.0)


def dot(a: Column, b: Column | list[float], d: int) -> Column:
    other = (lambda i: F.lit(float(b[i]))) if isinstance(b, list) else (lambda i: b[i])
    if d <= UNROLL:
        return total([a[i] * other(i) for i in range(d)])
    arr = F.array(*(F.lit(float(x)) for x in b)) if isinstance(b, list) else b
    return F.aggregate(F.zip_with(a, arr, lambda x, y: x * y), F.lit(0.0), add)


def euclidean(a: Column, b: Column, d: int) -> Column:
    if d <= UNROLL:
        return F.sqrt(total([(a[i] - b[i]) * (a[i] - b[i]) for i in range(d)]))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), add))


def manhattan(a: Column, b: Column, d: int) -> Column:
    if d <= UNROLL:
        return total([F.abs(a[i] - b[i]) for i in range(d)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), add)


Metric = Callable[[Column, Column], Column]


def expression(f: Callable, *cols: Column) -> Column | None:
    """What ``f`` makes of columns, or None if it is not made for them."""
    try:
        got = f(*cols)
    except Exception:
        return None
    return got if isinstance(got, Column) else None


def applied(f: Callable, *cols: Column) -> Column:
    """``f`` of columns: its own expression if it gives one, else a Python
    function of values (numpy arrays for vectors) run on Arrow batches."""
    got = expression(f, *cols)
    if got is not None:
        return got
    plain = lambda *args: pd.Series([float(f(*v)) for v in zip(*args)], dtype="float64")
    return F.pandas_udf(plain, "double")(*cols)


def metric(name: str | Callable, d: int) -> Metric:
    """A metric by name (any case), or a callable of two columns or of two numpy vectors."""
    if callable(name):
        return lambda a, b: applied(name, a, b)
    known = {"euclidean": euclidean, "manhattan": manhattan}
    if str(name).lower() not in known:
        raise ValueError(f"unknown metric {name!r}")
    f = known[str(name).lower()]
    return lambda a, b: f(a, b, d)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def relu(z: Column) -> Column:
    return F.greatest(F.lit(0.0), z)


def relu_grad(z: Column) -> Column:
    return F.when(z > 0, 1.0).otherwise(0.0)


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), add))


def argmax(a: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    """Index of the first smallest element."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def finite(features: Column) -> Column:
    return F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
