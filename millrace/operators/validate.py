"""Input checks: schema on the driver, data in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import vec


def check_features(df: DataFrame, features: str = "features", finite: bool = True) -> int:
    """Width of the vectors. TypeError for a column that is no array of
    numbers; ValueError for empty input, unequal widths, or (where ``finite``)
    null, NaN or infinite components."""
    kind = df.schema[features].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise TypeError(f"{features} must be an array of numbers")
    got = df.agg(F.min(F.size(features)).alias("lo"), F.max(F.size(features)).alias("hi"), F.count_if(F.col(features).isNull()).alias("nulls"), F.count_if(~vec.finite(F.col(features))).alias("bad")).first()
    if got["lo"] is None or got["lo"] < 1:
        raise ValueError("at least one row and one feature are needed")
    if got["lo"] != got["hi"] or got["nulls"]:
        raise ValueError("all feature vectors must have the same width")
    if finite and got["bad"]:
        raise ValueError("features must be finite")
    return got["lo"]


def check_numeric(df: DataFrame, col: str, finite: bool = True) -> None:
    if not isinstance(df.schema[col].dataType, T.NumericType):
        raise TypeError(f"{col} must be numeric")
    x = F.col(col).cast("double")
    if finite and df.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).limit(1).count():
        raise ValueError(f"{col} must be finite")


def cast_lenient(df: DataFrame, *cols: str) -> DataFrame:
    """Columns cast to double; ValueError where a value that is not null cannot be."""
    tries = [F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(c) for c in cols]
    bad = df.agg(*tries).first()
    for c in cols:
        if bad[c]:
            raise ValueError(f"{c} has values that are no numbers")
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in cols})


def positive_int(name: str, value, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer")
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value
