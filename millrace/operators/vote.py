"""Weighted votes and averages per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority_vote(df: DataFrame, by: list[str], label: str, weight: str | Column | None = None, out: str = "vote") -> DataFrame:
    """The label with the most weight per group; ties, and groups without
    weight, go to the smallest label. Two partial aggregations, no window."""
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    sums = df.groupBy(*by, F.col(label).alias("__l")).agg(F.round(F.sum(w), 9).alias("__w"))
    return sums.groupBy(*by).agg(F.min_by("__l", F.struct(-F.col("__w"), F.col("__l"))).alias(out))


def average_label(df: DataFrame, by: list[str], value: str, weight: str | Column | None = None, out: str = "average") -> DataFrame:
    """Weighted mean per group; the plain mean where the weights sum to zero."""
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    v = F.col(value).cast("double")
    sums = df.groupBy(*by).agg(F.sum(w * v).alias("__wv"), F.sum(w).alias("__w"), F.avg(v).alias("__v"))
    return sums.select(*by, F.when(F.col("__w") == 0, F.col("__v")).otherwise(F.col("__wv") / F.when(F.col("__w") != 0, F.col("__w"))).alias(out))
