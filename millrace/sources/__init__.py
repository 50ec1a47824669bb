"""Readers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def headerless_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV file without a header, with the given column names and types."""
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()])
    return spark.read.csv(path, schema=schema, header=False, mode="FAILFAST")
