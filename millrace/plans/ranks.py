"""Global row positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import cut


#: A row's number within its partition is in the low bits of Spark's increasing id.
WITHIN = 33


def numbered(df: DataFrame, name: str = "pos") -> DataFrame:
    """``df`` written once, plus a gapless 0-based number of each row by partition
    and place in it. Rows per partition, a row each, are summed on the driver."""
    marked = cut(df.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", WITHIN).cast("int")
    rows, before = [], 0
    for r in sorted(marked.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"]):
        rows.append((r["p"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(rows, "__p int, __before long")
    got = marked.join(F.broadcast(offsets), part == F.col("__p"), "left")
    return got.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << WITHIN) - 1))).drop("__m", "__p", "__before")


def positions(df: DataFrame, key: Column, *ties: Column, name: str = "pos", parts: int | None = None) -> DataFrame:
    """``df`` plus the 0-based position of each row by (key, ties).

    Rows are dealt by ranges of (key, ties) that Spark samples to equal sizes, so
    neither an outlier nor a frequent key fills a task: rows of one key are
    spread by their ties. They are sorted within the ranges and written once;
    a range's rows start where those of the ranges before it end. Rows equal in
    key and ties have adjacent positions, in no order of theirs."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [f"__o{i}" for i in range(1 + len(ties))]
    keyed = df.withColumns(dict(zip(by, (key, *ties))))
    return numbered(keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*by), name)


def hash_key(seed: int, *cols: str | Column) -> Column:
    """A non-negative 62-bit hash: a random but repeatable order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 2)
