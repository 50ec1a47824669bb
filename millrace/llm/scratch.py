"""Shared-folder tables that cut lineage.

A step whose result is read more than once is written as Parquet into the
folder named by ``spark.checkpoint.dir``, which every executor can read, so a
lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.lineage import shared_dir


class Scratch:
    """Tables of one operator call, under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return a frame that reads the written table."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Ask the driver's JVM to collect garbage, after a step that shuffled
        whole texts: its shuffles are then unreferenced and the context cleaner
        deletes their files long before its own round of every half hour. The
        driver's heap, which thousands of tasks have widened, shrinks again."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no returned frame reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in frames:
            path = jvm.org.apache.hadoop.fs.Path(f._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit identity of a row by id and text, null-safe: rows equal in both
    share it, and operators treat them as repeated rows."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("\x00", part(doc_id), part(text)))


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named c0, c1, ..., which clash with nothing and hold
    no dots, and the new name of each old one."""
    back = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in back.items())), back


def named(back: dict[str, str]) -> list[Column]:
    """The columns of a renamed frame under their old names."""
    return [F.col(n).alias(c) for c, n in back.items()]


def first_of(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``, rows being alike otherwise."""
    return df.dropDuplicates([key])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
