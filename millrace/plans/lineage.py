"""Reliable lineage cuts: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only in a
    local session that has none, deleted when Python exits."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def cut(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written once to the shared folder, as a frame that reads the table:
    the plan behind it runs once, and a lost executor costs a re-read. With
    ``by``, each value of those columns is a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


#: Rows of a shuffle for each of its partitions.
TASK_ROWS = 1 << 18


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, what runs shuffles into as many partitions as ``rows`` ask for, so
    that a task's sorts and hash tables do not grow with the input. Never fewer
    than set. Adaptive execution may not join them again where there is more than
    one task's worth of rows: it goes by compressed bytes, in which a few megabytes
    of keys are millions of rows."""
    key, joins = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (key, joins)}
    spark.conf.set(key, str(max(int(before[key]), -(-rows // TASK_ROWS))))
    if rows > TASK_ROWS:
        spark.conf.set(joins, "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def drop(*frames: DataFrame) -> None:
    """Delete cut tables that no frame in use reads any more."""
    for f in frames:
        sc = f.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f._cut_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
