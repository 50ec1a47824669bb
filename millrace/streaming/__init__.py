"""Streams: scoring by projection-only models, and training batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from millrace.operators import persist


def score_stream(stream: DataFrame, model, checkpoint: str, path: str) -> DataStreamWriter:
    """A writer that appends ``model.transform(stream)`` to Parquet files at ``path``."""
    if not stream.isStreaming:
        raise ValueError("a streaming frame is needed")
    return model.transform(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path)


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batch ids whose models are at ``path``, in order."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if f.getPath().getName().startswith("batch="))


def trained(spark: SparkSession, path: str, start):
    """The model after the last batch, or ``start`` before the first."""
    known = versions(spark, path)
    return persist.load(spark, f"{path}/batch={known[-1]}") if known else start


def train_stream(stream: DataFrame, start, step: Callable, checkpoint: str, path: str, keep: int = 8) -> DataStreamWriter:
    """A writer that trains batch after batch: ``step(model, rows)`` gives the
    next model. Models are versions at ``path``, named by their batch; a version
    appears whole or not at all. A batch that is replayed after a failure starts
    from the version before it, or changes nothing if its own is there, so the
    weights are those of one run. The last ``keep`` versions stay."""
    if not stream.isStreaming:
        raise ValueError("a streaming frame is needed")

    def batch(rows: DataFrame, id_: int) -> None:
        spark = rows.sparkSession
        known = versions(spark, path)
        if id_ in known:
            return
        before = [v for v in known if v < id_]
        model = persist.load(spark, f"{path}/batch={before[-1]}") if before else start
        fresh = f"{path}/_new-{uuid.uuid4().hex}"
        persist.save(spark, step(model, rows), fresh)
        fs, new = _folder(spark, fresh)
        fs.rename(new, _folder(spark, f"{path}/batch={id_}")[1])
        for v in before[: -keep + 1] if keep > 1 else before:
            fs.delete(_folder(spark, f"{path}/batch={v}")[1], True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
