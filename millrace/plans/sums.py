"""Sums of wide vectors: numpy within a partition, Spark across them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SLICE = 8192  #: doubles of a vector that travel together


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _parts(step: Callable[[pa.RecordBatch], np.ndarray], salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = None, TaskContext.get().partitionId() % salts
        for b in batches:
            if b.num_rows:
                got = step(b)
                total = got if total is None else total + got
        if total is not None:
            at = range(0, len(total), SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([salt] * len(at), pa.int64()), pa.array([total[i : i + SLICE] for i in at], pa.list_(pa.float64()))], names=["at", "salt", "v"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    total = matrix(table.column("v")).sum(axis=0)
    return pa.table({"at": table.column("at").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})


def vector_sum(df: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray], salts: int = 32) -> np.ndarray | None:
    """The sum over all batches of ``step(batch)``, a vector of one length; None
    without rows. Partial sums meet slice by slice, first within salts, so that
    neither a task nor the driver holds more than a few of them."""
    parts = df.mapInArrow(_parts(step, salts), "at long, salt long, v array<double>")
    once = parts.groupBy("at", "salt").applyInArrow(_merge, "at long, v array<double>")
    got = sorted(once.groupBy("at").applyInArrow(_merge, "at long, v array<double>").collect(), key=lambda r: r["at"])
    return np.concatenate([r["v"] for r in got]) if got else None
