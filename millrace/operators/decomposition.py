"""Principal components from triangular factors, or by block Lanczos passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import vec
from millrace.functions.blas import single_thread
from millrace.operators.prep import Scaler, standardize_fit
from millrace.plans.lineage import cut, drop
from millrace.plans.sums import matrix, vector_sum


WIDE = 4096  #: loadings beyond which plans hold no literals of them


def _affine(components: list[list[float]], scaler: Scaler, back: bool = False):
    """Vectors projected on the components, or restored from that."""
    c, shift, scale = np.array(components), np.array(scaler.shift), np.array(scaler.scale)

    def project(x: pd.Series) -> pd.Series:
        x = np.stack(x.to_numpy())
        return pd.Series(list(x @ c * scale + shift if back else (x - shift) / scale @ c.T))

    return F.pandas_udf(project, "array<double>")


DENSE = 1024  #: features up to which a triangle of them may be held


def _triangle(shift: np.ndarray, by: np.ndarray):
    """A partition's rows -> the triangular factor of its centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(shift)))
        for b in batches:
            if b.num_rows:
                r = np.linalg.qr(np.concatenate((r, (matrix(b.column("x")) - shift) / by)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    return run


def _stack(d: int):
    def run(t: pa.Table) -> pa.Table:
        rows = np.concatenate([np.asarray(v.values).reshape(-1, d) for v in t.column("r")])
        r = np.linalg.qr(rows, mode="r")
        return pa.table({"part": t.column("part").slice(0, 1), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    return run


def _by_triangles(x: DataFrame, shift: np.ndarray, by: np.ndarray, fan_in: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of the centred rows: triangles of the
    partitions are stacked and reduced, ``fan_in`` at a time, to one."""
    d = len(shift)
    found = cut(x.mapInArrow(_triangle(shift, by), "part long, r array<double>"))
    while found.count() > 1:
        merged = found.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInArrow(_stack(d), "part long, r array<double>")
        found, before = cut(merged), found
        drop(before)
    _, s, v = np.linalg.svd(np.array(found.first()["r"]).reshape(-1, d), full_matrices=False)
    return s, v


def _by_krylov(x: DataFrame, shift: np.ndarray, by: np.ndarray, k: int, steps: int = 40, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values and their vectors by block Lanczos with
    full reorthogonalisation. A step is one pass over the rows, which adds up
    products with a block of k + 8 vectors; at most ``steps`` blocks are held."""
    d = len(shift)
    width = min(d, k + 8)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(d, width)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(steps):

        def product(b: pa.RecordBatch, v: np.ndarray = block) -> np.ndarray:
            z = (matrix(b.column("x")) - shift) / by
            return (z.T @ (z @ v)).ravel()

        out = vector_sum(x, product).reshape(d, -1)
        basis, image = np.concatenate((basis, block), axis=1), np.concatenate((image, out), axis=1)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        miss = np.linalg.norm(image @ turn - basis @ turn * values, axis=0)
        if (miss <= tol * max(values[0], 1e-300)).all() or basis.shape[1] + 1 > d:
            break
        for _ in range(2):
            out = out - basis @ (basis.T @ out)
        block, size = np.linalg.qr(out)
        block = block[:, np.abs(np.diag(size)) > 1e-13 * max(values[0], 1e-300)][:, : d - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:
            break
    return np.sqrt(np.maximum(values, 0)), (basis @ turn).T


@dataclass(frozen=True)
class PCA:
    """Components of the covariance (of scaled features by default); the largest
    loading of each is positive. ``n_components``: None for all, a count, or the
    variance share to reach.

    Up to ``DENSE`` features, and for all components or a share of more, the
    centred rows are reduced to one triangle by QR factors; a count of
    components of more features is found by block Lanczos, and nothing of
    features x features is formed."""

    n_components: int | float | None = None
    scale: bool = True
    features: str = "features"

    def fit(self, df: DataFrame) -> PCAModel:
        d = vec.width(df, self.features)
        if isinstance(self.n_components, float) and not 0 < self.n_components < 1:
            raise ValueError("a float n_components must lie between 0 and 1")
        n = df.count()
        if isinstance(self.n_components, int) and not 1 <= self.n_components <= min(n, d):
            raise ValueError("n_components must be between 1 and min(rows, features)")
        scaler = standardize_fit(df, self.features)
        scale = scaler.scale if self.scale else [1.0] * d
        shift, by = np.array(scaler.shift), np.array(scale)
        x = df.select(F.col(self.features).cast("array<double>").alias("x"))
        single_thread()
        if d > DENSE and isinstance(self.n_components, int):
            s, vectors = _by_krylov(x, shift, by, self.n_components)
            # the deviations of constant features are 1 here and count for nothing
            spread = F.transform("x", lambda v, i: (v - F.get(F.lit(shift.tolist()), i)) / F.get(F.lit(by.tolist()), i))
            total = x.agg(F.sum(F.aggregate(F.transform(spread, lambda v: v * v), F.lit(0.0), lambda a, v: a + v))).first()[0]
        else:
            s, vectors = _by_triangles(x, shift, by)
            total = float((s * s).sum())
        values = s * s / max(n - 1, 1)
        vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
        k, share = min(n, d), s * s / total if total > 0 else np.zeros(len(s))
        if isinstance(self.n_components, float):
            k = min(len(s), int(np.searchsorted(np.cumsum(share), self.n_components) + 1))
        elif self.n_components is not None:
            k = self.n_components
        return PCAModel(self, Scaler(scaler.shift, scale), vectors[:k].tolist(), values[:k].tolist(), share[:k].tolist(), np.sqrt(values[:k] * max(n - 1, 0)).tolist())


@dataclass(frozen=True)
class PCAModel:
    params: PCA
    scaler: Scaler
    components: list[list[float]]
    explained_variance: list[float]
    explained_variance_ratio: list[float]
    singular_values: list[float]

    @property
    def cumulative_variance_ratio(self) -> list[float]:
        """Share of the variance that the first 1, 2, ... components hold."""
        return np.cumsum(self.explained_variance_ratio).tolist()

    def transform(self, df: DataFrame, out: str = "pca") -> DataFrame:
        x, d = F.col(self.params.features), len(self.scaler.shift)
        if d * len(self.components) > WIDE:
            return df.withColumn(out, _affine(self.components, self.scaler)(x.cast("array<double>")))
        z = self.scaler.column(x.cast("array<double>"))
        return df.withColumn("__z", z).withColumn(out, F.array(*(vec.dot(F.col("__z"), c, d) for c in self.components))).drop("__z")

    def inverse_transform(self, df: DataFrame, pca: str = "pca", out: str = "restored") -> DataFrame:
        k = len(self.components)
        if len(self.scaler.shift) * k > WIDE:
            return df.withColumn(out, _affine(self.components, self.scaler, back=True)(F.col(pca)))
        z = F.array(*(vec.dot(F.col(pca), [c[i] for c in self.components], k) for i in range(len(self.scaler.shift))))
        return df.withColumn(out, self.scaler.inverse_column(z))

    def score(self, df: DataFrame) -> float:
        """Minus the mean squared error of the restored features, in their own units."""
        back = self.inverse_transform(self.transform(df, "__p"), "__p", "__r")
        d = len(self.scaler.shift)
        miss = F.zip_with(F.col(self.params.features).cast("array<double>"), "__r", lambda a, b: (a - b) * (a - b))
        return back.agg(-F.avg(F.aggregate(miss, F.lit(0.0), lambda s, v: s + v) / d)).first()[0]
