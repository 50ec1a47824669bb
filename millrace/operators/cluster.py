"""k-means and density-based clustering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vec
from millrace.operators.density import Density, by_blocks, by_grid
from millrace.operators.neighbors import pairs
from millrace.operators.validate import positive_int
from millrace.plans.components import components
from millrace.plans.lineage import cut, drop
from millrace.plans.ranks import hash_key, positions
from millrace.plans.sums import matrix, vector_sum


WIDE = 2048  #: centre components beyond which plans hold no literals of them


def _distances(x: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """Rows by centres; squares for the euclidean metric."""
    part = x[:, None]
    return np.abs(part - centers).sum(axis=2) if metric == "manhattan" else ((part - centers) ** 2).sum(axis=2)


def _cells(x: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """Number of the nearest centre; ties to the lower one."""
    out = np.zeros(len(x), np.int64)
    for i in range(0, len(x), 1024):
        out[i : i + 1024] = _distances(x[i : i + 1024], centers, metric).argmin(axis=1)
    return out


def _bounded(centers: np.ndarray, metric: str):
    """Rows x -> x, the nearest centre, its distance, and that of the next nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                col = b.column("x").slice(i, 1024)
                away = _distances(matrix(col), centers, metric)
                cell, at = away.argmin(axis=1), np.arange(len(away))
                near = away[at, cell]
                away[at, cell] = np.inf
                far = away.min(axis=1)
                near, far = (near, far) if metric == "manhattan" else (np.sqrt(near), np.sqrt(far))
                yield pa.RecordBatch.from_arrays([col, pa.array(cell, pa.int32()), pa.array(near), pa.array(far)], names=["x", "cell", "near", "far"])

    return run


def _cluster_sums(centers: np.ndarray, moved: np.ndarray, metric: str):
    """Sums and counts by cluster, and how many rows had to be compared: those that
    the distances to the bounds' centres, less what these have ``moved`` since, leave open."""
    most = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))])

    def step(b: pa.RecordBatch) -> np.ndarray:
        x, cell = matrix(b.column("x")), b.column("cell").to_numpy().astype(np.int64)
        near, far = b.column("near").to_numpy() + moved[cell], b.column("far").to_numpy() - most[cell]
        # rounding must not decide; without a move the cells are as they were computed
        open_ = ~(near * (1 + 1e-9) < far * (1 - 1e-9)) & bool(moved.any())
        cell[open_] = _cells(x[open_], centers, metric)
        sums = np.zeros((len(centers), x.shape[1] + 1))
        np.add.at(sums, cell, np.concatenate((x, np.ones((len(x), 1))), axis=1))
        return np.append(sums.ravel(), open_.sum())

    return step


def _nearest(x: Column, centers: list[list[float]], metric: vec.Metric) -> Column:
    each = F.array(*(metric(x, F.array(*(F.lit(float(v)) for v in c))) for c in centers))
    return F.transform(F.array(each), vec.argmin)[0]


def _shifts(old: list[list[float]], new: list[list[float]], metric: str) -> np.ndarray:
    diff = np.array(new) - np.array(old)
    return np.abs(diff).sum(axis=1) if metric.lower() == "manhattan" else np.sqrt((diff**2).sum(axis=1))


def max_shift(old: list[list[float]], new: list[list[float]], metric: str = "euclidean") -> float:
    """The farthest that a centre has moved."""
    return float(_shifts(old, new, metric).max())


@dataclass(frozen=True)
class KMeans:
    """Lloyd rounds until no centre moves by ``tol`` or more; mean centres for
    either metric, and the origin for an emptied cluster."""

    n_clusters: int
    metric: str = "euclidean"
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    features: str = "features"
    row_id: str = "row_id"
    initial_centers: list[list[float]] | None = None

    def __post_init__(self):
        positive_int("n_clusters", self.n_clusters)
        positive_int("max_iter", self.max_iter)
        if not isinstance(self.tol, float):
            raise TypeError("tol must be a float")
        if self.tol < 0:
            raise ValueError("tol must not be negative")
        vec.metric(self.metric, 1)

    def fit(self, df: DataFrame, order: Column | None = None) -> KMeansModel:
        """Starts at ``initial_centers``, or at rows drawn without replacement:
        the first by a hash of the seed and the row id, or by ``order``."""
        d = vec.width(df, self.features)
        x = F.col(self.features).cast("array<double>").alias("x")
        centers = self.initial_centers
        if centers is None:
            key = hash_key(self.seed, self.row_id) if order is None else order
            centers = [r["x"] for r in df.select(x, key.alias("k"), F.col(self.row_id).alias("i")).orderBy("k", "i").limit(self.n_clusters).collect()]
        if len(centers) != self.n_clusters:
            raise ValueError("fewer rows than clusters")
        if self.n_clusters * d > WIDE:
            return self._fit_bounded(df.select(x), centers, d)
        rows = df.select(x).persist()
        m, rounds = vec.metric(self.metric, d), 0
        for rounds in range(1, self.max_iter + 1):
            found = rows.select("x", _nearest(F.col("x"), centers, m).alias("c")).groupBy("c").agg(*(F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(d))).collect()
            means = {r["c"]: [r[f"x{i}"] for i in range(d)] for r in found}
            new = [means.get(c, [0.0] * d) for c in range(self.n_clusters)]
            shift = max_shift(centers, new, self.metric)
            centers = new
            if shift < self.tol:
                break
        rows.unpersist()
        return KMeansModel(self, centers, rounds)

    def _fit_bounded(self, rows: DataFrame, centers: list[list[float]], d: int) -> KMeansModel:
        """Rows are kept with their cell and the distances of the nearest two centres.
        A row is compared again only where the moves of the centres since then may
        have changed its cell. The table is written anew once half of the rows are
        compared while the centres move less than half as far as when it was written."""
        name, schema = self.metric.lower(), "x array<double>, cell int, near double, far double"
        write = lambda of, at: cut(of.mapInArrow(_bounded(np.array(at), name), schema))
        table, base, anew, calm, compared, rounds = None, centers, True, np.inf, [], 0
        for rounds in range(1, self.max_iter + 1):
            if anew:
                before, table, base = table, write(rows if table is None else table.select("x"), centers), centers
                if before is not None:
                    drop(before)
            found = vector_sum(table, _cluster_sums(np.array(centers), _shifts(base, centers, name), name))
            found = np.zeros(self.n_clusters * (d + 1) + 1) if found is None else found  # no rows
            sums = found[:-1].reshape(-1, d + 1)
            total = int(sums[:, -1].sum())
            compared.append(total if anew else int(found[-1]))
            new = [(s[:-1] / s[-1]).tolist() if s[-1] else [0.0] * d for s in sums]
            shift = max_shift(centers, new, self.metric)
            calm = shift if anew else calm
            anew = compared[-1] > total / 2 and shift < calm / 2 and not anew
            centers = new
            if shift < self.tol:
                break
        drop(table)
        return KMeansModel(self, centers, rounds, compared)


@dataclass(frozen=True)
class KMeansModel:
    params: KMeans
    centers: list[list[float]]
    n_iter: int
    #: Rows compared with all centres in each round, where bounds are kept.
    compared: list[int] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``cluster``, from 0; ties to the lower one."""
        m = vec.metric(self.params.metric, len(self.centers[0]))
        if len(self.centers) * len(self.centers[0]) > WIDE:
            centers, name = np.array(self.centers), self.params.metric.lower()
            cells = F.pandas_udf(lambda x: pd.Series(_cells(np.stack(x.to_numpy()), centers, name)), "int")
            return df.withColumn("cluster", cells(F.col(self.params.features).cast("array<double>")))
        return df.withColumn("cluster", _nearest(F.col(self.params.features).cast("array<double>"), self.centers, m))


def _by_pairs(rows: DataFrame, eps: float, min_samples: int, m: vec.Metric) -> Density:
    """For a metric of which nothing is known: all pairs are compared."""
    other = rows.select(F.col("a").alias("b"), F.col("x").alias("y"), F.col("w").alias("v"))
    half = cut(pairs(rows, other, (F.col("a") < F.col("b")) & (m(F.col("x"), F.col("y")) <= eps)).select("a", "b", "w", "v"))
    both = half.select("a", "b", F.col("v").alias("w")).unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    n = both.groupBy("a").agg(F.sum("w").alias("n"))
    core = cut(rows.select("a", "w").join(n, "a", "left").where(F.coalesce("n", F.lit(0)) + F.col("w") >= min_samples).select("a"))
    ends = half.join(core, "a", "left_semi").join(core.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    border = both.join(core, "a", "left_anti").join(core.select(F.col("a").alias("b")), "b", "left_semi").select("a", F.col("b").alias("node"))
    return Density(core.withColumn("node", F.col("a")), ends, border)


@dataclass(frozen=True)
class DBSCAN:
    """Density clusters from 1 in the order of their smallest core row; noise is
    0, and a border row takes the smallest cluster among its core neighbours."""

    eps: float = 0.5
    min_samples: int = 5
    metric: str | vec.Metric = "euclidean"
    features: str = "features"
    row_id: str = "row_id"

    def __post_init__(self):
        if not isinstance(self.eps, (int, float)) or isinstance(self.eps, bool):
            raise TypeError("eps must be a number")
        if self.eps <= 0:
            raise ValueError("eps must be positive")
        positive_int("min_samples", self.min_samples)
        if not callable(self.metric):
            vec.metric(self.metric, 1)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``cluster``. Vectors that are null or hold null or
        non-finite components are noise."""
        d = vec.width(df, self.features)
        ids = df.select(F.col(self.row_id).cast("long").alias("id"), F.col(self.features).cast("array<double>").alias("x"))
        # equal vectors are one row, named by the smallest of them
        once = cut(ids.where(vec.finite(F.col("x"))).groupBy("x").agg(F.min("id").alias("a"), F.count("*").alias("w")))
        rows = once.select("a", "x", "w")
        if callable(self.metric):
            found = _by_pairs(rows, self.eps, self.min_samples, vec.metric(self.metric, d))
        elif d <= 3:
            found = by_grid(rows, d, self.eps, self.min_samples, self.metric.lower())
        else:
            found = by_blocks(rows, self.eps, self.min_samples, self.metric.lower())
        nodes = found.core.select("node").distinct()
        root = cut(nodes.join(components(found.edges), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
        # clusters are numbered over their distinct roots alone
        number = positions(root.select("root").distinct(), F.col("root"), name="k").select("root", (F.col("k") + 1).cast("int").alias("k"))
        number = cut(root.join(number, "root").select("node", "k"))
        inner = found.core.join(number, "node").select("a", "k")
        border = found.border.join(number, "node").groupBy("a").agg(F.min("k").alias("k"))
        k = rows.join(inner.unionByName(border), "a").select("x", "k")
        found = ids.join(k, "x").select("id", "k")
        return df.join(found, df[self.row_id].cast("long") == found["id"], "left").withColumn("cluster", F.coalesce("k", F.lit(0))).drop("id", "k")


def cluster_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: n_clusters and n_noise."""
    return df.agg(F.coalesce(F.max(cluster), F.lit(0)).cast("int").alias("n_clusters"), F.count_if(F.col(cluster) == 0).alias("n_noise"))
