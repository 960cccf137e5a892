"""Helpers for tables of points: an id column and an ``array<double>`` column named ``features``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import col
from cohortry.session import MAX_CLUSTERS, take_bounded


def points(df: DataFrame, key: str, columns: list[str] | None = None, vector: str | None = None) -> DataFrame:
    """(id, features) from numeric columns or from an existing array column."""
    if vector is not None:
        body = F.transform(col(vector), lambda x: x.cast("double"))
    else:
        body = F.array(*[col(c).cast("double") for c in columns])
    return df.select(col(key).alias("id"), body.alias("features"))


def matrix_of(pdf: pd.DataFrame, column: str = "features") -> np.ndarray:
    return np.vstack(pdf[column].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 0))


def with_vector(df: DataFrame, name: str = "vector") -> DataFrame:
    return df.withColumn(name, array_to_vector("features"))


def dimension(df: DataFrame) -> int:
    row = df.select(F.size("features")).first()
    return row[0] if row else 0


@dataclass
class ClusterStats:
    """Per-cluster size, centroid and summed squares: k rows, held on the driver."""

    labels: list
    n: np.ndarray
    centroids: np.ndarray
    squares: np.ndarray

    @property
    def total(self) -> int:
        return int(self.n.sum())


def cluster_stats(labelled: DataFrame, label: str = "cluster_id") -> ClusterStats:
    """One map-side-combined pass over (features, label)."""
    v = array_to_vector("features")
    grouped = labelled.groupBy(col(label).alias("label")).agg(
        Summarizer.metrics("mean", "count", "normL2").summary(v).alias("s")
    )
    flat = grouped.select("label", F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.normL2").alias("norm"))
    rows = sorted(take_bounded(flat, MAX_CLUSTERS, "clusters"), key=lambda r: r["label"])
    if not rows:
        return ClusterStats([], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    return ClusterStats(
        [r["label"] for r in rows],
        np.array([r["n"] for r in rows], dtype=float),
        np.array([r["mean"] for r in rows], dtype=float),
        np.array([float(np.square(r["norm"]).sum()) for r in rows]),
    )


DISTANCE_CELLS = 1 << 16  # distances held at a time by ``nearest``: 512 KiB, which stay in a core's cache


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    d -= 2.0 * x @ y.T
    return np.maximum(d, 0.0, out=d)


def lifted(y: np.ndarray) -> np.ndarray:
    """Rows (-2 y, y.y): their product with (x, 1) is the squared distance to x less x.x, which no choice among them depends on."""
    return np.hstack([-2.0 * y, (y * y).sum(axis=1)[:, None]])


def nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the place of the nearest row of y and its squared distance; strips of x bound the memory, whatever the size of y."""
    marks, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, DISTANCE_CELLS // len(y))
    rows, centres = np.hstack([x, np.ones((len(x), 1))]), lifted(y).T
    for at in range(0, len(x), step):
        d = rows[at : at + step] @ centres
        here = d.argmin(axis=1)
        marks[at : at + step], far[at : at + step] = here, d[np.arange(len(here)), here]
    far += (x * x).sum(axis=1)
    return marks, np.maximum(far, 0.0, out=far)
