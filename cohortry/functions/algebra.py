"""p x p algebra for p features: distributed passes produce the matrix, the driver solves it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import col
from cohortry.session import MAX_COLUMNS, BoundExceeded, cut_lineage


def assemble(df: DataFrame, columns: list[str], name: str = "features", keep: list[str] | None = None) -> DataFrame:
    """One dense ML vector per row."""
    safe = [f"_x{i}" for i in range(len(columns))]
    shaped = df.select(*[col(k) for k in keep or []], *[col(c).cast("double").alias(s) for c, s in zip(columns, safe)])
    return VectorAssembler(inputCols=safe, outputCol=name, handleInvalid="error").transform(shaped).drop(*safe)


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson matrix from one distributed pass (tree aggregate in the JVM); constant columns give zero rows."""
    if len(columns) > MAX_COLUMNS:
        raise BoundExceeded(f"{len(columns)} columns need a matrix larger than the driver bound of {MAX_COLUMNS}")
    matrix = Correlation.corr(assemble(df, columns), "features").first()[0].toArray()
    matrix = np.where(np.isfinite(matrix), matrix, 0.0)
    np.fill_diagonal(matrix, 1.0)
    return matrix


def constant_columns(df: DataFrame, columns: list[str]) -> set[str]:
    row = df.agg(*[(F.min(col(c)) == F.max(col(c))).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if row[i] or row[i] is None}


def standardised_covariance(df: DataFrame, columns: list[str], flat: set[str] | None = None) -> np.ndarray:
    """Covariance of the standardised columns: the correlations, with zeros for constant columns."""
    matrix = correlation_matrix(df, columns)
    constant = constant_columns(df, columns) if flat is None else flat
    for i, c in enumerate(columns):
        if c in constant:
            matrix[i, :] = matrix[:, i] = 0.0
    return matrix


def eigen_descending(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    return np.clip(values[order], 0.0, None), vectors[:, order]


def vif_from_correlation(matrix: np.ndarray, names: list[str]) -> dict[str, float]:
    """1 / (1 - R^2) per column = the diagonal of the inverse; exact dependence gives infinity."""
    p = len(names)
    if p < 2:
        return {n: float("nan") for n in names}
    live = [i for i in range(p) if matrix[i, i] > 0]
    out = {n: 1.0 for n in names}  # a constant column explains nothing and nothing explains it
    if len(live) < 2:
        return out
    block = matrix[np.ix_(live, live)]
    values, vectors = np.linalg.eigh(block)
    null = values < 1e-12 * max(values.max(), 1.0)
    inverse = (vectors[:, ~null] ** 2 / values[~null]).sum(axis=1)
    involved = (vectors[:, null] ** 2).sum(axis=1) > 1e-8 if null.any() else np.zeros(len(live), dtype=bool)
    for j, i in enumerate(live):
        out[names[i]] = math.inf if involved[j] else float(max(inverse[j], 1.0))
    return out


def triangular_factor(df: DataFrame, columns: list[str], fan_in: int = 16) -> np.ndarray:
    """R of a tall-skinny QR: each partition folds its rows into a p x p factor, factors are folded in a tree.

    Works on the rows themselves, not on their Gram matrix, so that a relative
    tolerance of 1e-8 is still meaningful.
    """
    p = len(columns)
    if p > MAX_COLUMNS:
        raise BoundExceeded(f"{p} columns")
    schema = "node long, r array<double>"

    def fold(blocks) -> np.ndarray:
        r = np.zeros((0, p))
        for b in blocks:
            r = np.linalg.qr(np.vstack([r, b]), mode="r")
        return r

    def per_partition(batches):
        from pyspark import TaskContext

        r = fold(b.to_numpy(dtype=float) for b in batches)
        if len(r):  # a partition without rows has no factor, and Arrow cannot type an empty list column
            node = TaskContext.get().partitionId()
            yield pd.DataFrame({"node": [node] * len(r), "r": [row.tolist() for row in r]})

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack(pdf["r"].to_numpy()), mode="r")
        return pd.DataFrame({"node": [int(pdf["node"].iloc[0]) // fan_in] * len(r), "r": [row.tolist() for row in r]})

    level = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInPandas(per_partition, schema)
    level = cut_lineage(level)
    while level.select("node").distinct().count() > 1:
        grouped = level.withColumn("_parent", F.floor(F.col("node") / fan_in)).groupBy("_parent")
        level = cut_lineage(grouped.applyInPandas(per_group, schema))
    rows = [r["r"] for r in level.collect()]  # at most p rows of p values
    return np.array(rows, dtype=float).reshape(-1, p)


def dependent_columns(r: np.ndarray, names: list[str], tolerance: float = 1e-8) -> list[str]:
    """Columns outside the independent set found by greedy column pivoting on R."""
    work = r.copy()
    remaining = list(range(len(names)))
    kept: list[int] = []
    first = None
    while remaining:
        norms = {j: float(np.linalg.norm(work[:, j])) for j in remaining}
        j = max(remaining, key=lambda c: (norms[c], -c))
        if first is None:
            first = norms[j]
        if norms[j] <= (first * tolerance if first > 0 else 1e-10):
            break
        q = work[:, j] / norms[j]
        for other in remaining:
            if other != j:
                work[:, other] -= q * float(q @ work[:, other])
        kept.append(j)
        remaining.remove(j)
    return [n for i, n in enumerate(names) if i not in kept]


def beta_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution, by the continued fraction of the incomplete beta function."""
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return _incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    # modified Lentz evaluation
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return min(1.0, front * total / a)
