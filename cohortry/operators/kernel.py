"""Linear machines (hinge loss) on random Fourier features of an RBF kernel, for all folds and classes at once.

Rows stay blocks of their few columns and are lifted inside each pass, which sums loss and gradient of every machine that is still
at work; the steps of all machines are taken side by side, so that the number of passes is that of the slowest one.
"""

from __future__ import annotations

from collections.abc import Generator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.partials import blocks_of, summed_blocks
from cohortry.session import cut_lineage

BLOCK_ROWS = 4_096
LEAST_ROWS = 512  # of a task that is worth its start
MEMORY = 10  # steps that the curvature is taken from
MAX_HALVINGS = 30


def _packed(rows: DataFrame) -> DataFrame:
    kind = dict(rows.dtypes)["id"]

    def pack(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                x = np.vstack(part["x"].to_numpy()).astype(float)
                yield pd.DataFrame({"ids": [part["id"].tolist()], "x": [x.tobytes()], "y": [part["y"].to_numpy(np.int64).tobytes()], "fold": [part["fold"].to_numpy(np.int64).tobytes()]})

    return rows.mapInPandas(pack, f"ids array<{kind}>, x binary, y binary, fold binary")


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(row["y"], np.int64)
    return np.frombuffer(row["x"], dtype=float).reshape(len(y), -1), y, np.frombuffer(row["fold"], np.int64)


def minimise(start: np.ndarray, steps: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS with halved steps: yields points, is sent (value, gradient), returns the best point."""
    x = start
    value, slope = yield x
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, kept = -slope, []
        for s, y, rho in reversed(past):
            a = rho * (s @ way)
            way = way - a * y
            kept.append(a)
        if past:
            s, y, rho = past[-1]
            way = way / (rho * (y @ y))
        for (s, y, rho), a in zip(past, reversed(kept)):
            way = way + s * (a - rho * (y @ way))
        falls = float(slope @ way)
        if not falls < 0:
            way, past = -slope, []
            falls = -float(slope @ slope)
        if falls == 0:
            break
        length = 1.0 if past else min(1.0, 1.0 / np.linalg.norm(slope))
        for _ in range(MAX_HALVINGS):
            there = x + length * way
            found, fresh = yield there
            if found <= value + 1e-4 * length * falls:
                break
            length /= 2
        else:
            break
        s, y = there - x, fresh - slope
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y, 1.0 / float(s @ y))][-MEMORY:]
        gain, x, value, slope = value - found, there, found, fresh
        if gain <= tolerance * max(abs(value), 1e-6):
            break
    return x


def out_of_fold(placed: DataFrame, classes: int, folds: int, w: np.ndarray, b: np.ndarray, penalty: float = 1e-3, steps: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """``id, y, pred`` of rows (id, y, features, fold): the class whose machine, fitted on the other folds, gives the largest margin.

    A machine parts one class from the others: mean hinge loss plus half of ``penalty`` times its squared weights on lifted columns of
    unit deviation, with a free intercept. ``w`` and ``b`` lift a row to sqrt(2 / n) cos(x w + b).
    """
    rows = placed.select("id", vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    sc, d, n_rows = placed.sparkSession.sparkContext, w.shape[1], rows.count()
    cores = sc.defaultParallelism
    if n_rows < cores * BLOCK_ROWS:  # small inputs arrive in few partitions
        rows = rows.repartition(max(1, min(cores, -(-n_rows // LEAST_ROWS))), F.xxhash64("id"))
    packed = _packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = blocks_of(packed, "x", "y", "fold")

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / d) * np.cos(x @ w + b)

    def moments(total, row):
        x, _y, fold = _arrays(row)
        z = lifted(x)
        for f in np.unique(fold):
            own = z[fold == f]
            total[f, 0] += len(own)
            total[f, 1 : d + 1] += own.sum(axis=0)
            total[f, d + 1 :] += np.square(own).sum(axis=0)

    own = summed_blocks(blocks, moments, folds, 1 + 2 * d)
    seen = own.sum(axis=0) - own
    n = np.maximum(seen[:, :1], 1.0)
    means = seen[:, 1 : d + 1] / n
    spread = np.sqrt(np.maximum(seen[:, d + 1 :] / n - means * means, 0.0) * n / np.maximum(n - 1, 1.0))
    scale = np.where(spread > 1e-12, 1.0 / np.maximum(spread, 1e-300), 0.0)

    def on_lifted(points: np.ndarray, fold_of: np.ndarray) -> np.ndarray:
        """Weights on scaled columns and intercepts -> weights on lifted columns and intercepts."""
        weights = points[:, :d] * scale[fold_of]
        return np.hstack([weights, points[:, d:] - (weights * means[fold_of]).sum(axis=1, keepdims=True)])

    def measure(models: list[int], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Penalised loss of each machine at its point, and its gradient."""
        fold_of, class_of = np.divmod(np.array(models), classes)
        shipped = sc.broadcast(on_lifted(points, fold_of))

        def add(total, row):
            x, y, fold = _arrays(row)
            z, at = lifted(x), shipped.value
            sign = np.where(y[:, None] == class_of, 1.0, -1.0)
            short = 1.0 - sign * (z @ at[:, :d].T + at[:, d])
            short *= fold[:, None] != fold_of
            wrong = short > 0
            pull = np.where(wrong, -sign, 0.0)
            total[:, :d] += pull.T @ z
            total[:, d] += pull.sum(axis=0)
            total[:, d + 1] += np.where(wrong, short, 0.0).sum(axis=0)

        sums = summed_blocks(blocks, add, len(models), d + 2) / n[fold_of]
        shipped.destroy()
        slopes = np.hstack([(sums[:, :d] - means[fold_of] * sums[:, d : d + 1]) * scale[fold_of] + penalty * points[:, :d], sums[:, d : d + 1]])
        return sums[:, d + 1] + 0.5 * penalty * np.square(points[:, :d]).sum(axis=1), slopes

    best = np.zeros((folds * classes, d + 1))
    work = {m: minimise(best[m], steps, tolerance) for m in range(len(best))}
    asked = {m: next(one) for m, one in work.items()}
    while asked:
        models = list(asked)
        values, slopes = measure(models, np.stack([asked[m] for m in models]))
        for i, m in enumerate(models):
            try:
                asked[m] = work[m].send((float(values[i]), slopes[i]))
            except StopIteration as done:
                best[m] = done.value
                del asked[m]
    final = on_lifted(best, np.arange(len(best)) // classes).reshape(folds, classes, d + 1)

    def predict(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x, y, fold = _arrays(row)
                z, pred = lifted(x), np.zeros(len(y))
                for f in np.unique(fold):
                    own = fold == f
                    pred[own] = (z[own] @ final[f, :, :d].T + final[f, :, d]).argmax(axis=1)
                yield pd.DataFrame({"id": row["ids"], "y": y.astype(float), "pred": pred})

    done = cut_lineage(packed.mapInPandas(predict, f"id {dict(placed.dtypes)['id']}, y double, pred double"))
    packed.unpersist()
    return done
