"""Penalised logistic models of all folds at once, by Newton's method on sums over blocks of rows.

A step is one pass: every fold's loss, gradient and second derivatives are summed over the rows that it may see. A dozen passes
reach the minimum, where line searches over one fold after another need some hundred jobs each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.partials import PART_SCHEMA, matrix_parts, summed_rows

MOST_WEIGHTS = 256  # classes times columns up to which second derivatives are held
BLOCK_ROWS = 4_096
MAX_STEPS = 100
TOLERANCE = 1e-10  # fall of a fold's mean loss that a step promises


def _packed(rows: DataFrame) -> DataFrame:
    kind = dict(rows.dtypes)["id"]

    def pack(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                x = np.vstack(part["x"].to_numpy()).astype(float)
                yield pd.DataFrame({"ids": [part["id"].tolist()], "x": [x.tobytes()], "y": [part["y"].to_numpy(np.int64).tobytes()], "fold": [part["fold"].to_numpy(np.int64).tobytes()]})

    return rows.mapInPandas(pack, f"ids array<{kind}>, x binary, y binary, fold binary")


def _unpacked(pdf: pd.DataFrame):
    for ids, x, y, fold in zip(pdf["ids"], pdf["x"], pdf["y"], pdf["fold"]):
        yield ids, np.frombuffer(x, dtype=float).reshape(len(ids), -1), np.frombuffer(y, np.int64), np.frombuffer(fold, np.int64)


def _shares(z: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each class for each row, and its log."""
    logs = z @ weights.T
    logs -= logs.max(axis=1, keepdims=True)
    logs -= np.log(np.exp(logs).sum(axis=1, keepdims=True))
    return np.exp(logs), logs


def out_of_fold(placed: DataFrame, classes: int, folds: int, penalty: float) -> DataFrame:
    """``id, y, pred`` of rows (id, y, features, fold), each predicted by the model that never saw its fold.

    The mean loss plus half of ``penalty`` times the squared weights of columns scaled to unit deviation is minimised; with two
    classes the weights are those of one against the other.
    """
    rows = placed.select("id", vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    packed = _packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    sc, tasks, first = placed.sparkSession.sparkContext, packed.rdd.getNumPartitions(), rows.select("x").first()
    kind = dict(placed.dtypes)["id"]
    if first is None:
        return placed.select("id", "y", F.lit(0.0).alias("pred"))
    shift, d = np.array(first["x"], dtype=float), len(first["x"])

    def sums(batches):
        total = np.zeros((folds, 1 + 2 * d))
        for pdf in batches:
            for _ids, x, _y, fold in _unpacked(pdf):
                moved = x - shift
                np.add.at(total, fold, np.hstack([np.ones((len(x), 1)), moved, moved * moved]))
        yield from matrix_parts(total)

    own = summed_rows(packed.mapInPandas(sums, PART_SCHEMA), folds, 1 + 2 * d, tasks)
    seen = own.sum(axis=0) - own if folds > 1 else own
    n = np.maximum(seen[:, :1], 1.0)
    means = seen[:, 1 : d + 1] / n
    spread = np.sqrt(np.maximum(seen[:, d + 1 :] / n - means * means, 0.0) * n / np.maximum(n - 1, 1.0))
    scale = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(means)), 1.0 / np.maximum(spread, 1e-300), 0.0)
    penalised = np.tile(np.r_[0.0, np.full(d, penalty * (2 if classes == 2 else 1))], classes)
    width = classes * (d + 1)

    def scaled(x: np.ndarray, f: int) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - shift - means[f]) * scale[f]])

    def measure(weights: list[np.ndarray | None]) -> np.ndarray:
        """For each fold that has weights: second derivatives, gradient and loss, summed over the rows that it sees."""
        shipped = sc.broadcast(weights)

        def task(batches):
            total = np.zeros((folds, width, width + 2))
            for pdf in batches:
                for _ids, x, y, fold in _unpacked(pdf):
                    for f, w in enumerate(shipped.value):
                        if w is None:
                            continue
                        some = fold != f if folds > 1 else slice(None)
                        z, target = scaled(x[some], f), y[some]
                        share, logs = _shares(z, w)
                        wrong = share.copy()
                        wrong[np.arange(len(z)), target] -= 1.0
                        total[f, :, width] += (wrong.T @ z).reshape(-1)
                        total[f, 0, width + 1] -= logs[np.arange(len(z)), target].sum()
                        for a in range(classes):
                            for b in range(classes):
                                bend = share[:, a] * ((a == b) - share[:, b])
                                total[f, a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] += (z * bend[:, None]).T @ z
            yield from matrix_parts(total.reshape(folds * width, width + 2))

        found = summed_rows(packed.mapInPandas(task, PART_SCHEMA), folds * width, width + 2, tasks).reshape(folds, width, width + 2)
        shipped.destroy()
        return found / n[:, :, None]

    best = [np.zeros((classes, d + 1)) for _ in range(folds)]
    loss, step, live = [np.inf] * folds, [np.zeros(width) for _ in range(folds)], list(range(folds))
    for _ in range(MAX_STEPS):
        tried = [best[f] + step[f].reshape(classes, d + 1) if f in live else None for f in range(folds)]
        found = measure(tried)
        still = []
        for f in live:
            flat = tried[f].reshape(-1)
            now = float(found[f, 0, width + 1] + 0.5 * (penalised * flat * flat).sum())
            if now > loss[f]:  # too far
                step[f] = step[f] / 2
                if np.abs(step[f]).max() > 1e-12:
                    still.append(f)
                continue
            best[f], loss[f] = tried[f], now
            gradient = found[f, :, width] + penalised * flat
            # a shift of all intercepts changes nothing, so the shortest step is taken
            step[f] = -np.linalg.lstsq(found[f, :, :width] + np.diag(penalised), gradient, rcond=1e-12)[0]
            if -float(gradient @ step[f]) > TOLERANCE:
                still.append(f)
        live = still
        if not live:
            break

    def predict(batches):
        for pdf in batches:
            for ids, x, y, fold in _unpacked(pdf):
                pred = np.zeros(len(ids))
                for f in np.unique(fold):
                    some = fold == f
                    pred[some] = (scaled(x[some], f) @ best[f].T).argmax(axis=1)
                yield pd.DataFrame({"id": ids, "y": y.astype(float), "pred": pred})

    return packed.mapInPandas(predict, f"id {kind}, y double, pred double")
