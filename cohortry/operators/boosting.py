"""Boosted trees for several classes and folds at once, from histograms of second-order sums.

Columns are binned once. Then all folds and all classes grow their trees together: a level is one job that sums gradients,
second derivatives and rows of every (fold, class, node, column, bin) over blocks of rows, and the number of jobs depends on trees
and depth alone. A row carries one margin per fold and class; it is left out of the sums of its own fold, whose margins become its
out-of-fold prediction.

As long as the rows of a fold fit one task (``FOLD_BYTES``), each fold is grown by a task of its own, as folds share nothing but the
bins: one job instead of one for each level, with the same sums.

Blocks are rows of an RDD and not of a DataFrame, as a fit is some thousand short jobs with another function each, for which
planning a query would cost more than the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.session import MAX_COLUMNS, BoundExceeded, ensure_checkpoint_dir

BINS = 256
BLOCK_ROWS = 4_096
#: Trees after which the margins are written and lineage starts anew.
WRITTEN_EVERY = 25
#: Bytes of sums that come to the driver from all tasks of one level; more of them are summed by tasks, column by column.
DIRECT_BYTES = 32 << 20
#: Bytes of rows, margins and sums up to which a task grows all trees of a fold.
FOLD_BYTES = 192 << 20


@dataclass(frozen=True)
class Boosting:
    """How trees grow; the defaults are those of extreme gradient boosting."""

    trees: int = 200
    depth: int = 6
    rate: float = 0.3
    ridge: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1


@dataclass
class Forest:
    """Complete binary trees of one round: for each (fold, class) and node the column (-1: leaf), the bin up to which rows go left, and the value."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(models: int, depth: int) -> Forest:
        nodes = (1 << depth + 1) - 1
        return Forest(np.full((models, nodes), -1), np.zeros((models, nodes), int), np.zeros((models, nodes)))

    def places(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has reached in each model after some levels."""
        models = len(self.column)
        at, rows, base = np.zeros((len(x), models), int), np.arange(len(x))[:, None], np.arange(models) * self.column.shape[1]
        column, cut = self.column.reshape(-1), self.bin.reshape(-1)
        for _ in range(levels):
            here = base + at
            c = column[here]
            at = np.where(c < 0, at, 2 * at + 1 + (x[rows, np.maximum(c, 0)] > cut[here]))
        return at


@dataclass
class Fitted:
    rounds: list[Forest] = field(default_factory=list)
    gains: np.ndarray | None = None  # of each column, summed over all splits


def bin_edges(rows: DataFrame, n_columns: int, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each column from a quantile sketch, one pass for all columns."""
    if n_columns > MAX_COLUMNS:
        raise BoundExceeded(f"{n_columns} columns")
    wide = rows.select(*[F.col("x")[i].alias(f"c{i}") for i in range(n_columns)])
    found = wide.approxQuantile([f"c{i}" for i in range(n_columns)], [i / bins for i in range(1, bins)], 1.0 / (4 * bins))
    return [np.unique(np.array(c, dtype=float)) for c in found]


def _blocks(rows: DataFrame, edges: list[np.ndarray], models: int) -> RDD:
    """(ids, bins, classes, folds, margins) of up to BLOCK_ROWS rows."""

    def pack(part):
        held = []
        for r in part:
            held.append(r)
            if len(held) == BLOCK_ROWS:
                yield block(held)
                held = []
        if held:
            yield block(held)

    def block(held):
        x = np.array([r["x"] for r in held], dtype=float)
        binned = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint16)
        return [r["id"] for r in held], binned, np.array([r["y"] for r in held], int), np.array([r["fold"] for r in held], int), np.zeros((len(held), models))

    return rows.rdd.mapPartitions(pack)


def _sums(block, forest: Forest, level: int, classes: int, bins: int):
    """Codes of (model, node of the level, column, bin) and gradient, second derivative and rows of each, for one block."""
    _ids, x, y, fold, margins = block
    n, models = margins.shape
    scores = margins.reshape(n, models // classes, classes)
    share = np.exp(scores - scores.max(axis=2, keepdims=True))
    share /= share.sum(axis=2, keepdims=True)
    target = np.zeros((n, 1, classes))
    target[np.arange(n), 0, y] = 1.0
    seen = (np.arange(models // classes) != fold[:, None])[:, :, None]
    g = ((share - target) * seen).reshape(n, models)
    h = (np.maximum(2.0 * share * (1.0 - share), 1e-16) * seen).reshape(n, models)
    at, first = forest.places(x, level), (1 << level) - 1
    alive = (at >= first) & np.broadcast_to(seen, (n, models // classes, classes)).reshape(n, models)
    i, m = np.nonzero(alive)
    node = (m << level) + at[i, m] - first
    codes = (node[:, None] * x.shape[1] + np.arange(x.shape[1])) * bins + x[i]
    return codes.reshape(-1), np.repeat(g[i, m], x.shape[1]), np.repeat(h[i, m], x.shape[1])


def _best(sums: np.ndarray, how: Boosting) -> tuple[np.ndarray, ...]:
    """For each node the best split of some columns: gain, column, bin, and (gradient, second derivative) of left, right and all.

    ``sums`` is node x column x bin x (gradient, second derivative, rows).
    """
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left

    def score(s):
        return np.square(s[..., 0]) / np.maximum(s[..., 1] + how.ridge, 1e-12)

    gain = score(left) + score(right) - score(whole)
    ok = (left[..., 1] >= how.least_hessian) & (right[..., 1] >= how.least_hessian) & (left[..., 2] >= how.least_rows) & (right[..., 2] >= how.least_rows)
    gain = np.where(ok, gain, -np.inf).reshape(len(sums), -1)
    top = gain.argmax(axis=1)
    rows, (c, b) = np.arange(len(sums)), np.divmod(top, sums.shape[2])
    return gain[rows, top], c, b, left[rows, c, b, :2], right[rows, c, b, :2], whole[rows, 0, 0, :2]


def fit(rows: DataFrame, classes: int, folds: int, how: Boosting = Boosting(), bins: int = BINS) -> tuple[RDD, Fitted]:
    """Blocks with their final margins, and the trees. ``rows`` has id, x (array), y (0..classes-1) and fold.

    With fold -1 a row is seen by all folds.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    sc, d = rows.sparkSession.sparkContext, len(rows.select("x").first()["x"])
    edges = bin_edges(rows, d, bins)
    bins = max(2, 1 + max(map(len, edges)))
    models = folds * classes
    state = _blocks(rows, edges, models).persist(StorageLevel.MEMORY_AND_DISK)
    n, tasks = state.map(lambda b: len(b[0])).sum(), state.getNumPartitions()
    done, old = Fitted(gains=np.zeros(d)), None
    if n * (4 * d + 40 * classes) + (32 * classes << how.depth) * d * bins <= FOLD_BYTES:
        return _by_fold(state, done, classes, folds, d, bins, how)
    for number in range(how.trees):
        forest = _tree(models, how, done.gains, lambda forest, level: _level(state, forest, level, classes, d, bins, how, n, tasks))
        done.rounds.append(forest)
        grown = state.map(_grown(forest, how.depth)).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % WRITTEN_EVERY == 0 or number + 1 == how.trees:
            grown.checkpoint()
            grown.count()
        if old is not None:
            old.unpersist()
        old, state = state, grown
    return state, done


def _tree(models: int, how: Boosting, gains: np.ndarray, best_of: Callable) -> Forest:
    """One round's trees, level by level; ``best_of(forest, level)`` gives the best split of every node."""
    forest = Forest.empty(models, how.depth)
    for level in range(how.depth):
        gain, column, cut, left, right, whole = (v.reshape(models, 1 << level, *v.shape[1:]) for v in best_of(forest, level))
        first = (1 << level) - 1
        here = slice(first, 2 * first + 1)
        alive = whole[..., 1] > 0
        split = (gain > 1e-6) & alive
        forest.column[:, here], forest.bin[:, here] = np.where(split, column, -1), cut
        values = [-how.rate * s[..., 0] / np.maximum(s[..., 1] + how.ridge, 1e-12) for s in (left, right, whole)]
        if not level:
            forest.value[:, here] = np.where(alive, values[2], 0.0)
        below = slice(2 * first + 1, 4 * first + 3)
        forest.value[:, below] = np.where(np.repeat(split, 2, axis=1), np.stack(values[:2], axis=2).reshape(models, -1), 0.0)
        np.add.at(gains, column[split], gain[split])
        if not split.any():
            break
    return forest


def _fold_trees(x: np.ndarray, y: np.ndarray, classes: int, bins: int, how: Boosting) -> tuple[list[Forest], np.ndarray]:
    """All rounds of one fold, whose rows ``x`` (column by row) the task holds, and the gains of the columns."""
    (d, n), every = x.shape, np.arange(x.shape[1])
    margins, gains, rounds = np.zeros((n, classes)), np.zeros(d), []
    for _ in range(how.trees):
        share = np.exp(margins - margins.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        target = np.zeros((n, classes))
        target[every, y] = 1.0
        g, h = np.ascontiguousarray((share - target).T), np.ascontiguousarray(np.maximum(2.0 * share * (1.0 - share), 1e-16).T)
        at = np.zeros((classes, n), np.int64)

        def step(forest, m, at=at):
            """Rows of a class go down one level."""
            c = forest.column[m][at[m]]
            at[m] = np.where(c < 0, at[m], 2 * at[m] + 1 + (x[np.maximum(c, 0), every] > forest.bin[m][at[m]]))

        def best_of(forest, level, at=at, g=g, h=h):
            nodes, first = 1 << level, (1 << level) - 1
            total = np.zeros((classes, nodes, d, bins, 3))
            for m in range(classes):
                if level:
                    step(forest, m)
                some = np.flatnonzero(at[m] >= first)
                base, gm, hm = (at[m][some] - first) * bins, g[m][some], h[m][some]
                for c in range(d):
                    codes = base + x[c][some]
                    for i, weights in enumerate((gm, hm, None)):
                        total[m, :, c, :, i] = np.bincount(codes, weights, nodes * bins).reshape(nodes, bins)
            return _best(total.reshape(-1, d, bins, 3), how)

        forest = _tree(classes, how, gains, best_of)
        margins = margins + forest.value[np.arange(classes), forest.places(x.T, how.depth)]
        rounds.append(forest)
    return rounds, gains


def _by_fold(state: RDD, done: Fitted, classes: int, folds: int, d: int, bins: int, how: Boosting) -> tuple[RDD, Fitted]:
    """A task for each fold grows its trees over the rows that the fold sees; then all margins follow in one pass."""

    def deal(number, part):
        for place, (_ids, x, y, fold, _margins) in enumerate(part):
            for f in range(folds):
                seen = fold != f
                yield f, (number, place, x[seen], y[seen])

    def grow(part):
        blocks = sorted((b for _, b in part), key=lambda b: b[:2])  # one order, whatever they arrive in
        if blocks:
            x = np.ascontiguousarray(np.concatenate([b[2] for b in blocks]).T).astype(np.int32)
            yield _fold_trees(x, np.concatenate([b[3] for b in blocks]), classes, bins, how)

    def numbered(f, part):
        for rounds, gains in grow(part):
            yield f, rounds, gains

    found = sorted(state.mapPartitionsWithIndex(deal).partitionBy(folds, int).mapPartitionsWithIndex(numbered).collect(), key=lambda r: r[0])
    for parts in zip(*(rounds for _, rounds, _ in found)):
        done.rounds.append(Forest(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("column", "bin", "value"))))
    for _, _, gains in found:
        done.gains += gains
    shipped = state.context.broadcast(done.rounds)

    def add(block):
        ids, x, y, fold, margins = block
        own = np.arange(folds * classes)
        for forest in shipped.value:
            margins = margins + forest.value[own, forest.places(x, how.depth)]
        return ids, x, y, fold, margins

    grown = state.map(add).persist(StorageLevel.MEMORY_AND_DISK)
    grown.checkpoint()
    grown.count()
    state.unpersist()
    return grown, done


def _grown(forest: Forest, depth: int):
    def add(block):
        ids, x, y, fold, margins = block
        at = forest.places(x, depth)
        return ids, x, y, fold, margins + forest.value.reshape(-1)[np.arange(len(forest.value)) * forest.value.shape[1] + at]

    return add


def _level(state: RDD, forest: Forest, level: int, classes: int, d: int, bins: int, how: Boosting, n: int, tasks: int):
    models = len(forest.column)
    nodes = models << level
    cells = nodes * d * bins

    def summed(part):
        total = np.zeros((3, cells))
        for block in part:
            codes, g, h = _sums(block, forest, level, classes, bins)
            total[0] += np.bincount(codes, g, cells)
            total[1] += np.bincount(codes, h, cells)
            total[2] += np.bincount(codes, minlength=cells)
        return total

    def sparse(part):
        total = summed(part)
        hit = np.flatnonzero(total[2])
        yield hit, total[:, hit]

    if min(n * d * models, tasks * cells) * 32 <= DIRECT_BYTES:
        total = np.zeros((3, cells))
        for hit, values in state.mapPartitions(sparse).collect():
            total[:, hit] += values
        return _best(total.reshape(3, nodes, d, bins).transpose(1, 2, 3, 0), how)

    def by_column(part):
        total = summed(part).reshape(3, nodes, d, bins)
        for c in range(d):
            yield c, total[:, :, c]

    one = state.mapPartitions(by_column).reduceByKey(np.add, min(d, max(1, tasks))).mapValues(lambda s: _best(s.transpose(1, 2, 0)[:, None], how))
    best = None
    for c, (gain, _c, cut, left, right, whole) in sorted(one.collect(), key=lambda r: r[0]):  # a few numbers for each node and column
        if best is None:
            best = [gain, np.full(nodes, c), cut, left, right, whole]
            continue
        better = gain > best[0]
        best = [np.where(better if a.ndim == 1 else better[:, None], b, a) for a, b in zip(best, (gain, np.full(nodes, c), cut, left, right, whole))]
    return tuple(best)


def out_of_fold(placed: DataFrame, classes: int, how: Boosting = Boosting()) -> DataFrame:
    """``id, y, pred`` of rows (id, y, features, fold): each is predicted by the trees of its own fold, which never saw it."""
    rows = placed.select("id", vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    folds = (rows.agg(F.max("fold")).first()[0] or 0) + 1
    state, _ = fit(rows, classes, folds, how)

    def predicted(block):
        ids, _x, y, fold, margins = block
        own = margins.reshape(len(ids), folds, classes)[np.arange(len(ids)), fold]
        return zip(ids, y.astype(float).tolist(), own.argmax(axis=1).astype(float).tolist())

    return placed.sparkSession.createDataFrame(state.flatMap(predicted), f"id {dict(placed.dtypes)['id']}, y double, pred double")


def importances(prepared: DataFrame, classes: int, how: Boosting = Boosting()) -> np.ndarray:
    """Share of each column in the gain of all splits."""
    rows = prepared.select("id", vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), F.lit(-1).alias("fold"))
    _, done = fit(rows, classes, 1, how)
    return done.gains / max(done.gains.sum(), 1e-300)
