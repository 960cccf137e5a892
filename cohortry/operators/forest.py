"""Random forests of all folds at once, from class counts of binned columns.

Columns are binned once. Then all trees of all folds grow together, level by level: a pass counts the classes of every (node, drawn
column, bin) over blocks of rows, and tasks find the splits, so that the number of passes follows from the depth and from the nodes
that are still impure. How often a row is in a tree's bag, and which columns a node may use, follow from the row's id, the tree and
the seed alone: the result does not depend on how the rows are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.partials import blocks_of
from cohortry.operators.boosting import bin_edges
from cohortry.operators.clustering.sweep import uniform
from cohortry.session import cut_lineage

BINS = 32
BLOCK_ROWS, LEAST_ROWS = 32_768, 512  # rows of a block, and of a task that is worth its start
#: Bytes of counts that a task holds in a pass; a level with more of them takes several passes.
PASS_BYTES = 128 << 20
#: Counts of so many bytes are searched for splits together.
CHUNK_BYTES = 4 << 20
#: Counts of all tasks up to so many bytes come to the driver as they are.
DIRECT_BYTES = 32 << 20
#: Up to how many times a row is in a bag, drawn from Poisson's law of mean 1.
IN_BAG = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))


@dataclass
class Trees:
    """Nodes of all trees, the root of model m being node m: the column and the bin up to which rows go left, the left child (the right
    one follows it; a leaf is its own), and the rows in the bag of each class."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    def shape_only(self) -> Trees:
        return Trees(self.column, self.cut, self.left, self.counts[:0])

    def walk(self, x: np.ndarray, base: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        """Where rows end that begin at nodes ``at``; ``base`` is the place of each row in the flat ``x``."""
        for _ in range(steps):
            at = self.left.take(at) + (x.take(base + self.column.take(at)) > self.cut.take(at))
        return at


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    kind = dict(rows.dtypes)["id"]

    def pack(batches):
        held, n = [], 0
        for pdf in batches:
            x = np.vstack(pdf["x"].to_numpy()).astype(float)
            binned = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            held.append((pdf["id"].tolist(), binned, pdf["y"].to_numpy(np.int64), pdf["fold"].to_numpy(np.int64), pdf["mark"].to_numpy(np.int64)))
            n += len(x)
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    def block(held):
        ids, *arrays = zip(*held)
        return pd.DataFrame({"ids": [[i for some in ids for i in some]], **{c: [np.concatenate(v).tobytes()] for c, v in zip(("x", "y", "fold", "marks"), arrays)}})

    return rows.mapInPandas(pack, f"ids array<{kind}>, x binary, y binary, fold binary, marks binary")


def _arrays(row) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row["x"], np.uint8), *(np.frombuffer(row[c], np.int64) for c in ("y", "fold", "marks"))


def _add_counts(total: np.ndarray, block, trees: Trees, slot: np.ndarray, drawn: np.ndarray, models: np.ndarray, level: int, folds: int, bins: int, seed: int) -> None:
    """Add one block's rows in the bags of ``models`` to ``total``, whose cells are (slot, drawn column, bin, class)."""
    x, y, fold, marks = block
    d, (slots, s), classes = len(x) // max(1, len(y)), drawn.shape, trees.counts.shape[1]
    width, flat = s * bins * classes, total.reshape(-1)
    tree = None
    for m in models.tolist():
        if m // folds != tree:
            tree = m // folds
            times = np.searchsorted(IN_BAG, uniform(marks, seed * 65_536 + tree))
            bagged = np.flatnonzero(times)
            home = fold[bagged]
        rows = bagged[home != m % folds]
        at = slot.take(trees.walk(x, rows * d, np.full(len(rows), m), level))
        some = np.flatnonzero((at >= 0) & (at < slots))
        if not len(some):
            continue
        at, rows = at[some].astype(np.int64), rows[some]
        codes = ((at * s)[:, None] + np.arange(s)) * bins + x.take((rows * d)[:, None] + drawn[at])
        codes = (codes * classes + y[rows][:, None]).reshape(-1)
        weights = np.repeat(times[rows], s)
        first, last = int(at.min()) * width, (int(at.max()) + 1) * width
        if last - first > 4 * len(codes):
            np.add.at(flat, codes, weights.astype(flat.dtype))
        else:
            flat[first:last] += np.bincount(codes - first, weights, last - first).astype(flat.dtype)


def _best(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each node (counts: node x drawn column x bin x class) the fall of Gini impurity times rows, place of the column, bin, and
    counts of the left side and of all."""
    left = np.cumsum(counts.astype(np.int64), axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left

    def purity(c):
        return np.square(c.astype(float)).sum(axis=-1) / np.maximum(c.sum(axis=-1), 1)

    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), purity(left) + purity(right) - purity(whole), -np.inf).reshape(len(counts), -1)
    top = gain.argmax(axis=1)
    nodes, (c, b) = np.arange(len(counts)), np.divmod(top, counts.shape[2])
    return gain[nodes, top], c, b, left[nodes, c, b], whole[:, 0, 0]


def fit(rows: DataFrame, classes: int, folds: int, trees: int = 200, depth: int = 10, seed: int = 42, bins: int = BINS) -> tuple[DataFrame, Trees, np.ndarray]:
    """Packed blocks, the trees (model = tree x folds + fold) and each model's fall of impurity by column.

    ``rows`` has id, x (array), y (0..classes-1) and fold; a fold's trees do not see its rows, and fold -1 is seen by all. A node
    chooses among ceil(sqrt(columns)) columns drawn for it.
    """
    sc = rows.sparkSession.sparkContext
    first = rows.select("x").first()
    d = len(first["x"]) if first else 0
    edges = bin_edges(rows, d, bins)
    cores, n = sc.defaultParallelism, rows.count()
    marked = rows.withColumn("mark", F.xxhash64("id"))
    few = min(cores, -(-n // LEAST_ROWS))  # small inputs arrive in few partitions
    packed = _blocks(marked.repartition(max(1, few), "mark") if n < cores * BLOCK_ROWS else marked, edges).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = blocks_of(packed, "x", "y", "fold", "marks")
    models, s = trees * folds, int(np.ceil(np.sqrt(d)))
    bins = 1 + max(map(len, edges), default=0)
    grown = Trees(np.zeros(models, np.uint16), np.full(models, bins, np.uint8), np.arange(models, dtype=np.int32), np.zeros((models, classes), np.int64))
    falls = np.zeros((models, d))
    alive = of = np.arange(models)  # nodes that may be split, and their models
    for level in range(depth):
        if not len(alive) or not d:
            break
        sizes = np.bincount(of, minlength=models)
        drawn = np.concatenate([np.sort(np.random.default_rng([seed, level, m]).random((sizes[m], d)).argsort(axis=1)[:, :s], axis=1) for m in np.flatnonzero(sizes)])
        per_pass = max(1, PASS_BYTES // (s * bins * classes * 4))
        gain, place, cut, left, whole = (
            np.concatenate(v)
            for v in zip(*(_pass(blocks, sc, grown, alive[a : a + per_pass], of[a : a + per_pass], drawn[a : a + per_pass], level, folds, bins, seed) for a in range(0, len(alive), per_pass)))
        )
        if not level:
            grown.counts[:] = whole
        split = gain > 1e-9 * np.maximum(1, whole.sum(axis=1))
        nodes, n = alive[split], int(split.sum())
        column, below = drawn[np.arange(len(alive)), place][split], len(grown.left) + 2 * np.arange(n)
        np.add.at(falls, (of[split], column), gain[split])
        grown.column[nodes], grown.cut[nodes], grown.left[nodes] = column, cut[split], below
        fresh = np.stack([left[split], (whole - left)[split]], axis=1).reshape(2 * n, classes)
        new = len(grown.left) + np.arange(2 * n, dtype=np.int32)
        grown = Trees(
            np.concatenate([grown.column, np.zeros(2 * n, np.uint16)]), np.concatenate([grown.cut, np.full(2 * n, bins, np.uint8)]),
            np.concatenate([grown.left, new]), np.concatenate([grown.counts, fresh]),
        )
        impure = (fresh > 0).sum(axis=1) > 1
        alive, of = new[impure], np.repeat(of[split], 2)[impure]
    return packed, grown, falls


def _pass(blocks: RDD, sc, grown: Trees, alive: np.ndarray, of: np.ndarray, drawn: np.ndarray, level: int, folds: int, bins: int, seed: int) -> tuple[np.ndarray, ...]:
    """The best split of each node in ``alive``, from one pass over the rows."""
    slot = np.full(len(grown.left), -1, np.int32)
    slot[alive] = np.arange(len(alive))
    shipped = sc.broadcast((grown.shape_only(), slot, drawn, np.unique(of)))
    shape = (len(alive), drawn.shape[1], bins, grown.counts.shape[1])
    size = int(np.prod(shape[1:])) * 4
    step = max(1, CHUNK_BYTES // size)

    def counted(part):
        trees, slot, drawn, models = shipped.value
        total = np.zeros(shape, np.int32 if level else np.int64)
        for row in part:
            _add_counts(total, _arrays(row), trees, slot, drawn, models, level, folds, bins, seed)
        for a in range(0, len(total), step):
            yield a, total[a : a + step]

    tasks = blocks.getNumPartitions()
    chunks = blocks.mapPartitions(counted)
    if tasks * len(alive) * size <= DIRECT_BYTES:
        total = np.zeros(shape, np.int64)
        for a, some in chunks.collect():
            total[a : a + step] += some
        found = [_best(total[a : a + step]) for a in range(0, len(total), step)]
    else:
        found = [v for _a, v in sorted(chunks.reduceByKey(np.add, tasks).mapValues(_best).collect(), key=lambda r: r[0])]  # a few numbers a node
    shipped.destroy()
    return tuple(np.concatenate(v) for v in zip(*found))


def out_of_fold(placed: DataFrame, classes: int, folds: int, trees: int = 200, depth: int = 10, seed: int = 42) -> DataFrame:
    """``id, y, pred`` of rows (id, y, features, fold): the class with the largest sum of leaf shares over the trees that never saw the row."""
    rows = placed.select("id", vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    packed, grown, _ = fit(rows, classes, folds, trees, depth, seed)
    shares = grown.counts / np.maximum(grown.counts.sum(axis=1, keepdims=True), 1)
    ends = grown.left == np.arange(len(grown.left))
    leaf = np.cumsum(ends) - 1
    shipped = placed.sparkSession.sparkContext.broadcast((grown.shape_only(), leaf, shares[ends]))

    def predict(batches):
        walked, leaf, shares = shipped.value
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x, y, fold, _marks = _arrays(row)
                d, votes = len(x) // max(1, len(y)), np.zeros((len(y), classes))
                for f in np.unique(fold):
                    own = np.flatnonzero(fold == f)
                    for t in range(trees):
                        votes[own] += shares[leaf[walked.walk(x, own * d, np.full(len(own), t * folds + f), depth)]]
                yield pd.DataFrame({"id": row["ids"], "y": y.astype(float), "pred": votes.argmax(axis=1).astype(float)})

    done = cut_lineage(packed.mapInPandas(predict, f"id {dict(placed.dtypes)['id']}, y double, pred double"))
    packed.unpersist()
    shipped.destroy()
    return done


def importances(prepared: DataFrame, classes: int, trees: int = 200, depth: int = 10, seed: int = 42) -> np.ndarray:
    """Each column's share in the fall of impurity, tree by tree, then over all trees."""
    rows = prepared.select("id", vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), F.lit(-1).alias("fold"))
    packed, _, falls = fit(rows, classes, 1, trees, depth, seed)
    packed.unpersist()
    shares = (falls / np.maximum(falls.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
    return shares / max(shares.sum(), 1e-300)
