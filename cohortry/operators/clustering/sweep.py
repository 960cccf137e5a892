"""Many K-means fits in one set of passes: every k, start and subsample of a search together.

A search needs hundreds of small models of the same rows.  Fitting them one
after another reads the rows hundreds of times; here each pass ships all the
unfinished centres and sums the updates of all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.partials import BLOB_ROWS, PART_SCHEMA, kept_blocks, matrix_parts, spread_blocks, summed_blocks, summed_rows
from cohortry.functions.quantiles import exact_quantiles
from cohortry.functions.vectors import lifted, matrix_of, nearest, squared_distances

FEW_CENTRES = 32  # up to so many, rows are summed by a product with a 0-1 matrix
START_ROUNDS, LEAST_DRAWN = 4, 200  # rounds of drawing rows for starts, and rows drawn in each, twice the largest k at least


@dataclass(frozen=True)
class Fit:
    """One model: cluster count, seed of its start, and the subsample it sees (None = all rows)."""

    k: int
    seed: int
    mask: int | None = None


def with_masks(vectors: DataFrame, n: int, share: float, repeats: int, seed: int) -> DataFrame:
    """Add ``masks``: per repeat, whether the row belongs to that subsample of max(5, share x n) rows."""
    size = min(max(5, int(n * share)), n - 1)
    if not repeats:
        return vectors.withColumn("masks", F.array().cast("array<boolean>"))
    marks = {f"m{i}": F.xxhash64("id", F.lit(seed + i)).cast("double") for i in range(repeats)}
    # a cut between two order statistics selects exactly ``size`` rows
    cuts = exact_quantiles(vectors.select(*[m.alias(c) for c, m in marks.items()]), {c: [(size - 0.5) / (n - 1)] for c in marks})
    return vectors.withColumn("masks", F.array(*[m <= F.lit(cuts[c][0]) for c, m in marks.items()]))


def _packed(rows: DataFrame, unit: bool) -> DataFrame:
    """Rows packed into float blocks, so that passes do no per-row conversion."""
    kind = dict(rows.dtypes)["id"]

    def pack(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOB_ROWS):
                part = pdf.iloc[at : at + BLOB_ROWS]
                x = matrix_of(part)
                if unit:
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    x = x / np.where(norm == 0, 1.0, norm)
                masks = np.array([list(m) for m in part["masks"]], dtype=bool).reshape(len(part), -1)
                marks = part["_mark"].to_numpy(np.int64)
                yield pd.DataFrame({"ids": [part["id"].tolist()], "n": [len(part)], "x": [x.tobytes()], "masks": [masks.tobytes()], "marks": [marks.tobytes()]})

    marked = rows.select("id", "features", "masks", F.xxhash64("id").alias("_mark"))
    return marked.mapInPandas(pack, f"ids array<{kind}>, n int, x binary, masks binary, marks binary")


def uniform(marks: np.ndarray, number: int) -> np.ndarray:
    """A number in (0, 1) for each row and draw, from the row's hash alone."""
    z = marks.view(np.uint64) + np.uint64((number * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def starting_pool(packed: DataFrame, d: int, masks: list[int | None], k: int, seed: int) -> dict[int | None, tuple[np.ndarray, np.ndarray]]:
    """For each subsample (None: all rows), weighted rows from which starts are chosen: (points, rows that each is nearest to).

    Parallel k-means++ over all rows: in each round rows are drawn without replacement in proportion to their squared distance
    from those drawn before (smallest exponential keys), so that a small far cluster is met wherever its rows lie. All subsamples
    share the passes, and the draw depends on the rows' ids alone.
    """
    sc, drawn = packed.sparkSession.sparkContext, max(LEAST_DRAWN, 2 * k)
    pool: dict[int | None, np.ndarray] = {m: np.zeros((0, d)) for m in masks}

    def seen_by(mask, m, n):
        return slice(None) if mask is None else np.frombuffer(m, dtype=bool).reshape(n, -1)[:, mask]

    for number in range(START_ROUNDS + 1):
        shipped = sc.broadcast(pool)
        wanted = drawn if number else 1

        def draw(batches, shipped=shipped, number=number, wanted=wanted):
            held: dict = {m: (np.zeros(0), np.zeros((0, d))) for m in masks}
            for pdf in batches:
                for n, x, m, h in zip(pdf["n"], pdf["x"], pdf["masks"], pdf["marks"]):
                    rows, marks = np.frombuffer(x, dtype=float).reshape(n, d), np.frombuffer(h, np.int64)
                    noise = -np.log(uniform(marks, seed * 64 + number))
                    for mask in masks:
                        some = seen_by(mask, m, n)
                        part, known = rows[some], shipped.value[mask]
                        far = nearest(part, known)[1] if len(known) else np.ones(len(part))
                        with np.errstate(divide="ignore"):
                            keys = np.where(far > 0, noise[some] / far, np.inf)
                        keys, points = np.append(held[mask][0], keys), np.vstack([held[mask][1], part])
                        best = np.argsort(keys, kind="stable")[:wanted]
                        held[mask] = keys[best], points[best]
            for at, mask in enumerate(masks):
                keys, points = held[mask]
                fine = np.isfinite(keys)
                if fine.any():
                    yield pd.DataFrame({"at": at, "key": keys[fine], "x": [v.tobytes() for v in points[fine]]})

        found = packed.mapInPandas(draw, "at int, key double, x binary")
        first = Window.partitionBy("at").orderBy("key", "x")
        for r in found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= wanted).collect():  # wanted for each subsample
            pool[masks[r["at"]]] = np.vstack([pool[masks[r["at"]]], np.frombuffer(r["x"], dtype=float)])
        shipped.destroy()
    # in one order, whatever the collected rows came in
    pool = {m: v[np.lexsort(v.T[::-1])] for m, v in pool.items()}
    shipped = sc.broadcast(pool)
    edges = np.cumsum([0] + [len(pool[m]) for m in masks])

    def weigh(batches):
        total = np.zeros((int(edges[-1]), 1))
        for pdf in batches:
            for n, x, m in zip(pdf["n"], pdf["x"], pdf["masks"]):
                rows = np.frombuffer(x, dtype=float).reshape(n, d)
                for j, mask in enumerate(masks):
                    part = rows[seen_by(mask, m, n)]
                    if len(part):
                        total[edges[j] : edges[j + 1], 0] += np.bincount(nearest(part, shipped.value[mask])[0], minlength=len(shipped.value[mask]))
        yield from matrix_parts(total)

    weights = summed_rows(packed.mapInPandas(weigh, PART_SCHEMA), int(edges[-1]), 1)[:, 0]
    shipped.destroy()
    return {m: (pool[m], weights[edges[j] : edges[j + 1]]) for j, m in enumerate(masks)}


def _spread_start(x: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Greedy start on weighted points, in proportion to weight and squared distance."""
    rng = np.random.default_rng(seed)
    tries = 2 + int(np.log(k))

    def pick(mass: np.ndarray, size: int) -> np.ndarray:
        total = mass.sum()
        return rng.integers(len(x), size=size) if total <= 0 else np.searchsorted(np.cumsum(mass), rng.random(size) * total).clip(max=len(x) - 1)

    chosen = [int(pick(weights, 1)[0])]
    near = squared_distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        picks = pick(near * weights, tries)
        options = np.minimum(near[:, None], squared_distances(x, x[picks]))
        best = int((options * weights[:, None]).sum(axis=0).argmin())
        chosen.append(int(picks[best]))
        near = options[:, best]
    return x[chosen].copy()


@dataclass
class Sweep:
    fits: list[Fit]
    centres: list[np.ndarray]
    inertia: np.ndarray
    counts: list[np.ndarray]  # rows of each cluster, and their means
    means: list[np.ndarray]
    packed: DataFrame
    id_type: str

    def best(self, k: int, mask: int | None = None) -> int:
        """Index of the cheapest start of one k on one subsample."""
        same = [i for i, f in enumerate(self.fits) if f.k == k and f.mask == mask]
        return min(same, key=lambda i: self.inertia[i])

    def labels(self, chosen: list[int]) -> DataFrame:
        """``id, masks, labels``: the label of each chosen model, in order."""
        centres = [self.centres[i] for i in chosen]

        def assign(batches):
            for pdf in batches:
                for ids, n, x, m in zip(pdf["ids"], pdf["n"], pdf["x"], pdf["masks"]):
                    rows = np.frombuffer(x, dtype=float).reshape(n, -1)
                    masks = np.frombuffer(m, dtype=bool).reshape(n, -1)
                    marks = np.stack([nearest(rows, c)[0] for c in centres], axis=1)
                    yield pd.DataFrame({"id": ids, "masks": [list(map(bool, v)) for v in masks], "labels": [v.tolist() for v in marks]})

        return self.packed.mapInPandas(assign, f"id {self.id_type}, masks array<boolean>, labels array<int>")


def _seen(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block as every fit needs them: (x, 1), the same column by column, and x.x."""
    tall = np.hstack([rows, np.ones((len(rows), 1))])
    return tall, np.ascontiguousarray(tall.T), np.square(rows).sum(axis=1)


def _add_nearest(out: np.ndarray, seen: tuple[np.ndarray, np.ndarray, np.ndarray], centres: np.ndarray) -> None:
    """Add each row, 1 and its squared distance to the line of its nearest centre, of equally near ones the first."""
    tall, wide, squares = seen
    k, d = centres.shape
    if k > FEW_CENTRES:
        rows = tall[:, :d]
        marks, far = nearest(rows, centres)
        out[:, :d] += np.bincount((marks[:, None] * d + np.arange(d)).ravel(), rows.ravel(), k * d).reshape(k, d)
        out[:, d] += np.bincount(marks, minlength=k)
        out[:, d + 1] += np.bincount(marks, far, k)
        return
    away = lifted(centres) @ wide
    least = away.min(axis=0)
    hot = (away == least).astype(float)
    if hot.sum() != len(tall):  # ties, or a value that is not a number
        hot = np.zeros(away.shape)
        hot[away.argmin(axis=0), np.arange(len(tall))] = 1.0
    out[:, : d + 1] += hot @ tall
    out[:, d + 1] += hot @ np.maximum(least + squares, 0.0)


def sweep(vectors: DataFrame, fits: list[Fit], unit: bool = False, max_iter: int = 300, tolerance: float = 1e-4) -> Sweep:
    """Lloyd iterations for all fits at once; a fit leaves when its centres stop moving.

    ``vectors`` carries id, features and masks.  With ``unit`` rows and centres
    are kept at unit length (cosine).
    """
    sc = vectors.sparkSession.sparkContext
    packed, _n = spread_blocks(_packed(vectors, unit))
    one = packed.select("n", F.length("x").alias("bytes")).first()
    if one is None:
        raise ValueError("no rows to cluster")
    d = one["bytes"] // (8 * one["n"])
    seen = list(dict.fromkeys(f.mask for f in fits))
    pool = starting_pool(packed, d, seen, max(f.k for f in fits), min(f.seed for f in fits))
    centres = [_spread_start(*pool[f.mask], f.k, f.seed) for f in fits]
    blocks = kept_blocks(packed, "n", "x", "masks")
    x0, weight = pool[seen[0]]
    mean = np.average(x0, axis=0, weights=weight)
    moved = tolerance * float(np.average(np.square(x0 - mean), axis=0, weights=weight).mean())

    def run(live: list[int]) -> list[np.ndarray]:
        """Per live fit, k rows of (sum vector, count, inertia)."""
        shipped = sc.broadcast([centres[i] for i in live])
        seen_by = [fits[i].mask for i in live]
        edges = np.cumsum([0] + [len(centres[i]) for i in live])

        def add(total, block):
            rows = np.frombuffer(block["x"], dtype=float).reshape(block["n"], d)
            masks = np.frombuffer(block["masks"], dtype=bool).reshape(len(rows), -1)
            seen = {m: _seen(rows if m is None else rows[masks[:, m]]) for m in set(seen_by)}
            for j, (mask, c) in enumerate(zip(seen_by, shipped.value)):
                _add_nearest(total[edges[j] : edges[j + 1]], seen[mask], c)

        sums = summed_blocks(blocks, add, int(edges[-1]), d + 2)
        shipped.destroy()
        return [sums[edges[j] : edges[j + 1]] for j in range(len(live))]

    live = list(range(len(fits)))
    for _ in range(max_iter):
        still = []
        for i, s in zip(live, run(live)):
            fresh = np.where(s[:, d : d + 1] > 0, s[:, :d] / np.maximum(s[:, d : d + 1], 1e-300), centres[i])
            if unit:
                norm = np.linalg.norm(fresh, axis=1, keepdims=True)
                fresh = fresh / np.where(norm == 0, 1.0, norm)
            if float(np.square(fresh - centres[i]).sum()) > moved:
                still.append(i)
            centres[i] = fresh
        live = still
        if not live:
            break
    last = run(list(range(len(fits))))
    blocks.unpersist()
    means = [np.where(s[:, d : d + 1] > 0, s[:, :d] / np.maximum(s[:, d : d + 1], 1e-300), c) for s, c in zip(last, centres)]
    return Sweep(fits, centres, np.array([s[:, d + 1].sum() for s in last]), [s[:, d] for s in last], means, packed, dict(vectors.dtypes)["id"])
