from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortry.operators import forest, validation
from cohortry.operators.clustering.sweep import uniform


def placed(spark, n=600, folds=3):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 25, size=(n, 4)) / 5.0
    y = (x[:, 0] > 2).astype(int) + (x[:, 1] > 3)
    rows = [(i, float(y[i]), x[i].tolist(), i % folds) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, x array<double>, fold int").withColumn("features", array_to_vector("x")), x, y


def test_counts_and_splits_are_those_of_the_bags(spark):
    df, x, y = placed(spark)
    folds, seed = 3, 42
    marks = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()])
    packed, grown, _ = forest.fit(df.select("id", "x", F.col("y").cast("int").alias("y"), "fold"), 3, folds, trees=2, depth=3, seed=seed)
    packed.unpersist()
    values = [np.unique(x[:, c]) for c in range(4)]
    assert all(len(v) < forest.BINS for v in values)
    for m in range(2 * folds):
        times = np.searchsorted(forest.IN_BAG, uniform(marks, seed * 65_536 + m // folds))
        times[np.arange(600) % folds == m % folds] = 0  # a fold's own rows are never seen
        assert grown.counts[m].tolist() == np.bincount(y, times, 3).astype(int).tolist()

        def purity(rows):
            c = np.bincount(y[rows], times[rows], 3)
            return (c * c).sum() / max(c.sum(), 1)

        c, below = int(grown.column[m]), int(grown.left[m])
        best = max(purity(x[:, c] <= v) + purity(x[:, c] > v) for v in values[c][:-1])
        parts = grown.counts[[below, below + 1]].astype(float)
        assert (np.square(parts).sum(axis=1) / parts.sum(axis=1)).sum() == pytest.approx(best)
        assert parts.sum(axis=0).tolist() == grown.counts[m].tolist()


def test_all_folds_share_passes_and_partitions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(validation, "build_estimator", lambda *a, **k: pytest.fail("one fold after another"))
    df, _x, _y = placed(spark)
    wide = df.select("id", F.col("y").cast("int").alias("label"), *[F.col("x")[i].alias(f"c{i}") for i in range(4)])
    names = [f"c{i}" for i in range(4)]
    seen = []
    for parts in (1, 7):
        done, classes = validation.cross_validate(wide.repartition(parts), "id", "label", names, folds=3, trees=20)
        seen.append({r["id"]: r["pred"] for r in done.collect()})
        assert classes == [0, 1, 2] and done.where("y = pred").count() > 570
    assert seen[0] == seen[1] and len(seen[0]) == 600


def test_passes_of_a_level_follow_the_bound_and_change_nothing(spark, monkeypatch):
    df, _x, _y = placed(spark)
    rows = df.select("id", "x", F.col("y").cast("int").alias("y"), "fold")
    whole = forest.fit(rows, 3, 3, trees=4, depth=4)[1]
    monkeypatch.setattr(forest, "PASS_BYTES", 8_000)
    monkeypatch.setattr(forest, "DIRECT_BYTES", 0)
    monkeypatch.setattr(forest, "CHUNK_BYTES", 3_000)
    small = forest.fit(rows, 3, 3, trees=4, depth=4)[1]
    assert all((getattr(whole, c) == getattr(small, c)).all() for c in ("column", "cut", "left", "counts"))
