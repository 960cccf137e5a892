"""Passes over packed blocks: what they hold, how many tasks report to the driver, and that none plans a query."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from cohortry.functions.partials import blocks_of, summed_blocks
from cohortry.functions.vectors import nearest, squared_distances
from cohortry.operators.clustering import gaussian_mixture, kmeans
from cohortry.operators.clustering.mixtures import unmasked
from cohortry.operators.clustering.sweep import Fit, sweep


def _points(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select("id", F.array(F.col("id") % 7 * 10.0, F.col("id") % 11 / 10.0).alias("features"))


def test_nearest_centres_are_found_in_bounded_memory():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2_048, 3)), rng.normal(size=(16_000, 3))  # the drawn rows of 2,000 starts
    tracemalloc.start()
    marks, far = nearest(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    d = squared_distances(x[:50], y)
    assert (marks[:50] == d.argmin(axis=1)).all() and np.allclose(far[:50], d.min(axis=1))


def test_no_more_partial_sums_than_cores_reach_the_driver(spark):
    packed = sweep(unmasked(_points(spark, 4_000, 20)), [Fit(3, 1)], max_iter=1).packed
    assert packed.rdd.getNumPartitions() == 20
    blocks = blocks_of(packed, "n", "x")
    assert blocks.getNumPartitions() <= spark.sparkContext.defaultParallelism

    def add(total, block):
        total[0] += np.frombuffer(block["x"]).reshape(block["n"], 2).sum(axis=0)

    want = [sum(i % 7 * 10.0 for i in range(4_000)), sum(i % 11 / 10.0 for i in range(4_000))]
    assert np.allclose(summed_blocks(blocks, add, 1, 2), [want])


def test_large_partial_sums_are_added_by_tasks(spark, monkeypatch):
    rows = spark.sparkContext.parallelize(range(100), 5)

    def add(total, i):
        total[i] += i

    few = summed_blocks(rows, add, 100, 3)
    monkeypatch.setattr("cohortry.functions.partials.COLLECT_BYTES", 0)
    assert (summed_blocks(rows, add, 100, 3) == few).all() and (few[:, 0] == np.arange(100)).all()


def test_passes_of_a_fit_plan_no_query(spark, monkeypatch):
    planned = []
    frame = type(spark.range(1))
    plain = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, *a, **k: planned.append(1) or plain(self, *a, **k))
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(rng.normal(size=(600, 2)))], "id long, features array<double>")
    kmeans(rows, 8, restarts=2).collect()
    assert len(planned) <= 10  # packing, five draws, their weights in two, labels; one for each pass before
    planned.clear()
    gaussian_mixture(rows, 3, restarts=1).collect()
    assert len(planned) <= 11


def test_many_centres_are_summed_like_few(spark, monkeypatch):
    rows = unmasked(_points(spark, 3_000))
    few = sweep(rows, [Fit(6, 3)])
    monkeypatch.setattr("cohortry.operators.clustering.sweep.FEW_CENTRES", 0)
    many = sweep(rows, [Fit(6, 3)])
    assert np.allclose(few.means[0], many.means[0]) and (few.counts[0] == many.counts[0]).all() and np.allclose(few.inertia, many.inertia)
