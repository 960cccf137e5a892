"""Iterative fits whose passes must stay short: what a pass may plan, convert or send."""

from __future__ import annotations

import numpy as np

from cohortry.operators import boosting, metrics
from cohortry.operators.clustering import fuzzy, sweep


def blobs(spark, n=600, d=3, k=4):
    """Rows around k far centres."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 10, (k, d))
    rows = [(i, (centres[i % k] + rng.normal(0, 1, d)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>")


def test_fuzzy_passes_plan_no_query(spark, monkeypatch):
    data = blobs(spark)
    calls, plain = [], type(data).toPandas
    monkeypatch.setattr(type(data), "toPandas", lambda self: calls.append(1) or plain(self))
    centres = fuzzy.fuzzy_centres(data, 4)
    assert len(calls) == 1  # the starting rows; a pass plans no query

    x = np.array([r["features"] for r in data.orderBy("id").collect()])
    now = centres
    for _ in range(200):  # the same steps on the whole matrix go on from there without moving much
        w = fuzzy.memberships(x, now) ** 2
        now = (w.T @ x) / w.sum(axis=0)[:, None]
    assert np.abs(now - centres).max() < 0.05
    labels = [r["cluster_id"] for r in fuzzy.fuzzy_c_means(data, 4).orderBy("id").collect()]
    assert labels == np.square(x[:, None] - centres).sum(axis=2).argmin(axis=1).tolist()


def test_distances_are_summed_once_for_rows_alike(spark):
    """Blocks come in the order of labels, and a stripe has no more columns to sum than runs of rows with the same labels."""
    rng = np.random.default_rng(3)
    n, widths = 1_500, [3, 4, 40]
    x = np.round(rng.normal(0, 5, (n, 2)), 2)
    marks = np.stack([(x[:, 0] > 0) * 1 + (x[:, 0] > 4), np.minimum((x[:, 1] > 0) * 1 + 2 * (x[:, 0] > 0), 3), (x[:, 0] > 0) * 7], axis=1).astype(int)
    order = np.lexsort(marks.T)
    edges = np.cumsum([0, *widths])
    stripes = list(metrics.label_stripes(x[order], marks[order].tolist(), edges))
    assert all(first is not None and len(first) == len(hot) <= 12 for _, first, hot in stripes)
    assert all(first is None and len(hot) == wide.shape[1] for wide, first, hot in metrics.label_stripes(x, rng.integers(0, 3, (n, 3)).tolist(), np.array([0, 3, 6, 9])))

    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    labels = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(marks)], "id long, labels array<int>")
    found = metrics.silhouette_means(data, labels, [np.bincount(marks[:, j], minlength=w).astype(float) for j, w in enumerate(widths)])
    far = np.sqrt(np.square(x[:, None] - x).sum(axis=2))
    for j, value in enumerate(found):
        own = marks[:, j]
        size = np.bincount(own, minlength=widths[j])
        sums = np.stack([far[:, own == c].sum(axis=1) for c in range(widths[j])], axis=1)
        a = sums[np.arange(n), own] / np.maximum(size[own] - 1, 1)
        other = np.where(size > 0, sums / np.maximum(size, 1), np.inf)
        other[np.arange(n), own] = np.inf
        b = other.min(axis=1)
        assert abs(np.where(size[own] > 1, (b - a) / np.maximum(a, b), 0.0).mean() - value) < 1e-6


def test_ties_and_strips_of_nearest_centres():
    """Equally near centres give their rows to the first, and few and many centres agree with the plain distances."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (500, 2)).astype(float)
    for k in (5, 60):
        centres = rng.integers(-3, 4, (k, 2)).astype(float)  # many ties
        plain = np.square(x[:, None] - centres).sum(axis=2)
        own = plain.argmin(axis=1)
        total = np.zeros((k, 4))
        sweep._add_nearest(total, sweep._seen(x), centres)
        assert (total[:, 2] == np.bincount(own, minlength=k)).all()
        assert np.allclose(total[:, :2], np.stack([np.bincount(own, x[:, i], k) for i in range(2)], axis=1))
        assert abs(total[:, 3].sum() - plain.min(axis=1).sum()) < 1e-9


def test_boosted_folds_take_no_job_for_each_tree(spark, monkeypatch):
    """Each fold is grown in a task of its own while it fits; its margins are those of levels shared by all folds."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)).round(1)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), i % 3) for i in range(400)], "id long, x array<double>, y int, fold int").repartition(3).persist()
    rows.count()

    def fitted(trees):
        group = f"by-fold-{trees}-{boosting.FOLD_BYTES}"
        spark.sparkContext.setJobGroup(group, group)
        state, done = boosting.fit(rows, 3, 3, boosting.Boosting(trees=trees, depth=3))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        got = {i: m for ids, *_, margins in state.collect() for i, m in zip(ids, margins)}
        return np.stack([got[i] for i in range(400)]), done, jobs

    few, many = fitted(2), fitted(6)
    assert many[2] <= few[2]
    monkeypatch.setattr(boosting, "FOLD_BYTES", 0)
    shared = fitted(6)
    assert np.allclose(many[0], shared[0], atol=1e-9) and np.allclose(many[1].gains, shared[1].gains)
    assert len(many[1].rounds) == 6 and shared[2] > many[2]
