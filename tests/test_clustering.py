"""Algorithms on blobs and against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions import blocks
from cohortry.operators import metrics, refine, search
from cohortry.operators.clustering import dbscan, density, fuzzy_c_means, gaussian_mixture, kmeans, ward
from cohortry.operators.clustering.density import connected_components, neighbour_counts
from cohortry.operators.clustering.mixtures import mixture_sweep
from cohortry.operators.clustering.sweep import Fit, sweep, with_masks
from cohortry.operators.clustering.ward import ward_cuts, ward_labels
from cohortry.operators.validation import nearest_neighbour_votes

RNG = np.random.default_rng(42)
CENTRES = RNG.uniform(-6, 6, (4, 6))
X = np.vstack([c + RNG.normal(0, 0.55, (45, 6)) for c in CENTRES])
TRUTH = np.repeat(np.arange(4), 45)


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, features array<double>").cache()


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(TRUTH)], "id long, cluster_id int").cache()


def brute_silhouette(x, marks):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = marks == marks[i]
        a = d[i][own].sum() / max(own.sum() - 1, 1)
        b = min(d[i][marks == c].mean() for c in set(marks) if c != marks[i])
        out.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    return np.array(out)


@pytest.mark.parametrize(
    "fit",
    [
        lambda v: kmeans(v, 4, restarts=1),
        lambda v: kmeans(v, 4, restarts=3),
        lambda v: ward(v, 4),
        lambda v: ward(v, 4, micro=40),
        lambda v: fuzzy_c_means(v, 4),
        lambda v: gaussian_mixture(v, 4, restarts=5),
        lambda v: dbscan(v, eps=2.0, min_samples=5),
    ],
)
def test_blobs_are_found(blobs, truth, fit):
    labels = fit(blobs)
    assert labels.count() == len(X)
    assert metrics.ari(labels, truth) >= 0.80


def test_ward_is_exact_on_small_input():
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [9.0]])
    marks = ward_labels(x, np.ones(6), 3)
    assert marks.tolist() == [0, 0, 0, 1, 1, 2]


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.3, (60, 2)), rng.normal(3, 0.3, (60, 2)), rng.uniform(-4, 7, (15, 2)), np.zeros((20, 2))])  # 20 copies
    eps, need = 0.4, 5
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= need
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    counted = {r["rep"]: r["neighbours"] for r in neighbour_counts(df, eps, need).collect()}
    assert all(counted[i] == near[i].sum() for i in counted)
    group = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min([group[j] for j in np.flatnonzero(near[i] & core)], default=-1) if core[i] else -1 for i in range(len(x))])
        if (new == group).all():
            break
        group = new
    order = {g: k for k, g in enumerate(sorted(set(group[core])))}
    expected = []
    for i in range(len(x)):
        touching = [order[group[j]] for j in np.flatnonzero(near[i] & core)]
        expected.append(order[group[i]] if core[i] else min(touching, default=len(order)))
    got = {r["id"]: r["cluster_id"] for r in dbscan(df, eps, need).collect()}
    assert [got[i] for i in range(len(x))] == expected


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100


def test_silhouette_matches_brute_force(blobs, truth):
    expected = brute_silhouette(X, TRUTH)
    got = metrics.silhouette_points(blobs.join(truth, "id")).orderBy("id").collect()
    assert np.allclose([r["silhouette"] for r in got], expected)
    shared = metrics.silhouette_means(blobs, truth.select("id", F.array("cluster_id").alias("labels")), [np.bincount(TRUTH).astype(float)])
    assert shared[0] == pytest.approx(expected.mean())


def test_silhouette_blocks_cover_every_point(blobs, truth, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    got = metrics.silhouette_points(blobs.join(truth, "id"))
    assert got.count() == len(X)
    assert got.agg(F.avg("silhouette")).first()[0] == pytest.approx(brute_silhouette(X, TRUTH).mean())


def test_singletons_score_zero(spark):
    df = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [9.0], 1)], "id long, features array<double>, cluster_id int")
    got = {r["id"]: r["silhouette"] for r in metrics.silhouette_points(df).collect()}
    assert got[2] == 0.0


def test_agreement_with_itself_is_one(truth):
    assert metrics.ari(truth, truth) == 1.0


def test_sweep_keeps_subsamples_apart(blobs):
    rows = with_masks(blobs, len(X), 0.8, 2, 42)
    sizes = rows.agg(*[F.sum(F.col("masks")[i].cast("int")) for i in range(2)]).first()
    assert list(sizes) == [144, 144]
    done = sweep(rows, [Fit(4, s) for s in range(3)] + [Fit(4, 9, 0), Fit(3, 9, 1)])
    best = done.centres[done.best(4)]
    assert np.sqrt(((best[:, None] - CENTRES[None]) ** 2).sum(-1)).min(axis=1).max() < 0.5


def test_tournament_prefers_the_true_count(blobs):
    rows = search.tournament(blobs, ("kmeans", "hierarchical"), (2, 3, 4, 5), repeats=1, restarts=3).collect()
    assert rows[0]["k"] in (3, 4, 5) and rows[0]["silhouette"] > 0.4 and rows[0]["stability_ari"] >= 0.8
    assert len(rows) >= 3


def test_one_pass_measures_equal_single_ones(blobs):
    a, b = kmeans(blobs, 3, restarts=2), kmeans(blobs, 4, restarts=2)
    both = a.withColumnRenamed("cluster_id", "x").join(b.withColumnRenamed("cluster_id", "y"), "id").select("id", F.array("x", "y").alias("labels"))
    for metric in ("euclidean", "cosine"):
        for one, labels in zip(metrics.labeling_measures(blobs, both, [3, 5], metric), (a, b)):  # no row has the fifth label
            labelled = blobs.join(labels, "id")
            db, ch = metrics.davies_bouldin_calinski_harabasz(labelled)
            assert one.valid and np.isclose(one.davies_bouldin, db) and np.isclose(one.calinski_harabasz, ch)
            if metric == "euclidean":
                assert np.isclose(one.silhouette, metrics.silhouette(labelled))
            else:
                x = np.array([r.features for r in labelled.orderBy("id").collect()])
                y = np.array([r.cluster_id for r in labelled.orderBy("id").collect()])
                u = x / np.linalg.norm(x, axis=1, keepdims=True)
                far, scores = 1 - u @ u.T, []
                for i in range(len(u)):
                    own = far[i, y == y[i]].sum() / max(1, (y == y[i]).sum() - 1)
                    other = min(far[i, y == c].mean() for c in set(y) - {y[i]})
                    scores.append((other - own) / max(own, other) if (y == y[i]).sum() > 1 else 0.0)
                assert np.isclose(one.silhouette, np.mean(scores))


def test_mixtures_fitted_together_equal_plain_expectation_maximisation(blobs):
    rows = with_masks(blobs, len(X), 0.8, 1, 3)
    start = sweep(rows, [Fit(k, 7, m) for m in (None, 0) for k in (2, 3)], max_iter=5)
    done = mixture_sweep(start, [0, 1, 2, 3], max_iter=4, tolerance=0.0)
    seen = {r.id: r.masks[0] for r in rows.collect()}
    data = {r.id: np.array(r.features) for r in rows.collect()}
    for i, f in enumerate(done.fits):
        x = np.array([data[j] for j in sorted(data) if f.mask is None or seen[j]])
        share = np.eye(f.k)[((x[:, None] - start.centres[i][None]) ** 2).sum(-1).argmin(axis=1)]
        for _ in range(5):
            n = share.sum(axis=0)
            means = share.T @ x / n[:, None]
            covs = [((x - m).T * s) @ (x - m) / t + 1e-6 * np.eye(x.shape[1]) for m, s, t in zip(means, share.T, n)]
            logs = np.stack([np.log(t / len(x)) - 0.5 * (np.linalg.slogdet(c)[1] + x.shape[1] * np.log(2 * np.pi) + ((x - m) @ np.linalg.inv(c) * (x - m)).sum(axis=1)) for m, c, t in zip(means, covs, n)], axis=1)
            share = np.exp(logs - logs.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
        assert np.allclose(done.mixtures[i].means + done.shift, means, atol=1e-6)


def test_one_ward_tree_is_cut_at_every_k(spark, blobs):
    rows = with_masks(blobs, len(X), 0.8, 1, 3)
    cuts = {r.id: r.labels for r in ward_cuts(rows, len(X), [2, 5], [None, 0]).collect()}
    ids = sorted(cuts)
    seen = {r.id: r.masks[0] for r in rows.collect()}
    points = {r.id: r.features for r in blobs.collect()}
    for j, (k, mask) in enumerate(((2, False), (5, False), (2, True), (5, True))):
        some = [i for i in ids if not mask or seen[i]]
        want = ward_labels(np.array([points[i] for i in some]), np.ones(len(some)), k)
        pairs = set(zip((cuts[i][j] for i in some), want.tolist()))
        assert len(pairs) == k and all(cuts[i][j] == -1 for i in ids if i not in some)


def test_tournament_runs_every_algorithm_on_all_k(blobs):
    found = search.fit_candidates(blobs, len(X), list(search.TOURNAMENT), [2, 3], "euclidean", 2, 0.8, 1, 2)
    rows = found.table.collect()
    assert found.plans == [("kmeans", 2), ("kmeans", 3), ("hierarchical", 2), ("hierarchical", 3), ("gmm", 2), ("gmm", 3), ("dbscan", None)]
    width = len(found.plans)
    assert len(rows) == len(X) and all(len(r.labels) == 3 * width for r in rows)
    for r in rows:
        for t in range(2):
            assert r.masks[t] or r.labels[(t + 1) * width + 2] == -1 == r.labels[(t + 1) * width + 6]
        assert all(0 <= c < w for c, w in zip(r.labels, found.widths))


def test_deepening_and_lineage(blobs):
    labels = blobs.select("id", (F.col("id") >= 135).cast("int").alias("cluster_id"))  # 135 rows in one cluster
    placed, tree = refine.deepen(blobs, labels, "kmeans", cap=0.5, sub_k=3, max_depth=2, restarts=1)
    assert tree.nodes[0].split_into == [2, 3, 4] and tree.leaves() == [1, 2, 3, 4]
    assert tree.nodes[2].siblings == [3, 4] and tree.nodes[2].depth == 1
    assert placed.count() == len(X)


def test_merge_plan_goes_to_the_nearest_large_cluster():
    steps = refine.merge_plan({0: 50, 1: 60, 2: 2, 3: 1}, {0: [0.0], 1: [10.0], 2: [9.0], 3: [1.0]}, min_size=5)
    assert [(s["from"], s["to"]) for s in steps] == [(3, 0), (2, 1)]
    assert refine.merge_plan({0: 50, 1: 2}, {0: [0.0], 1: [1.0]}, 5) == []  # two clusters are kept
    assert refine.merge_plan({0: 1, 1: 2, 2: 3}, {0: [0.0], 1: [1.0], 2: [2.0]}, 5) == []  # nothing is large enough


def test_sizes_survive_merging(spark, blobs):
    labels = blobs.select("id", F.when(F.col("id") < 3, 9).otherwise((F.col("id") / 60).cast("int")).cast("int").alias("cluster_id"))
    tree = refine.start_lineage(refine.sizes_of(labels))
    merged, steps = refine.merge_tiny(blobs, labels, tree, 5)
    assert len(steps) == 1 and tree.nodes[9].merged_into is not None and merged.count() == len(X)


def schema_of():
    return T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType())])


def test_nearest_neighbours_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    train, test = rng.normal(size=(60, 3)), rng.normal(size=(25, 3))
    y = rng.integers(0, 3, 60)
    as_vectors = lambda x, extra: spark.createDataFrame([(i, Vectors.dense(v), *e) for i, (v, e) in enumerate(zip(x, extra))], schema_of())
    rows = nearest_neighbour_votes(as_vectors(train, [(float(v),) for v in y]), as_vectors(test, [(0.0,)] * 25), k=5).collect()
    got = {r["id"]: r["pred"] for r in rows}
    near = np.square(test[:, None] - train[None]).sum(axis=2).argsort(axis=1)[:, :5]
    want = {i: float(np.bincount(y[n], minlength=3).argmax()) for i, n in enumerate(near)}
    assert got == want


def test_ward_over_groups_is_exact_for_few_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(20, 2)) + c for c in ((0, 0), (8, 0), (0, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {r["id"]: r["cluster_id"] for r in ward(df, 3).collect()}
    want = ward_labels(x, np.ones(len(x)), 3)
    assert len(got) == 60 and len({(got[i], int(want[i])) for i in range(60)}) == 3
    assert ward(df.limit(0), 3).collect() == []


def test_a_crowded_cell_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(density, "CHUNK", 16)
    rng = np.random.default_rng(6)
    x = rng.random((300, 2)) * 0.5  # one cell of side 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {r["rep"]: r["neighbours"] for r in neighbour_counts(df, 0.1, 5).collect()}
    gaps = np.square(x[:, None] - x[None]).sum(axis=2)
    assert got == {i: int((gaps[i] <= 0.01).sum()) for i in range(300)}
    pairs = density._touching(density._chunked(density._grid(df, 1.0, 2), []), half=False)
    per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 8 and max(per_task) < sum(per_task) / 3


def test_blocks_move_in_proportion_to_the_tables(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 5)
    df = spark.range(1_000).select("id", F.array(F.col("id").cast("double")).alias("features"))
    out = blocks.block_pairs(
        df, df.select("id", "features"), lambda p, o, state: (state or 0) + len(p["id"]) * len(o["id"]), lambda p, state: pd.DataFrame({"pairs": [state], "n": [len(p["id"])]}), "pairs long, n long"
    )
    rows = out.collect()
    assert sum(r["pairs"] for r in rows) == 1_000_000
    assert sum(r["n"] for r in rows) == 1_000  # one result per point, not one per point and block of the other side
    groups, slices = blocks._grid(1_000, 1_000, 500, 12)
    assert groups * 1_000 + slices * 1_000 <= 37_000  # blocks that are moved; a million pairs of blocks before


def test_equally_far_neighbours_go_by_class(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)
    train = spark.createDataFrame([(i, Vectors.dense([1.0 if i % 2 else -1.0]), float(i % 5)) for i in range(40)], schema_of())
    test = spark.createDataFrame([(0, Vectors.dense([0.0]), 0.0)], schema_of())
    assert nearest_neighbour_votes(train, test, k=7).first()["pred"] == 0.0  # eight of class 0 are as near as all others


def test_tasks_of_dbscan_hold_a_bounded_number_of_packed_pairs(spark, monkeypatch):
    from cohortry.operators.clustering import density

    monkeypatch.setattr(density, "CHUNK", 16)
    monkeypatch.setattr(density, "PAIRS_PER_TASK", 8)
    x = np.random.default_rng(1).uniform(0, 4, (600, 2))
    vectors = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, features array<double>")
    pairs = density._touching(density._chunked(density._grid(vectors, 0.3, 2), []), half=False)
    assert pairs.rdd.getNumPartitions() * 8 >= pairs.count() > 200
    assert dict(pairs.dtypes)["lp_x"] == "binary"
    got = {r["rep"]: r["neighbours"] for r in density.neighbour_counts(vectors, 0.3, 5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert got == {i: int(n) for i, n in enumerate((d <= 0.3).sum(axis=1))}
