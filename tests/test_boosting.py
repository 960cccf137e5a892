from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortry.operators import boosting, validation
from cohortry.operators.boosting import Boosting


def placed(spark, n=600, classes=3, seed=0, folds=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 0] > 0.3).astype(int)
    rows = [(i, float(y[i] % classes), x[i].tolist(), i % folds) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, x array<double>, fold int").withColumn("features", array_to_vector("x")), x, y


def plain_rounds(x, y, fold, folds, classes, how):
    """Boosting one tree after another, with every value of a column as a cut."""
    n = len(x)
    out = np.zeros((n, folds, classes))
    for f in range(folds):
        seen, score = fold != f, np.zeros((n, classes))
        for _ in range(how.trees):
            share = np.exp(score - score.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            step = np.zeros((n, classes))
            for c in range(classes):
                g, h = share[:, c] - (y == c), np.maximum(2 * share[:, c] * (1 - share[:, c]), 1e-16)

                def grow(rows, every, depth):
                    own, ridge = rows[seen[rows]], how.ridge
                    total, weight = g[own].sum(), h[own].sum()
                    step[every, c] = -how.rate * total / (weight + ridge) if len(own) else 0.0
                    if depth == how.depth or not len(own):
                        return
                    best = (1e-6, None, None)
                    for j in range(x.shape[1]):
                        for cut in np.unique(x[:, j])[:-1]:
                            left = own[x[own, j] <= cut]
                            gl, hl = g[left].sum(), h[left].sum()
                            gr, hr = total - gl, weight - hl
                            if hl < how.least_hessian or hr < how.least_hessian or not 0 < len(left) < len(own):
                                continue
                            gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - total * total / (weight + ridge)
                            if gain > best[0] + 1e-9:
                                best = (gain, j, cut)
                    if best[1] is not None:
                        go = x[every, best[1]] <= best[2]
                        grow(every[go], every[go], depth + 1)
                        grow(every[~go], every[~go], depth + 1)

                grow(np.arange(n), np.arange(n), 0)
            score = score + step
        out[:, f] = score
    return out


@pytest.mark.parametrize("direct", [True, False])
def test_margins_equal_plain_boosting(spark, monkeypatch, direct):
    if not direct:
        monkeypatch.setattr(boosting, "DIRECT_BYTES", 0)
    df, x, y = placed(spark, n=120)
    df = df.withColumn("x", F.transform("x", lambda v: F.round(v, 1)))
    x = np.array([r.x for r in df.orderBy("id").collect()])
    how = Boosting(trees=3, depth=3)
    state, done = boosting.fit(df.select("id", "x", F.col("y").cast("int").alias("y"), "fold").repartition(3), 3, 3, how)
    got = {i: m for ids, *_, margins in state.collect() for i, m in zip(ids, margins.reshape(len(ids), 3, 3))}
    want = plain_rounds(x, y, np.arange(120) % 3, 3, 3, how)
    assert np.allclose(np.stack([got[i] for i in range(120)]), want, atol=1e-8)
    assert len(done.rounds) == 3 and done.gains[:2].sum() > 5 * done.gains[2:].sum()


def test_out_of_fold_predictions_do_not_see_their_rows(spark):
    df, _, _ = placed(spark)
    how = Boosting(trees=20, depth=3)
    first = {r.id: r.pred for r in boosting.out_of_fold(df, 3, how).collect()}
    # labels of fold 0 change: its own predictions stay
    other = df.withColumn("y", F.when(F.col("fold") == 0, (F.col("y") + 1) % 3).otherwise(F.col("y")))
    second = {r.id: r.pred for r in boosting.out_of_fold(other, 3, how).collect()}
    assert all(first[i] == second[i] for i in first if i % 3 == 0)
    truth = {r.id: r.y for r in df.select("id", "y").collect()}
    assert sum(first[i] == truth[i] for i in first) / len(first) > 0.9


def test_jobs_do_not_grow_with_folds_or_classes(spark):
    counts = []
    for folds, classes in ((2, 2), (5, 3)):
        df, _, _ = placed(spark, n=200, classes=classes, folds=folds)
        group = f"boost-{folds}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.fit(df.select("id", "x", F.col("y").cast("int").alias("y"), "fold"), classes, folds, Boosting(trees=2, depth=2, least_hessian=0.0))
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert counts[0] == counts[1]


@pytest.mark.parametrize("model", ["xgboost", "lightgbm", "gradient_boosting"])
def test_boosters_by_name(spark, model):
    df, x, _ = placed(spark, n=300)
    wide = df.select("id", F.when(F.col("y") == 0, "a").when(F.col("y") == 1, "b").otherwise("c").alias("label"), *[F.col("x")[i].alias(f"x{i}") for i in range(4)])
    names = [f"x{i}" for i in range(4)]
    how = validation.boosting_of(model, 10)
    assert how.trees == (100 if model == "gradient_boosting" else 10)
    out, classes = validation.cross_validate(wide, "id", "label", names, model, folds=2, trees=10) if how.trees == 10 else (None, ["a", "b", "c"])
    assert classes == ["a", "b", "c"]
    if out is not None:
        assert out.where("y = pred").count() > 0.75 * 300 and out.count() == 300
        table = validation.feature_importances(wide, "id", "label", names, model, trees=5).collect()
        assert {r.feature for r in table[:2]} == {"x0", "x1"} and math.isclose(sum(r.importance for r in table), 1.0, abs_tol=1e-4)
