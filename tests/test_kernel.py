from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import kernel, validation


def test_steps_reach_the_minimum():
    a, b = np.diag([1.0, 10.0, 100.0]), np.array([1.0, -2.0, 3.0])
    one = kernel.minimise(np.zeros(3), 60, 1e-14)
    point, asked = next(one), 0
    with pytest.raises(StopIteration) as done:
        while True:
            asked += 1
            point = one.send((float(point @ a @ point / 2 - b @ point), a @ point - b))
    assert np.allclose(done.value.value, b / np.diag(a), atol=1e-4) and asked < 80


def test_machines_of_all_folds_share_passes_and_agree_with_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2)).round(3)
    y = (np.square(x).sum(axis=1) > 1.5).astype(int) + (x[:, 0] > 1.0)
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))], "id long, label int, a double, b double")
    prepared, classes = validation.prepare_classes(df, "id", "label", ["a", "b"])
    placed = validation.stratified_folds(prepared, "id", "y", 2, 42).persist()
    lifted = validation.fourier_features(placed, seed=42)
    model = validation.build_estimator("svm").fit(lifted.where("fold <> 0"))
    plain = {r["id"]: r["pred"] for r in model.transform(lifted.where("fold = 0")).select("id", "pred").collect()}
    monkeypatch.setattr(validation, "build_estimator", lambda *a, **k: pytest.fail("one fold after another"))
    done, _ = validation.cross_validate(df, "id", "label", ["a", "b"], "svm", folds=2)
    found = {r["id"]: (r["y"], r["pred"]) for r in done.collect()}
    assert len(found) == 240 and np.mean([a == b for a, b in found.values()]) > 0.85
    assert np.mean([found[i][1] == p for i, p in plain.items()]) > 0.9
    again, _ = validation.cross_validate(df.repartition(5), "id", "label", ["a", "b"], "svm", folds=2)
    assert np.mean([found[r["id"]][1] == r["pred"] for r in again.collect()]) > 0.99
