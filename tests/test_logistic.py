import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortry.operators import logistic, validation


@pytest.mark.parametrize("classes", [2, 3])
def test_folds_share_few_passes_and_reach_the_minimum(spark, classes):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1.0, 50.0, 0.01] + [0, 1000, 5]
    y = ((x[:, 0] + x[:, 1] / 50 + rng.normal(0, 0.5, 400)) > 20).astype(int) + (x[:, 0] > 0.8) * (classes - 2)
    rows = [(i, [float(v) for v in x[i]] + [7.0], float(y[i]), i % 4) for i in range(400)]  # the last column is constant
    placed = spark.createDataFrame(rows, "id long, f array<double>, y double, fold int").withColumn("features", array_to_vector("f")).drop("f").persist()
    placed.count()
    sc = spark.sparkContext
    sc.setJobGroup(f"folds of {classes}", "")
    got = {r["id"]: r["pred"] for r in logistic.out_of_fold(placed, classes, 4, 1.0 / 400).collect()}
    assert len(sc.statusTracker().getJobIdsForGroup(f"folds of {classes}")) < 40
    sc.setJobGroup("", "")
    want = {}
    for f in range(4):
        model = validation.build_estimator("logistic", rows=400).fit(placed.where(F.col("fold") != f))
        want |= {r["id"]: r["pred"] for r in model.transform(placed.where(F.col("fold") == f)).collect()}
    assert got.keys() == want.keys() and sum(got[i] != want[i] for i in want) <= 1  # a row on the border may fall to either side


def test_cross_validation_runs_all_folds_together(spark, monkeypatch):
    monkeypatch.setattr(validation, "build_estimator", lambda *a, **k: pytest.fail("one fold after another"))
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") % 10 < 4, "low").otherwise("high").alias("band"))
    predictions, classes = validation.cross_validate(df, "id", "band", ["a"], "logistic_regression", folds=4)
    assert classes == ["high", "low"] and predictions.where("y <> pred").isEmpty() and predictions.count() == 200
