from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import profiling

GRID = np.arange(200)


def plain(x):
    w = x.std(ddof=1) * len(x) ** -0.2
    g = np.linspace(x.min(), x.max(), 200)
    d = np.exp(-(((g[:, None] - x[None]) / w) ** 2) / 2).sum(axis=1)
    return sum(all(d[i] > d[j] for j in range(max(i - 10, 0), min(i + 10, 199) + 1) if j != i) for i in range(1, 199))


def columns():
    rng = np.random.default_rng(3)
    yield "one", rng.normal(size=700)
    yield "two", np.append(rng.normal(-4, 1, 350), rng.normal(4, 1, 350))
    yield "rough", np.round(rng.exponential(size=700), 1)
    yield "tails", rng.standard_cauchy(size=700)
    yield "steps", rng.integers(0, 5, 700) * 10.0
    yield "flat", rng.uniform(size=700)


@pytest.mark.parametrize("force", [False, True])
def test_peaks_of_all_columns_equal_the_plain_sum(spark, monkeypatch, force):
    if force:  # every column is summed over its values
        peaks = profiling._peaks
        monkeypatch.setattr(profiling, "_peaks", lambda d, e, order: (peaks(d, e, order)[0], False))
    named = dict(columns())
    rows = list(zip(*(v.tolist() for v in named.values())))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in named)).repartition(4)
    df = df.unionByName(df.limit(1).select(*[F.lit(None).cast("double").alias(c) for c in named]))
    df = df.withColumn("few", F.when(F.col("one") > 2, 1.0)).withColumn("same", F.lit(1.0))
    got = {r.feature: r.peaks for r in profiling.multimodal_features(df).collect()}
    assert got == {c: plain(v) for c, v in named.items()}


def test_no_columns_and_no_rows(spark):
    assert profiling.multimodal_features(spark.createDataFrame([("a",)], "t string")).collect() == []
    assert profiling.multimodal_features(spark.createDataFrame([], "x double")).collect() == []
