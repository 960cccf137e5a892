import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions.algebra import beta_tail, dependent_columns, triangular_factor, vif_from_correlation
from cohortry.functions.moments import column_moments
from cohortry.functions import quantiles
from cohortry.functions.quantiles import exact_quantiles
from cohortry.operators import cleaning, selection

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def collinear(spark):
    x, y, noise = RNG.normal(size=200), RNG.normal(size=200), RNG.normal(size=200)
    rows = [(float(a), float(2 * a + 1), float(b), float(a + b), 3.0, float(c)) for a, b, c in zip(x, y, noise)]
    return spark.createDataFrame(rows, "x double, x2 double, y double, xy double, flat double, noise double").cache()


def least_squares_vif(m):
    out = []
    for i in range(m.shape[1]):
        others = np.column_stack([np.delete(m, i, axis=1), np.ones(len(m))])
        fit = others @ np.linalg.lstsq(others, m[:, i], rcond=None)[0]
        total = ((m[:, i] - m[:, i].mean()) ** 2).sum()
        out.append(1.0 / (1.0 - (1 - ((m[:, i] - fit) ** 2).sum() / total)))
    return out


def test_vif_equals_least_squares(spark):
    m = RNG.normal(size=(300, 4))
    m[:, 3] += 0.8 * m[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, d double")
    got = {r["feature"]: r["vif"] for r in selection.compute_vif(df, ["a", "b", "c", "d"]).collect()}
    assert np.allclose([got[c] for c in "abcd"], least_squares_vif(m))


def test_constant_has_vif_one_and_dependence_is_infinite():
    m = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 0]], dtype=float)
    found = vif_from_correlation(m, ["a", "b", "flat"])
    assert found["flat"] == 1.0 and np.isinf(found["a"])


def test_rank_pass_drops_dependent_columns(collinear):
    scaled = cleaning.standardise(collinear, collinear.columns)
    gone = dependent_columns(triangular_factor(scaled.repartition(40), scaled.columns), scaled.columns)
    assert len(gone) == 3 and "flat" in gone and "noise" not in gone


def test_vif_gate(collinear):
    kept, removed, vif = selection.remove_high_vif(collinear, collinear.columns, min_features=2)
    assert len(kept) == 3 and "flat" in removed and max(vif.values()) <= 10


def test_gate_respects_the_minimum(collinear):
    kept, _, _ = selection.remove_high_vif(collinear, collinear.columns, min_features=5)
    assert len(kept) == 5


def test_f_tail_known_values():
    assert beta_tail(4.0, 2, 10) == pytest.approx(0.0530, abs=5e-4)  # tables: F(.05; 2, 10) = 4.10
    assert beta_tail(4.1028, 2, 10) == pytest.approx(0.05, abs=1e-4)
    assert beta_tail(0.0, 3, 7) == 1.0


def test_exact_quantiles_by_refinement(spark):
    values = np.concatenate([RNG.exponential(100, 5000), np.full(3000, 42.0)])  # a hot value
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = exact_quantiles(df, {"v": [0.0, 0.25, 0.5, 0.9, 1.0]}, one_pass_rows=10)["v"]
    assert np.allclose(got, np.quantile(values, [0, 0.25, 0.5, 0.9, 1.0]))


def test_moments_match_numpy(spark):
    x = RNG.exponential(3, 500)
    df = spark.createDataFrame([(float(v), None if i % 10 == 0 else float(i), float("inf") if i == 3 else 1.0) for i, v in enumerate(x)], "a double, b double, c double")
    m = column_moments(df, ["a", "b", "c"])
    n = len(x)
    g1 = ((x - x.mean()) ** 3).mean() / x.var() ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2)
    assert m["a"].mean == pytest.approx(x.mean()) and m["a"].variance == pytest.approx(x.var()) and m["a"].skew == pytest.approx(g1)
    assert m["a"].log_variance == pytest.approx(np.log1p(x).var())
    assert m["b"].nulls == 50 and m["c"].infinities == 1 and m["c"].constant


def test_selector_on_three_groups(spark):
    centres = RNG.normal(0, 1, (3, 12))
    x = np.vstack([c + RNG.normal(0, 0.3, (80, 12)) for c in centres])
    names = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    done = selection.select_features(df, "id", vif_threshold=1e6)
    assert not done.blocked and len(done.selected) >= 1 and done.ranking.count() == 12


def test_cleaning_thresholds(spark):
    rows = [(i, None if i < 5 else 1.0 + i, None if i < 6 else 1.0 + i, None, 7.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, half double, more double, void double, flat double")
    kept, report = cleaning.drop_low_value_columns(df)
    assert kept.columns == ["k", "half"]  # exactly one half missing is not too much
    assert report["dropped_high_null"] == [("more", 0.6)] and report["dropped_all_null"] == ["void"] and report["dropped_constant"] == ["flat"]
    filled, fills = cleaning.impute_missing(kept, "median")
    assert fills == {"half": 8.0} and filled.where(F.col("half").isNull()).count() == 0


def test_unit_rows_keep_zero_rows(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, features array<double>")
    assert [r["features"] for r in cleaning.unit_rows(df).orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_missing_values_do_not_end_a_run(spark):
    rows = [(float(i), float(i * i % 7), None if i % 5 == 0 else float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert len(selection.explained_variance(df, ["a", "b", "c"])) == 2
    assert [r["feature"] for r in selection.compute_vif(df, ["a", "b", "c"]).collect()] and "c" not in {r["feature"] for r in selection.compute_vif(df, ["a", "b", "c"]).collect()}
    assert selection.high_correlations(df, ["a", "b", "c"], 0.0).count() == 3
    assert selection.compute_vif(df, ["c"]).collect() == []


def test_hot_medians_close_in_on_a_heavy_tail(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "WINDOW_ROWS", 20)
    rng = np.random.default_rng(8)
    groups = {"tail": np.concatenate([np.exp(rng.normal(0, 1e-3, 501)), [1e12, -1e12]]), "same": np.full(300, 3.5), "even": rng.normal(size=400), "few": np.array([1.0, 9.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("tail", None)]
    got = {r["g"]: r["m"] for r in quantiles.group_medians(spark.createDataFrame(rows, "g string, v double"), ["g"], {"m": "v"}, hot_rows=100).collect()}
    assert got == {g: pytest.approx(float(np.median(v)), abs=1e-12) for g, v in groups.items()}


def test_triangular_factor_passes_over_empty_partitions(spark):
    df = spark.range(5).select((F.col("id") * 1.0).alias("a"), (F.col("id") * F.col("id") * 1.0).alias("b"), (F.col("id") * 2.0).alias("c")).coalesce(1)
    holed = df.unionByName(df.where("a < 0"))  # its second partition has no rows
    assert dependent_columns(triangular_factor(holed, ["a", "b", "c"]), ["a", "b", "c"]) == ["a"]
    assert triangular_factor(df.where("a < 0"), ["a", "b", "c"]).shape == (0, 3)
