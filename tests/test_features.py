"""Window semantics on a hand-made frame; expected values worked out by hand."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry.operators import features as fx
from cohortry.operators.features import Roles, event_frame, months_before
from cohortry.plans.feature_plan import build_features, default_plan

LATEST = dt(2024, 1, 31, 12, 0, 0)
ROWS = [
    # row, entity, time, amount, category
    (1, "a", dt(2023, 7, 31, 12, 0, 0), 10.0, "x"),  # exactly on the 6-month edge: inside
    (2, "a", dt(2023, 7, 31, 11, 59, 59), 7.0, "x"),  # one second earlier: outside
    (3, "a", LATEST, 30.0, "x"),
    (4, "b", dt(2023, 11, 10, 8, 0, 0), 4.0, "y"),
    (5, "b", dt(2023, 12, 5, 8, 0, 0), None, "y"),  # null amount
    (6, "b", dt(2024, 1, 2, 20, 0, 0), 6.0, "y"),
    (7, "b", dt(2024, 1, 4, 19, 0, 0), 8.0, "y"),  # 47 hours later: one whole day
    (8, "c", dt(2023, 3, 1, 20, 0, 0), 5.0, "x"),  # single row, outside six months
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "row long, who string, at timestamp_ntz, amt double, kind string")


@pytest.fixture(scope="module")
def frame(events):
    return event_frame(events, Roles("who", "at", "amt", "kind", ("row",)))


def by_entity(built):
    df, _ = built
    return {r["who"]: r.asDict() for r in df.collect()}


def test_month_subtraction_clips_and_keeps_the_time():
    assert months_before(dt(2024, 3, 31, 5, 6), 1) == dt(2024, 2, 29, 5, 6)
    assert months_before(LATEST, 6) == dt(2023, 7, 31, 12)


def test_group_aggregate_window_edge_and_null_amounts(frame):
    got = by_entity(fx.group_aggregate(frame, "kind", "amt", windows=[6, "all"], metrics=["count", "sum", "mean", "std", "max", "freq", "median"]))
    assert got["a"]["count_x_6m"] == 2 and got["a"]["count_x_all"] == 3
    assert got["a"]["sum_x_6m"] == 40.0 and got["a"]["max_x_6m"] == 30.0
    assert got["a"]["freq_x_6m"] == pytest.approx(2 / 184)
    assert got["b"]["count_y_all"] == 3 and got["b"]["sum_y_all"] == 18.0  # the null amount is not counted
    assert got["b"]["median_y_all"] == 6.0
    assert got["c"]["std_x_all"] is None  # becomes 0 in the matrix


def test_group_shares(frame):
    got = by_entity(fx.group_aggregate(frame, "kind", "amt", windows=["all"], metrics=["pct_count", "pct_sum"]))
    assert got["a"]["pct_count_x_all"] == 1.0 and got["a"]["pct_count_y_all"] is None
    assert got["b"]["pct_sum_y_all"] == 1.0


def test_trend_defaults(spark, frame, events):
    roles = Roles("who", "at", "amt", "kind", ("row",))
    plan = [{"builder": "group_trend", "params": {"base_window": 6, "compare_window": 12}}]
    got = {r["who"]: r for r in build_features(events, roles, plan).collect()}
    assert got["a"]["trend_count_x"] == pytest.approx(2 / 4) and got["a"]["trend_sum_x"] == pytest.approx(40 / 48)
    assert got["c"]["trend_count_x"] == 1.0  # only in the compare window
    assert got["a"]["trend_count_y"] == 1.0  # in some requested category, not in this one


def test_streak_across_the_year_end(frame):
    got = by_entity(fx.group_streak(frame, "kind"))
    assert got["b"]["streak_y"] == 3 and got["a"]["streak_x"] == 1 and got["c"]["streak_x"] == 1


def test_recency_and_gaps(frame):
    got = by_entity(fx.frequency_recency(frame, windows=[6, "all"]))
    assert got["a"]["days_since_last"] == 0 and got["b"]["days_since_last"] == 26
    assert got["b"]["event_count_all"] == 4 and got["b"]["active_periods_all"] == 3
    assert got["b"]["avg_gap_days_all"] == pytest.approx((25 + 28 + 1) / 3)
    assert got["c"]["avg_gap_days_all"] is None  # fewer than two rows
    assert got["a"]["event_count_6m"] == 2 and got["a"]["avg_gap_days_6m"] == 184


def test_peak_hour_takes_the_smaller_of_equal_modes(frame):
    got = by_entity(fx.temporal_patterns(frame))
    assert got["b"]["peak_hour_all"] == 8
    assert got["b"]["pct_evening_all"] == 0.5 and got["b"]["pct_morning_all"] == 0.5


def test_static_attributes_encode_two_values(spark):
    df = spark.createDataFrame([(1, "a", "F", 1.0), (2, "a", "M", 3.0), (3, "b", "M", 5.0)], "row long, who string, sex string, age double")
    got = by_entity(fx.static_attributes(event_frame(df, Roles("who", order=("row",))), ["sex", "age"]))
    assert got["a"]["sex_M"] == 0.0 and got["b"]["sex_M"] == 1.0 and got["a"]["age"] == 2.0


def test_matrix_has_every_entity_once_and_no_gaps(events):
    m = build_features(events, Roles("who", "at", "amt", "kind", ("row",)), default_plan(True))
    rows = m.collect()
    assert sorted(r["who"] for r in rows) == ["a", "b", "c"]
    assert all(v is not None for r in rows for v in r)


def test_result_does_not_depend_on_partitioning(events):
    roles = Roles("who", "at", "amt", "kind", ("row",))
    one = build_features(events.coalesce(1), roles).orderBy("who").collect()
    many = build_features(events.repartition(7).orderBy(F.desc("row")), roles).orderBy("who").collect()
    assert one == many


def test_hot_entity_medians_match_the_plain_path(events):
    normal, hot = (event_frame(events, Roles("who", "at", "amt", "kind"), hot_rows=h) for h in (10**9, 1))
    a = by_entity(fx.overall_aggregate(normal, "amt", [6, "all"]))
    b = by_entity(fx.overall_aggregate(hot, "amt", [6, "all"]))
    assert a == b


def test_colliding_category_names_are_kept_apart(spark):
    df = spark.createDataFrame([("a", "p q", 1.0), ("a", "p-q", 2.0)], "who string, kind string, amt double")
    got = by_entity(fx.group_aggregate(event_frame(df, Roles("who", None, "amt", "kind")), "kind", "amt", windows=["all"], metrics=["sum"]))
    assert sorted(v for k, v in got["a"].items() if k.startswith("sum")) == [1.0, 2.0]


def test_gate_blocks_small_and_flat_matrices(spark):
    flat = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(10)], "who int, a double, b double")
    assert fx.matrix_gate(flat, "who", min_features=2)["blocked"]
    assert fx.matrix_gate(flat, "who")["blocked"]
    rich = flat.withColumn("c", F.col("who").cast("double"))
    assert not fx.matrix_gate(rich, "who", min_features=3)["blocked"]
