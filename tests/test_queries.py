"""Registered queries against their SQL, on the smallest tables."""

import glob

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import digest

# one or two of each family; the whole catalogue is checked by check_queries.py
CHECKED = [
    "F03_group_aggregate", "F06_group_trend", "F09_frequency_recency", "F12_static_attributes", "P03_distribution_documents", "P10_entity_role_orders",
    "C02_drop_null_columns", "S02_row_id", "L09_anova", "K03_dbscan", "K08_composite", "M03_davies_bouldin_calinski_harabasz", "R02_top_features",
    "N02_similar_descriptions", "V04_stratified_folds", "B02_target_schedule", "A01_match_cases", "H03_active_rules", "E04_status", "X03_tfidf",
]


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, folder, con, name):
    df = queries()[name](spark, folder)
    cur = con.execute(oracle_sql()[name])
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    _, mine, my_cols = digest(df.columns, [tuple(r) for r in df.collect()])
    _, theirs, their_cols = digest(cols, want)
    assert my_cols == their_cols and mine == theirs


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "feature" in df.columns
