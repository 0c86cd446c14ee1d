"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import duckdb
import pytest
from check import TABLES, canonical

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
EMPTY = {"filter_day"}    # no order of that day in the smallest tables


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def matches(spark, duck, name):
    got = queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(got) or name in EMPTY


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    matches(spark, duck, name)


WHEN_LARGE = ["agg_grouped_median", "agg_group_tree", "profile_time", "fill_previous", "fill_next", "fill_median", "series_difference",
              "series_moving_average", "series_rolling_trend", "series_exponential_average_gaps", "series_half_life_trend", "series_decompose_additive",
              "series_overview", "anomaly_rolling", "anomaly_reshape_segments", "sliding_windows", "encode_label", "scale_robust", "distribution_box",
              "correlation_spearman", "correlation_kendall", "outlier_tails", "outlier_density_noise", "outlier_local_factor", "feature_series",
              "metric_binary", "join_left", "split_ordered", "clean_table"]


@pytest.mark.parametrize("name", WHEN_LARGE)
def test_large_way(tight, duck, name):
    matches(tight, duck, name)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_rows_listed():
    from plumbline.plans import load_all
    assert all(q.rows for q in load_all().values())
    assert set(oracle_sql()) <= set(queries())
