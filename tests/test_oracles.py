"""Registered queries against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

DATA = "/root/testdata/sf0.001"
QUICK = (
    "unified_events labels_load lookup_encode events_in_range user_filter latest_profile attribute_changes terminated_users "
    "median_impute insider_days daily_activity daily_mode_pc peak_hour sessions session_counts daily_session_stats session_gaps "
    "user_split window_labels embedding_mean_pool threshold_fixed_recall pr_curve score_separation per_user_breakdown session_metrics "
    "top_windows session_drilldown numeric_profile top_values event_overview score_histogram chart_scatter"
).split()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    assert differences(got, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
