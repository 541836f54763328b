"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA, plan
from runlens.operators import joins
from runlens.operators.lifecycle import stuck_runs
from runlens.operators.predicates import filter_runs, login_history, recent, with_keys
from runlens.plans import trends
from runlens.sources.tables import store_runs


@pytest.fixture(scope="module")
def stored_runs(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("runs") / "runs")
    with_keys(tables.runs).write.parquet(path)
    return spark.read.parquet(path)


def test_filter_reaches_the_scan(stored_runs):
    text = plan(filter_runs(stored_runs, ["ready"], environment=["dev", "qa"], from_date="05-01-2024", to_date="20-01-2024"))
    assert "In(environment_key, [DEV,QA])" in text
    assert "EqualTo(status_key,READY)" in text
    assert "GreaterThanOrEqual(start_time" in text and "LessThanOrEqual(start_time" in text


def test_days_outside_the_range_are_not_read(spark, tables, tmp_path):
    store_runs(tables.runs, str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    found = filter_runs(stored, from_date="05-01-2024", to_date="06-01-2024")
    assert "start_day#" in plan(found).split("PartitionFilters:")[1].split("\n")[0]
    assert found.count() == filter_runs(tables.runs, from_date="05-01-2024", to_date="06-01-2024").count()


def test_only_needed_columns_are_read(stored_runs):
    text = plan(trends.dashboard(stored_runs, "2024-01-31 12:00:00"))
    assert "ReadSchema: struct<status:string,job_name:string,dimension:string,last_activity:timestamp_ntz>" in text


def test_dashboard_reads_the_log_once(stored_runs):
    text = plan(trends.dashboard(stored_runs, "2024-01-31 12:00:00"))
    assert text.count("ReadSchema") == 1


@pytest.mark.parametrize("key", ["W2_latest_build", "W5_last_login"])
def test_newest_rows_are_found_by_hashing(spark, key):
    text = plan(entry.QUERIES[key](spark, DATA))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_time_ranges_reach_the_scan(stored_runs, tables):
    assert "GreaterThanOrEqual(last_activity" in plan(recent(stored_runs, 7, "2024-01-31 00:00:00"))
    assert "LessThan(start_time" in plan(stuck_runs(stored_runs, "absolute", 5, "2024-01-31 00:00:00"))
    logins = login_history(tables.logins, 0, "", "10-01-2024", "20-01-2024")
    assert "LessThan(ts" in plan(logins) and "GreaterThanOrEqual(ts" in plan(logins)


EAGER = ("J14", "V5", "V6_search_below", "L1_begin_stream", "L2_fold", "L3_error_stream",
         "L4_stuck_stream", "L4_stuck_late", "L4_silent_stream", "L5", "L6", "L7_mail", "L8", "S", "F1_filter_stored")


@pytest.mark.parametrize("key", [k for k in entry.QUERIES if not k.startswith(EAGER)])
def test_no_query_pairs_all_rows(spark, key):
    text = plan(entry.QUERIES[key](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_join_needs_an_equality(tables):
    with pytest.raises(ValueError):
        joins.from_tables(tables.region, tables.nation)
    with pytest.raises(ValueError):
        joins.join_on(tables.region, tables.nation, [], F.col("r_regionkey") > F.col("n_regionkey"))
