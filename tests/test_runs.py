"""Run filter, aggregates, trends: small tables with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runlens.functions import labels
from runlens.operators import aggregates as a
from runlens.operators import paging
from runlens.operators import predicates as p
from runlens.plans import trends

T = dt.datetime


@pytest.fixture(scope="module")
def runs(spark):
    data = [
        (1, "ready", "STG_A", 0, "Done 100%", "DW_X", "DEV", T(2024, 1, 1, 0, 0, 0), T(2024, 1, 1, 1)),
        (2, "READY", "dim_b", 1, "Done", None, "dev", T(2024, 1, 10, 23, 59, 59), T(2024, 1, 11)),
        (3, "error", "FATO_C", 0, "100 percent", "DM_Y", "PROD", T(2024, 1, 10, 23, 59, 59, 500000), T(2024, 2, 1)),
        (4, "running", None, 1, None, "dw_z", None, T(2024, 2, 1), T(2023, 2, 1)),
        (5, None, "metric", None, "x", "OTHER", "QA", None, None),
    ]
    return spark.createDataFrame(data, (
        "id long, status string, job_name string, reprocess int, event_text string, dimension string, "
        "environment string, start_time timestamp_ntz, last_activity timestamp_ntz"
    ))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_all_filters_off_keep_every_row(runs):
    assert ids(p.filter_runs(runs, ["*"], [], None, ["*", "DEV"], "*", " ")) == [1, 2, 3, 4, 5]


def test_star_counts_only_in_first_place(runs):
    assert ids(p.filter_runs(runs, ["ready", "*"])) == [1, 2]


def test_text_ignores_case_and_escapes_wildcards(runs):
    assert ids(p.filter_runs(runs, environment=["DEV"])) == [1, 2]
    assert ids(p.filter_runs(runs, event_text="100%")) == [1]


def test_days_are_whole_up_to_the_last_full_second(runs):
    assert ids(p.filter_runs(runs, from_date="01-01-2024", to_date="10-01-2024")) == [1, 2]
    assert ids(p.filter_runs(runs, from_date="10-01-2024")) == [2, 3, 4]
    assert ids(p.filter_runs(runs, from_date="10-01-2024", as_of="31-01-2024")) == [2, 3]
    assert ids(p.filter_runs(runs, to_date="05-01-2024")) == [1]


def test_key_columns_give_the_same_rows(runs):
    kw = dict(status=["Ready", "ERROR"], dimension=["dw_x", "dm_y"])
    assert ids(p.filter_runs(p.with_keys(runs), **kw)) == ids(p.filter_runs(runs, **kw)) == [1, 3]


def test_in_list_of_several_forms(runs):
    assert ids(p.where_in(runs, "status", ["READY"])) == [1, 2]
    assert ids(p.where_not_in(runs, "status", ["ready"])) == [3, 4]  # NULL is neither in nor out
    assert ids(p.where_value(runs, "status", None)) == [5]
    assert ids(p.where_value(runs, "status", None, "!=")) == [1, 2, 3, 4]


def test_layers(runs):
    assert rows(a.layer_counts(runs)) == [(1, 1, 2, 2, 1)]


def test_null_forms_a_group(runs):
    assert a.distinct_count(runs, "dimension").first().amount == 5
    assert a.status_tally(runs).first().asDict() == {
        "ready": 1, "error": 1, "warning": 0, "running": 1, "other": 2, "total": 5}


def test_month_grain(runs):
    merged = rows(a.runs_by_status_month(runs.where("status is not null")), "label", "month_no", "amount", "month")
    assert merged == [("ERROR", 2, 1, "February"), ("READY", 1, 2, "January"), ("RUNNING", 2, 1, "February")]
    apart = a.runs_by_status_month(runs.where("id in (3, 4)"), "year_month")
    assert rows(apart, "year_no", "month_no") == [(2023, 2), (2024, 2)]


def test_percent_rounds_halves_up(spark):
    log = spark.createDataFrame([("ready",)] + [("other",)] * 7, "status string")  # 12.5 %
    assert rows(a.status_percent(log, ["ready"])) == [("ready", 1, 8, 13)]
    assert a.status_percent(log.where("status = 'x'"), ["ready"]).first().percent is None


@pytest.mark.parametrize(("months", "expected"), [
    ([], (None, None)),
    ([(1, 4)], ("down", 0)),
    ([(1, 4), (2, 4)], ("down", 0)),
    ([(1, 4), (2, 5)], ("up", 25)),
    ([(1, 8), (2, 100), (3, 7)], ("down", 13)),  # 12.5 is rounded up; the middle month is left out
    ([(1, 2), (3, 5)], ("up", 150)),
])
def test_growth(spark, months, expected):
    data = [("ready", T(2024, m, 15)) for m, n in months for _ in range(n)]
    log = spark.createDataFrame(data, "status string, last_activity timestamp_ntz")
    got = trends.growth(log, [180], "2024-03-31 00:00:00", ["ready"]).first()
    assert (got.direction, got.percent) == expected


def test_window_ends_are_included(spark):
    data = [("error", T(2024, 3, 1)), ("error", T(2024, 3, 31)), ("error", T(2024, 2, 29, 23, 59, 59)), ("error", T(2024, 4, 1))]
    log = spark.createDataFrame(data, "status string, last_activity timestamp_ntz")
    got = trends.window_counts(log, [30], "2024-03-31 00:00:00").groupBy().sum("amount").first()[0]
    assert got == 2


def test_bundle_agrees_with_single_statements(tables):
    bundle = trends.dashboard(tables.runs, "2024-01-31 12:00:00")
    total = a.count_all(tables.runs).first().amount
    for name in ("status", "job", "job_status", "all"):
        assert trends.series(bundle, name).agg(F.sum("amount")).first()[0] == total
    counts = trends.window_counts(tables.runs, as_of="2024-01-31 12:00:00")
    cols = ["days", "label", "month_no", "amount", "date"]
    assert rows(trends.series(bundle, "window"), *cols) == rows(counts, *cols)


def test_labels(spark):
    df = spark.createDataFrame([("ready", "5", 1), ("Ready", "0", 0), (None, "x", None)], "s string, n string, f int")
    got = rows(df.select(
        labels.status_label(F.col("s")), labels.status_colour(F.col("s")), labels.rows_affected_text(F.col("n")),
        labels.flag_text(F.col("f"))))
    assert got == sorted([
        ("Ready", "rgba(0, 166, 90, 1)", "5 Rows Were Affected.", "True"), ("Ready", "white", "", "False"),
        (None, "white", "", "False")], key=repr)


def test_pages_do_not_overlap(spark):
    df = spark.range(95).withColumnRenamed("id", "userId")
    seen = [r.userId for start in range(0, 100, 10) for r in paging.page(df, [("userId", "desc")], offset=start).collect()]
    assert seen == list(range(94, -1, -1))
    keyset, last = [], 1000
    while page := paging.page_after(df, "userId", last).collect():
        keyset += [r.userId for r in page]
        last = keyset[-1]
    assert keyset == seen


def test_null_order(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in paging.sort(df, [("x", "asc")]).collect()] == [None, 1, 2]
    assert [r.x for r in paging.sort(df, [("x", "desc")]).collect()] == [2, 1, None]
