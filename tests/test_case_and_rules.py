"""Text without regard to case in groups and keys, validation rules, text steps, stream writers."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runlens.functions import text as tx
from runlens.operators import aggregates as a
from runlens.operators import builds, changes, joins, lifecycle, predicates, validation
from runlens.schemas import RUN_EVENTS
from runlens.streaming import lifecycle as live


@pytest.fixture(scope="module")
def mixed(spark):
    data = [("Ready", "Job", "d"), ("ready", "JOB", "D"), ("READY", "other", None), ("error", "job", "d"), (None, "x", None)]
    return spark.createDataFrame(data, "status string, job_name string, dimension string")


def test_groups(mixed):
    assert rows(a.runs_by_status(mixed)) == sorted([("READY", 3), ("error", 1), (None, 0)], key=repr)
    assert ("JOB", "D", 3) in rows(a.runs_by_job(mixed))
    assert ("JOB", "D", "Ready", 2) in rows(a.runs_by_job_status(mixed))
    assert a.group_count(mixed, "status").first().amount == 3
    assert rows(a.distinct_rows(mixed, ["job_name"])) == sorted([("JOB",), ("other",), ("x",)])
    assert ("status", "READY", 3) in rows(a.distinct_values(mixed, ["status", "dimension"]))


def test_both_forms_of_in_agree(spark, mixed):
    wanted = spark.createDataFrame([("rEADY",), ("READY",)], "s string")
    assert predicates.where_in(mixed, "status", wanted).count() == predicates.where_in(mixed, "status", ["ready"]).count() == 3


def test_changes_by_text_key(spark):
    table = spark.createDataFrame([("a", 1), ("B", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("A", 7, 1), ("a", 8, 2), ("c", 9, 1)], "k string, v int, n int")
    assert rows(changes.update_by_key(table, new, ["k"], "n")) == sorted([("a", 8), ("B", 2), (None, 3)], key=repr)
    assert rows(joins.new_rows(new, table, ["k"], "n"), "k", "v") == [("c", 9)]
    assert rows(changes.delete_rows(table, keys=new.select("k"))) == sorted([("B", 2), (None, 3)], key=repr)
    assert rows(changes.increment(table, new, ["k"], "v"), "k", "v") == sorted([("a", 3), ("B", 2), (None, 3)], key=repr)


def test_builds_without_an_end(spark):
    df = spark.createDataFrame([("j", n, 0, 0, "SUCCESS") for n in range(1, 30)], "job string, number long, timestamp long, duration long, result string")
    assert builds.build_range(df, block=7).count() == 29
    assert builds.build_range(df, lo=27, block=7).count() == 2


def event(i, kind, key="I1"):
    return (i, None, kind, key, "DEV", "j", None, None, None, None, f"m{i}", "o", i, None, None)


def test_errors_without_exactly_one_run_are_rolled_back(spark):
    events = [event(1, "error"), event(2, "begin"), event(3, "error"), event(4, "end"), event(5, "begin"), event(6, "error"), event(7, "error", "I2")]
    df = spark.createDataFrame(events, RUN_EVENTS).withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    assert rows(lifecycle.error_rows(df), "message") == [("m3",)]


@pytest.mark.parametrize(("rule", "value", "ok"), [
    ("required", "\t\n", False), ("required", " x", True), ("alpha", "abc\n", False), ("alpha_numeric", "a1\n", False), ("natural", "12\n", False),
    (("greater_than", 1), "5d", False), (("greater_than", 1), "Infinity", False), (("less_than", 9), "NaN", False), (("less_than", 9), "-2.5", True),
])
def test_rules(spark, rule, value, ok):
    df = spark.createDataFrame([(1, value)], "id int, v string")
    assert validation.violations(validation.check_rows(df, {"v": [rule]}, "id"), "id").isEmpty() == ok


def test_unique_without_regard_to_case(spark):
    df = spark.createDataFrame([(1, "Ab"), (2, "aB"), (3, "c")], "id int, v string")
    checked = validation.check_rows(df, {"v": [("is_unique",)]}, "id")
    assert [r.id for r in validation.violations(checked, "id").collect()] == [2]


def test_text_steps(spark):
    df = spark.createDataFrame([("a < b, c > d <b>e</b>",)], "t string")
    assert df.select(tx.strip_tags(F.col("t"))).first()[0] == "a < b, c > d e"
    words = spark.createDataFrame([("tions ütion tion, x",)], "t string")
    assert words.select(tx.censor_words(F.col("t"), ["tion*"])).first()[0] == "##### ütion ####, x"
    assert words.select(tx.word_limit(F.col("t"), 2, "~")).first()[0] == "tions ütion~"


def test_upsert_keeps_one_row_a_key(spark, tmp_path):
    path = str(tmp_path / "table")
    write = live.upsert_writer(path, ["k"], buckets=3)
    first = spark.createDataFrame([(str(i), i) for i in range(20)], "k string, v int")
    later = spark.createDataFrame([("3", 33), ("99", 99)], "k string, v int")
    for batch, number in ((first, 0), (later, 1), (later, 1), (later.limit(0), 2)):
        write(batch, number)
    got = dict(spark.read.parquet(path).select("k", "v").collect())
    assert got == {**{str(i): i for i in range(20)}, "3": 33, "99": 99}


def test_damaged_log_is_an_error(spark, tmp_path):
    assert live.read_batches(spark, str(tmp_path / "none"), "k string").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        live.read_batches(spark, str(tmp_path / "bad"), "k string").count()
