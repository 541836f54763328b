"""The lifecycle stream as tables folded by every micro-batch: same results as the batch fold and the keyed operator, at the cost of its rows."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runlens.operators import lifecycle as lc
from runlens.schemas import RUN_EVENTS
from runlens.streaming import lifecycle as live
from runlens.streaming import run_fold, run_state
from test_lifecycle import RESULT, late_files, make, random_events


def follow(spark, path, files, **options):
    """(path, query) after a stream of one file a micro-batch."""
    for df in files:
        df.coalesce(1).write.mode("append").parquet(f"{path}/log")
    events = live.read_events(spark, f"{path}/log", RUN_EVENTS, files_per_batch=1)
    query = live.start_available(events, run_fold.tables_writer(path, **options), f"{path}/state")
    query.awaitTermination()
    return path, query


@pytest.mark.parametrize("seed", [1, 2])
def test_late_files_are_repaired_from_the_log(spark, tmp_path, seed):
    df = random_events(spark, seed).withColumn("environment", F.when(F.col("event_id") % 2 == 0, "DEV").otherwise("dev"))
    path, query = follow(spark, str(tmp_path), late_files(df, 4, seed))
    # a batch a file, none without rows, and no store that Python keeps
    assert not query.lastProgress.stateOperators and query.lastProgress.batchId == 3
    assert spark.read.parquet(f"{path}/late").count() > 0
    repaired = run_state.repair(spark, path, df, run_fold.current_runs(spark, path))
    assert rows(repaired, *RESULT) == rows(lc.fold_runs(df), *RESULT)


def test_single_begins_need_no_repair(spark, tmp_path):
    starts = [(m, "begin", f"I{m}") for m in range(40)]
    updates = [(60 + 37 * i, ("end", "error")[i * i % 3 % 2], f"I{i * 7 % 33}", f"m{i}") for i in range(60)]
    df = make(spark, *starts, *updates, (4000, "begin", "last"))
    files = [df.where("kind = 'begin' and instance_id <> 'last'"), *late_files(df.where("kind <> 'begin'"), 3, 3), df.where("instance_id = 'last'")]
    path, _ = follow(spark, str(tmp_path), files)
    batch = lc.fold_runs(df)
    assert rows(run_fold.current_runs(spark, path), *RESULT) == rows(batch, *RESULT)
    assert rows(run_state.status_counts(spark, path)) == rows(batch.groupBy("status").count())
    days = batch.groupBy(F.to_date("last_activity").alias("day"), "status").count()
    assert rows(run_state.status_counts(spark, path, "day")) == rows(days)
    assert rows(run_state.open_stuck(spark, path), "instance_id") == rows(batch.where("status = 'running' and instance_id <> 'last'"), "instance_id")
    assert spark.read.parquet(f"{path}/stuck").where("not open").count() > 0
    assert rows(run_fold.error_rows(spark, path), "tmf_id", "message", "code") == rows(lc.error_rows(df), "tmf_id", "message", "code")


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path, write = str(tmp_path), run_fold.tables_writer(str(tmp_path))
    parts = late_files(random_events(spark, 4), 3, 4)
    state = lambda: [rows(run_fold.current_runs(spark, path)), rows(run_state.status_counts(spark, path)), rows(run_state.open_stuck(spark, path)), rows(run_fold.error_rows(spark, path))]
    for i, part in enumerate(parts):
        write(part, i)
        once = state()
        write(part, i)
        assert state() == once


def test_keys_leave_what_is_held_and_the_log_decides(spark, tmp_path):
    files = [make(spark, (0, "begin", "A"), (1, "end", "A", "x")), make(spark, (5000, "begin", "B")), make(spark, (9000, "begin", "C"))]
    ids = [df.withColumn("event_id", F.col("event_id") + 10 * i) for i, df in enumerate(files)]
    late = make(spark, (2, "error", "A", "bad")).withColumn("event_id", F.lit(77).cast("long"))
    path, _ = follow(spark, str(tmp_path), [*ids, late], keep_minutes=60)
    assert [r.instance_id for r in spark.read.parquet(f"{path}/late").collect()] == ["A"]
    # the finished run is kept, though not among the rows that later batches read
    assert [r.instance_id for r in spark.read.parquet(f"{path}/done").collect()] == ["A"]
    assert rows(run_fold.current_runs(spark, path), "instance_id", "status") == [("A", "ready"), ("B", "running"), ("C", "running")]
    log = ids[0].unionByName(ids[1]).unionByName(ids[2]).unionByName(late)
    assert rows(run_state.repair(spark, path, log, run_fold.current_runs(spark, path)), *RESULT) == rows(lc.fold_runs(log), *RESULT)


def test_settled_updates_are_not_held(spark, tmp_path):
    """Of many updates of one run only the last end and the last error go on."""
    path, write = str(tmp_path), run_fold.tables_writer(str(tmp_path))
    many = make(spark, (0, "begin", "A"), *[(i, ("end", "error")[i % 2], "A", f"m{i}") for i in range(1, 100)])
    write(many, 0)
    for i in (1, 2):
        write(make(spark, (1000 * i, "begin", f"B{i}")).withColumn("event_id", F.lit(1000 + i).cast("long")), i)
    held = spark.read.parquet(f"{path}/live-0").where("keep and not gone")
    assert rows(held.where("instance_id = 'A'"), "kind", "msg") == [("begin", None), ("end", "m98"), ("error", "m99")]
    assert rows(run_fold.error_rows(spark, path), "message") == rows(many.where("kind = 'error'"), "msg")
    assert rows(run_fold.current_runs(spark, path).where("instance_id = 'A'"), "status", "msg") == [("error", "m98")]


def test_null_keys_meet_nothing(spark, tmp_path):
    df = make(spark, (0, "begin", "N"), (1, "end", "N", "x"), (0, "begin", "a"), (1, "end", "A", "x"))
    df = df.withColumn("job_name", F.when(F.col("instance_id") != "N", F.col("job_name")))
    more = df.where("event_id = 0").withColumn("event_id", F.lit(50).cast("long"))
    path, _ = follow(spark, str(tmp_path), [df.unionByName(more)])
    got = rows(run_fold.current_runs(spark, path), "instance_id", "status", "msg", "n_begin")
    assert got == [("N", "running", None, 1), ("N", "running", None, 1), ("a", "ready", "x", 1)]


def test_before_the_first_batch_all_is_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    assert not rows(run_fold.current_runs(spark, path)) and not rows(run_fold.changed_runs(spark, path)) and not rows(run_fold.error_rows(spark, path))


def test_a_batch_without_rows_keeps_what_is_held(spark, tmp_path):
    path, write = str(tmp_path), run_fold.tables_writer(str(tmp_path))
    for i, batch in enumerate([make(spark).limit(0), make(spark, (0, "begin", "A")), make(spark).limit(0)]):
        write(batch, i)
    assert rows(run_fold.current_runs(spark, path), "instance_id", "status") == [("A", "running")]
