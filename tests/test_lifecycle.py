"""Run lifecycle in batch and as a stream."""

import datetime as dt
import itertools
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runlens.operators import lifecycle as lc
from runlens.schemas import RUN_EVENTS
from runlens.streaming import lifecycle as live
from runlens.streaming import run_state

RESULT = ["instance_id", "status", "event_text", "records_total", "msg", "distict_errors", "n_begin", "ambiguous"]


def make(spark, *events):
    """Events as (minute, kind, instance[, msg])."""
    start = dt.datetime(2024, 1, 1)
    data = [
        (i, start + dt.timedelta(minutes=m), kind, inst, "DEV", "job", f"text {inst}" if kind == "begin" else None, None,
         "7" if kind == "end" else None, "7" if kind == "end" else None, (rest or [None])[0], None, None)
        for i, (m, kind, inst, *rest) in enumerate(events)
    ]
    return spark.createDataFrame([(*r, None, None) for r in data], RUN_EVENTS)


def both(spark, *events):
    """The batch fold, after the stream of two files has given the same."""
    df = make(spark, *events)
    batch = rows(lc.fold_runs(df), *RESULT)
    assert streamed(spark, [df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1")]) == batch
    return batch


def streamed(spark, files, **options):
    """The current runs after a stream of one file a micro-batch."""
    path = tempfile.mkdtemp(prefix="runs-", dir="/tmp")
    return rows(run_state.current_runs(spark, follow(spark, path, files, **options)), *RESULT)


def follow(spark, path, files, **options):
    for df in files:
        df.coalesce(1).write.mode("append").parquet(f"{path}/log")
    events = live.read_events(spark, f"{path}/log", RUN_EVENTS, files_per_batch=1)
    live.start_available(run_state.run_changes(events, **options), run_state.tables_writer(path), f"{path}/state", "update").awaitTermination()
    return path


def test_begin_only(spark):
    assert both(spark, (0, "begin", "A")) == [("A", "running", "text A", "0", None, None, 1, False)]


def test_end_and_error_in_any_order(spark):
    got = both(spark, (0, "begin", "A"), (1, "end", "A", "ok"), (0, "begin", "B"), (1, "error", "B", "bad"),
               (0, "begin", "C"), (1, "error", "C", "bad"), (2, "end", "C", "late"),
               (0, "begin", "D"), (1, "end", "D", "ok"), (2, "error", "D", "bad"))
    assert got == [
        ("A", "ready", "text A", "7", "ok", None, 1, False),
        ("B", "error", "Error(s) Found", "0", None, 1, 1, False),
        ("C", "ready", "Error(s) Found", "7", "late", 1, 1, False),
        ("D", "error", "Error(s) Found", "7", "ok", 1, 1, False),
    ]


def test_update_without_begin_does_nothing(spark):
    assert both(spark, (1, "end", "A"), (2, "error", "A")) == []


def test_update_before_begin_does_nothing(spark):
    assert both(spark, (0, "end", "A", "early"), (1, "begin", "A")) == [("A", "running", "text A", "0", None, None, 1, False)]


def test_second_begin_stops_updates(spark):
    got = both(spark, (0, "begin", "A"), (1, "end", "A", "first"), (2, "begin", "A"), (3, "error", "A", "lost"))
    assert got == [
        ("A", "ready", "text A", "7", "first", None, 2, True),
        ("A", "running", "text A", "0", None, None, 2, True),
    ]


def test_equal_times_are_ordered_by_id(spark):
    assert both(spark, (0, "begin", "A"), (0, "end", "A", "x"))[0][1] == "ready"


def brute_force(events):
    """The three statements one after another, on a list of rows."""
    table = []
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        if e.kind == "begin":
            table.append({"instance_id": e.instance_id, "status": "running", "event_text": e.event_text, "records_total": "0", "msg": None, "distict_errors": None})
            continue
        match = [r for r in table if r["instance_id"] == e.instance_id]
        if len(match) == 1:
            match[0].update({"status": "ready", "records_total": e.records_total, "msg": e.msg} if e.kind == "end"
                            else {"status": "error", "event_text": "Error(s) Found", "distict_errors": 1})
    return sorted((tuple(r[c] for c in RESULT[:6]) for r in table), key=repr)


def test_exact_fold_equals_brute_force(spark):
    kinds = ["begin", "end", "error"]
    events = []
    for n, combo in enumerate(itertools.product(kinds, repeat=4)):
        events += [(m, kind, f"I{n:02}", f"m{m}") for m, kind in enumerate(combo)]
    df = make(spark, *events)
    assert rows(lc.fold_runs(df), *RESULT[:6]) == brute_force(df.collect())


def test_stuck_runs(spark):
    data = [(1, "running", dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 11, 59)),
            (2, "RUNNING", dt.datetime(2024, 1, 1, 11, 30), dt.datetime(2024, 1, 1, 11, 30)),
            (3, "ready", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(data, "id int, status string, start_time timestamp_ntz, last_activity timestamp_ntz")
    assert [r.id for r in lc.stuck_runs(df, "absolute", 60, "2024-01-01 12:00:00").collect()] == [1]
    assert [r.id for r in lc.stuck_runs(df, "no_activity", 120, "2024-01-01 12:00:00").collect()] == [2]


def late_files(df, n, seed):
    """Events dealt to ``n`` files without regard to their time."""
    return [df.where(F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(n)) == i) for i in range(n)]


def random_events(spark, seed, keys=40, kinds=("begin", "end", "error", "end")):
    rng = random.Random(seed)
    return make(spark, *[(rng.randrange(0, 3000), rng.choice(kinds), f"I{rng.randrange(keys)}", f"m{i}") for i in range(keys * 5)])


@pytest.mark.parametrize("seed", [1, 2])
def test_late_files_are_repaired_from_the_log(spark, tmp_path, seed):
    """Events of all times in every file, begins repeated: nothing is lost, and the repaired table equals the batch fold."""
    df = random_events(spark, seed).withColumn("environment", F.when(F.col("event_id") % 2 == 0, "DEV").otherwise("dev"))
    path = follow(spark, str(tmp_path), late_files(df, 4, seed))
    assert spark.read.parquet(f"{path}/late").count() > 0
    repaired = run_state.repair(spark, path, df)
    assert rows(repaired, *RESULT) == rows(lc.fold_runs(df), *RESULT)


@pytest.mark.parametrize("seed", [3])
def test_single_begins_need_no_repair(spark, tmp_path, seed):
    """Updates in late files are exact, counters follow, errors are settled, and stuck runs are taken back."""
    starts = [(m, "begin", f"I{m}") for m in range(40)]
    rng = random.Random(seed)
    updates = [(rng.randrange(60, 2500), rng.choice(["end", "error"]), f"I{rng.randrange(40)}", f"m{i}") for i in range(60)]
    df = make(spark, *starts, *updates, (4000, "begin", "last"))
    files = late_files(df.where("kind = 'begin' and instance_id <> 'last'"), 1, 0) + late_files(df.where("kind <> 'begin'"), 3, seed) + [df.where("instance_id = 'last'")]
    path = follow(spark, str(tmp_path), files, stuck_seconds=3600)
    batch = lc.fold_runs(df)
    assert rows(run_state.current_runs(spark, path), *RESULT) == rows(batch, *RESULT)
    assert rows(run_state.status_counts(spark, path)) == rows(batch.groupBy("status").count())
    days = batch.groupBy(F.to_date("last_activity").alias("day"), "status").count()
    assert rows(run_state.status_counts(spark, path, "day")) == rows(days)
    assert rows(run_state.open_stuck(spark, path), "instance_id") == rows(batch.where("status = 'running' and instance_id <> 'last'"), "instance_id")
    assert spark.read.parquet(f"{path}/stuck").where("not open").count() > 0
    assert rows(spark.read.parquet(f"{path}/errors"), "tmf_id", "message", "code") == rows(lc.error_rows(df), "tmf_id", "message", "code")
    run_state.compact_counts(spark, path, str(tmp_path / "small/counts"))
    assert rows(run_state.status_counts(spark, str(tmp_path / "small"))) == rows(batch.groupBy("status").count())


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = follow(spark, str(tmp_path), [make(spark, (0, "begin", "A"), (1, "end", "A", "x"), (0, "begin", "B"))])
    counts, runs = rows(run_state.status_counts(spark, path)), rows(run_state.current_runs(spark, path), *RESULT)
    first = run_state.view([(0, 1, "A", "DEV", "job", "t", None)], [], False)[0]
    again = spark.createDataFrame([run_state.change("run", first, was="running", was_us=0)], run_state.CHANGES)
    for _ in range(2):
        run_state.tables_writer(path)(again, 99)
    assert sum(n for _, n in rows(run_state.status_counts(spark, path))) == 2 and counts == [("ready", 1), ("running", 1)]
    assert len(run_state.current_runs(spark, path).collect()) == len(runs) + 1


def test_keys_that_have_left_the_state(spark, tmp_path):
    """A finished key leaves after a while; an update for it then goes to the side table and the log decides."""
    files = [make(spark, (0, "begin", "A"), (1, "end", "A", "x")), make(spark, (5000, "begin", "B")), make(spark, (9000, "begin", "C"))]
    ids = [df.withColumn("event_id", F.col("event_id") + 10 * i) for i, df in enumerate(files)]
    late = make(spark, (2, "error", "A", "bad")).withColumn("event_id", F.lit(77).cast("long"))
    path = follow(spark, str(tmp_path), [*ids, late], keep_minutes=60)
    assert [r.instance_id for r in spark.read.parquet(f"{path}/late").collect()] == ["A"]
    log = ids[0].unionByName(ids[1]).unionByName(ids[2]).unionByName(late)
    assert rows(run_state.repair(spark, path, log), *RESULT) == rows(lc.fold_runs(log), *RESULT)


def test_keys_meet_without_regard_to_case_and_null_keys_meet_nothing(spark):
    df = make(spark, (0, "begin", "a"), (1, "end", "A", "x"), (0, "begin", "N"), (1, "end", "N", "x"))
    df = df.withColumn("job_name", F.when(F.col("instance_id") != "N", F.col("job_name")))
    want = [("N", "running", None), ("N2", "running", None), ("a", "ready", "x")]
    more = df.where("instance_id = 'N' and kind = 'begin'").withColumn("instance_id", F.lit("N2")).withColumn("event_id", F.lit(50).cast("long"))
    df = df.withColumn("job_name", F.when(F.col("instance_id") == "N", None).otherwise(F.lit("job"))).unionByName(more)
    got = rows(lc.fold_runs(df), "instance_id", "status", "msg")
    assert got == want and [r[:2] + (r[4],) for r in streamed(spark, [df])] == want


def test_day_counts_keep_late_rows(spark, tmp_path):
    df = make(spark, *[(m * 400, "begin", f"I{m}") for m in range(30)])
    path = str(tmp_path)
    for part in (df.where("event_id >= 10"), df.where("event_id < 10")):
        part.coalesce(1).write.mode("append").parquet(f"{path}/log")
    events = live.read_events(spark, f"{path}/log", RUN_EVENTS, files_per_batch=1)
    live.start_available(events, live.day_counts_writer(f"{path}/days"), f"{path}/state").awaitTermination()
    assert rows(live.day_counts(spark, f"{path}/days"), "day", "kind", "amount") == rows(df.groupBy(F.to_date("ts").alias("day"), "kind").count())
    assert live.day_counts(spark, f"{path}/days").agg(F.sum("late")).first()[0] == 10


def test_repeated_batch_replaces_itself(spark, tmp_path):
    write = live.batch_writer(str(tmp_path / "t"))
    df = spark.range(10)
    write(df, 0), write(df, 1), write(df, 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20


def test_notifications_leave_out_jobs_without_template(spark):
    runs = spark.createDataFrame([(1, "Ready", "a"), (2, "Cancelled", "a"), (3, "running", "a"), (4, "error", "b")], "id int, status string, job_name string")
    jobs = spark.createDataFrame([("a", "ok", "0", "stop"), ("b", "ok", None, "0")], "job_name string, on_success string, on_failure string, on_abort string")
    mails = spark.createDataFrame([("ok", "x@y.z", "f@y.z", "", "s", "m", "S"), ("stop", "x@y.z", "f@y.z", "c@y.z,d@y.z", "s", "m", "S")],
                                  "name string, `to` string, `from` string, cc string, subject string, msg string, smtp string")
    smtp = spark.createDataFrame([("S", "h", 25)], "name string, smtp_host string, smtp_port int")
    got = lc.notifications(runs, jobs, mails, smtp)
    assert rows(got, "id", "outcome", "recipients") == [(1, "success", "x@y.z"), (2, "abort", "x@y.z, cc:c@y.z, cc:d@y.z")]
