"""What the lifecycle stream costs beside its rows: calls to the state store, state partitions, files."""

import json
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from conftest import rows
from runlens.operators import lifecycle as lc
from runlens.streaming import lifecycle as live
from runlens.streaming import run_state
from test_lifecycle import RESULT, follow, late_files, random_events


class Store:
    """A value of the state store and its timers, with the number of calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def event(i, kind, us):
    names = {f"_{k}": f"{k} {i}".upper() for k in lc.RUN_KEY} | {k: f"{k} {i}" for k in lc.RUN_KEY}
    return json.dumps({**dict.fromkeys([*run_state.TEXTS, *run_state.UPDATE]), **names, "kind": kind, "us": us, "event_id": us})


def test_calls_to_the_state_store_go_by_group_and_not_by_key():
    store, keeper = Store(), run_state.RunKeeper(stuck_seconds=1, keep_minutes=1)
    keeper.init(store)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)

    def take(events, ms):
        out = pd.concat(keeper.handleInputRows((0,), iter([pd.DataFrame({"event": events})]), at(ms)))
        return list(out["what"])

    def expire(ms):
        due = min(t for t in store.timers if t <= ms)
        out = pd.concat(keeper.handleExpiredTimer((0,), at(ms), SimpleNamespace(getExpiryTimeInMs=lambda: due)))
        store.timers.remove(due)  # as Spark does afterwards
        return sorted(zip(out["what"], out["open"]), key=repr)

    assert take([event(i, "begin", 1_000_000 + i) for i in range(1000)], 0) == ["run"] * 1000 and store.calls <= 3
    # one timer for the group, which reports all runs that are due by then
    assert len(store.timers) == 1 and expire(2_002) == [("stuck", True)] * 1000
    assert sorted(take([event(i, "end", 3_000_000 + i) for i in range(1000)], 2_002)) == ["run"] * 1000 + ["stuck"] * 1000
    assert len(store.timers) == 1 and store.calls < 20
    # all leave at last, and with them the value and the timer
    while store.timers:
        assert expire(100_000) == []
    assert store.value is None


def test_state_partitions_follow_the_cores_and_a_day_and_bucket_is_one_file(spark, tmp_path):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    df = random_events(spark, 5)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        path = follow(spark, str(tmp_path), late_files(df, 2, 5))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert len([p for p in (tmp_path / "state/state/0").iterdir() if p.name.isdigit()]) == 2 * spark.sparkContext.defaultParallelism
    for part in (tmp_path / "runs").glob("start_day=*/bucket=*"):
        assert len(list(part.glob("*.parquet"))) == 1
    assert rows(run_state.repair(spark, path, df), *RESULT) == rows(lc.fold_runs(df), *RESULT)


def test_absent_rows_of_a_bucket_are_one_file(spark, tmp_path):
    df = spark.range(0, 400, 1, 8).select((F.col("id") % 100).alias("k"), F.col("id").alias("ts"))
    live.absent_writer(str(tmp_path), ["k"], buckets=4)(df, 0)
    assert sorted(len(list(p.glob("*.parquet"))) for p in tmp_path.glob("bucket=*/batch_id=0")) == [1] * 4
    assert spark.read.parquet(str(tmp_path)).count() == 100


def test_new_events_settle_what_is_due_and_a_change_is_one_text():
    store, keeper = Store(), run_state.RunKeeper(stuck_seconds=1, keep_minutes=1)
    keeper.init(store)
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 5_000)
    out = pd.concat(keeper.handleInputRows((0,), iter([pd.DataFrame({"event": [event(1, "begin", 1_000_000)]})]), at))
    # no timer is left that would read and write the group again in the same micro-batch
    assert list(out["what"]) == ["late", "run", "stuck"] and not store.timers
    assert list(out.columns) == ["what", "open", "change"]
    assert json.loads(out["change"].iloc[2])["open"] is True
