"""The lifecycle as a keyed stateful operator: runs, stuck runs and counters from a stream of events.

``run_changes`` keeps for each run key (text without regard to case) its begins and the updates that may
still matter; keys are dealt to groups by a hash, and a group's state is read and written at once. Every micro-batch emits the run rows that it changed, each with the status it had before,
so counters are kept by adding and taking away, without counting runs again. Timers report runs that are
still running after a limit, and take the report back when such a run ends. An error row is emitted once
the watermark has passed its event, when it is settled which run takes it.

The watermark lies on a column of its own that is dropped before the operator, so Spark discards no late
event; the operator sees all of them. A late update is applied exactly as long as its key has state. A late
begin, and a late update whose key has none, are also emitted as ``late``: they go to a side table, and
``repair`` folds their keys again from the log. A key leaves the state ``keep_minutes`` after its
last event if its only run is over; a begin that uses the same key after that is a new run.

``tables_writer`` keeps five tables: ``runs`` (one row per key and begin), ``counts`` (changes per status, day of last
activity and batch), ``errors``, ``stuck`` and ``late``. A batch that runs again writes the same rows to the same places.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.text import text_key
from ..operators.changes import replace_rows
from ..operators.lifecycle import ERROR, ERROR_TEXT, ERROR_TYPE, READY, RUN_KEY, RUNNING, fold_runs, notifications
from ..operators.skew import join_on_unique
from ..session import cut, workers_find_package
from .lifecycle import absent_writer, at_once, batch_writer, read_batches, read_table, upsert_writer

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEXTS = ["instance_id", "environment", "job_name", "event_text", "dimension"]
# A begin is (us, event_id, *TEXTS), an update (*UPDATE, whether its error row has been emitted).
UPDATE = ["us", "event_id", "kind", "records_total", "records_processed", "msg", "instance_id", "job_name", "origin", "code"]
FOLDED = [f"_{k}" for k in RUN_KEY]
KIND, TOLD = 2, 10  # places in an update
STATE = "keys string, timer bigint"
GROUPS = 256  # of run keys, by a hash; fixed as long as a stream keeps its checkpoint

#: ``what``: run (a changed row), error (a row of the error table), stuck (``open``: whether it still is) or late (an event for the side table).
CHANGES = (
    "what string, instance_id string, environment string, job_name string, status string, was string, was_us bigint, event_text string, "
    "dimension string, records_total string, records_processed string, start_us bigint, begin_id bigint, last_us bigint, "
    "msg string, distict_errors int, warnings string, n_begin bigint, open boolean, kind string, origin string, code int"
)
FIELDS = [f.split()[0] for f in CHANGES.split(", ")]
#: How a change leaves the operator: a frame of a group costs by its columns, whatever its rows.
SAID = "what string, open boolean, change string"
TEXT = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
RUN_FIELDS = [f for f in FIELDS if f not in ("what", "was", "was_us", "open", "kind", "origin", "code")]


def view(begins: list, updates: list, keyless: bool) -> list[dict[str, Any]]:
    """The run rows of one key, by begin. Updates count for the first run, up to the second begin."""
    if len(begins) > 1:
        begins = sorted(begins, key=lambda b: (b[0], b[1]))
    rows = [
        {
            **dict(zip(TEXTS, b[2:])), "status": RUNNING, "records_total": "0", "records_processed": "0", "start_us": b[0], "begin_id": b[1],
            "last_us": b[0], "msg": None, "distict_errors": None, "warnings": None, "n_begin": 1 if keyless else len(begins),
        }
        for b in begins
    ]
    for u in [] if keyless else reaching(begins, updates):
        rows[0]["last_us"] = max(rows[0]["last_us"], u[0])
        if u[KIND] == "end":
            rows[0].update(status=READY, records_total=u[3], records_processed=u[4], msg=u[5])
        else:
            rows[0].update(status=ERROR, event_text=ERROR_TEXT, distict_errors=1, warnings="0")
    return rows


def reaching(begins: list, updates: list) -> list:
    """Updates between the first and the second begin, in order."""
    if not begins or not updates:
        return []
    if len(begins) == 1 and len(updates) == 1:
        return updates if updates[0][:2] > begins[0][:2] else []
    ends = sorted((b[0], b[1]) for b in begins)[:2]
    return sorted((u for u in updates if (u[0], u[1]) > ends[0] and (len(ends) < 2 or (u[0], u[1]) < ends[1])), key=lambda u: (u[0], u[1]))


def settled(begins: list, updates: list, watermark: int) -> list:
    """The updates worth keeping: all beyond the watermark, and of the others the last end and the last error that
    reach the first run."""
    if not begins or all(u[0] > watermark for u in updates):
        return updates
    old = [u for u in reaching(begins, updates) if u[0] <= watermark]
    last = {u[KIND]: u for u in old}
    return [u for u in updates if u[0] > watermark] + list(last.values())


def seen(begins: list, updates: list) -> int:
    return max([e[0] for e in (*begins, *updates)], default=0)


def told(begins: list, updates: list, watermark: int) -> tuple[list[dict], list]:
    """Error rows that are certain now, and the updates with these marked."""
    if all(u[KIND] != "error" or u[TOLD] or u[0] > watermark for u in updates):
        return [], updates
    ready = {u[:2] for u in reaching(begins, updates) if u[KIND] == "error" and u[0] <= watermark and not u[TOLD]}
    names = ["start_us", "begin_id", *UPDATE[2:]]
    rows = [values("error", dict(zip(names, u))) for u in updates if u[:2] in ready]
    return rows, [(*u[:TOLD], True) if u[:2] in ready else u for u in updates]


class RunKeeper(StatefulProcessor):
    """State of the run keys of one group, with one timer for what becomes due first (milliseconds of event time).

    A call to the state store costs about a millisecond from Python, so it is made per group and micro-batch and
    not per key: the keys of a group are one value, ``[[key, begins, updates, stuck, due], ...]`` as JSON text. For the
    same reason an event comes as one JSON text, and the changes of a group leave as one frame of three columns, the
    row as JSON text. A group with new events also settles what is due by the watermark, so its timer needn't
    read and write it again in that micro-batch."""

    def __init__(self, stuck_seconds: int, keep_minutes: int):
        self.limit, self.keep = stuck_seconds * 1_000_000, keep_minutes * 60_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", STATE)

    def _held(self) -> tuple[dict[tuple, tuple], int | None]:
        """What is known of each key, and the timer that is set."""
        found = self.state.get()
        if found is None:
            return {}, None
        return {
            tuple(key): ([tuple(b) for b in begins], [tuple(u) for u in updates], stuck, due)
            for key, begins, updates, stuck, due in json.loads(found[0])
        }, found[1]

    def _hold(self, held: dict[tuple, tuple], timer: int | None, fired: int | None = None) -> None:
        """Store the state and set the timer for the key that becomes due first."""
        due = min((k[3] for k in held.values() if k[3] is not None), default=None)
        if timer is not None and timer not in (due, fired):
            self.handle.deleteTimer(timer)
        if due is not None and (due != timer or due == fired):
            self.handle.registerTimer(due)
        if held:
            self.state.update((TEXT([[key, *kept] for key, kept in held.items()]), due))
        else:
            self.state.clear()

    def _kept(self, begins: list, updates: list, stuck: list, rows: list, now: int) -> tuple:
        """What is stored of a key, and the earliest moment at which something of it may become due."""
        updates = settled(begins, updates, now)
        due = [r["start_us"] + self.limit for r in rows if r["status"] == RUNNING and r["begin_id"] not in stuck]
        due += [u[0] for u in reaching(begins, updates) if u[KIND] == "error" and not u[TOLD]]
        if self._over(rows):
            due.append(seen(begins, updates) + self.keep)
        return begins, updates, stuck, min(due) // 1000 + 1 if due else None

    @staticmethod
    def _over(rows: list) -> bool:
        return not rows or len(rows) == 1 and rows[0]["status"] != RUNNING

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        watermark = 1000 * timerValues.getCurrentWatermarkInMs()
        came: dict[tuple, list] = {}
        for frame in rows:
            for r in map(json.loads, frame["event"]):
                came.setdefault(tuple(map(r.get, FOLDED)), []).append(r)
        changes = [c for name, events in came.items() for c in self._take(held, name, events, watermark)]
        changes += self._settle(held, timerValues.getCurrentWatermarkInMs())
        self._hold(held, timer)
        yield frame_of(changes)

    def _take(self, held: dict, name: tuple, events: list, watermark: int) -> Iterator[dict]:
        """The new events of one key."""
        begins, updates, stuck, _ = held.get(name, ([], [], [], None))
        keyless = any(k is None for k in name)
        before = {r["begin_id"]: r for r in view(begins, updates, keyless)}
        had = bool(begins)
        for r in events:
            if r["us"] < watermark and (r["kind"] == "begin" or not had):
                yield values("late", {**{k: r.get(k) for k in RUN_KEY}, "start_us": r["us"], "begin_id": r["event_id"], "kind": r["kind"]})
            if r["kind"] == "begin":
                begins.append((r["us"], r["event_id"], *map(r.get, TEXTS)))
            elif not keyless:
                updates.append((*map(r.get, UPDATE), False))
        now = view(begins, updates, keyless)
        for row in now:
            old = before.get(row["begin_id"])
            if row != old:
                yield values("run", row, was=old and old["status"], was_us=old and old["last_us"])
            if row["begin_id"] in stuck and row["status"] != RUNNING:
                stuck.remove(row["begin_id"])
                yield values("stuck", row, open=False)
        errors, updates = told(begins, updates, watermark)
        yield from errors
        held[name] = self._kept(begins, updates, stuck, now, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        changes = self._settle(held, timerValues.getCurrentWatermarkInMs())
        self._hold(held, timer, expiredTimerInfo.getExpiryTimeInMs())
        yield frame_of(changes)

    def _settle(self, held: dict, now: int) -> list[dict]:
        """What has become due of all keys."""
        names = [name for name, kept in held.items() if kept[3] is not None and kept[3] <= now]
        return [c for name in names for c in self._expire(held, name, 1000 * now)]

    def _expire(self, held: dict, name: tuple, now: int) -> Iterator[dict]:
        """What has become due of one key."""
        begins, updates, stuck, _ = held[name]
        rows = view(begins, updates, any(k is None for k in name))
        due = [r for r in rows if r["status"] == RUNNING and r["start_us"] + self.limit < now and r["begin_id"] not in stuck]
        yield from (values("stuck", r, open=True) for r in due)
        errors, updates = told(begins, updates, now)
        yield from errors
        if self._over(rows) and seen(begins, updates) + self.keep < now:
            del held[name]
        else:
            held[name] = self._kept(begins, updates, stuck + [r["begin_id"] for r in due], rows, now)

    def close(self) -> None:
        pass


def values(what: str, row: dict[str, Any], **more: Any) -> dict[str, Any]:
    return {**row, "what": what, **more}


def change(what: str, row: dict[str, Any], **more: Any) -> Row:
    found = values(what, row, **more)
    return Row(**{f: found.get(f) for f in FIELDS})


def frame_of(changes: Iterable[dict[str, Any]]) -> pd.DataFrame:
    # as objects, so that a null makes no floating-point number of its column
    rows = [(c["what"], c.get("open"), TEXT(c)) for c in changes]
    return pd.DataFrame(rows, columns=["what", "open", "change"], dtype=object)


def run_changes(events: DataFrame, stuck_seconds: int = 3600, delay: str = "10 minutes", keep_minutes: int = 7 * 24 * 60) -> DataFrame:
    """Changes of run rows, stuck runs and late events (see ``CHANGES``) from a stream of events, output mode ``update``. Events without a time are left out."""
    workers_find_package(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = events.where("ts is not null").withColumn("mark", F.col("ts")).withWatermark("mark", delay)
    folded = [text_key(events, k).alias(f"_{k}") for k in RUN_KEY]
    texts = [c for c in TEXTS if c not in UPDATE]  # with the environment
    event = F.struct(*folded, *texts, F.unix_micros("ts").alias("us"), *[c for c in UPDATE if c != "us"])
    group = F.pmod(F.xxhash64(*[text_key(events, k) for k in RUN_KEY]), F.lit(GROUPS)).cast("int")
    keyed = marked.select(group.alias("group"), F.to_json(event).alias("event"))
    keeper = RunKeeper(stuck_seconds, keep_minutes)
    said = keyed.groupBy("group").transformWithStateInPandas(keeper, SAID, "update", "EventTime")
    return said.select(F.from_json("change", CHANGES).alias("row")).select("row.*")


def tables_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writer that keeps the tables ``runs``, ``counts``, ``stuck`` and ``late`` below ``path`` up to date."""
    upsert = upsert_writer(f"{path}/runs", ["start_us", "begin_id"], day="start_day", stable=True)
    parts = {name: batch_writer(f"{path}/{name}") for name in ("counts", "errors", "stuck", "late")}

    def write(batch: DataFrame, batch_id: int) -> None:
        amounts = Observation()
        rows = cut(batch.observe(amounts, *[F.count_if(F.col("what") == w).alias(w) for w in ("run", "error", "stuck", "late")]))
        changed = rows.where("what = 'run'").withColumn("start_day", F.to_date(F.timestamp_micros("start_us")))
        # one up for the new status, one down for the old one, each on the day of its last activity
        step = lambda status, us, n: F.struct(F.to_date(F.timestamp_micros(us)).alias("day"), F.col(status).alias("status"), F.lit(n).alias("step"))
        steps = changed.select(F.inline(F.filter(F.array(step("status", "last_us", 1), step("was", "was_us", -1)), lambda s: s["status"].isNotNull())))
        errors = rows.where("what = 'error'")
        writes = [
            ("run", upsert, changed.select(*RUN_FIELDS, "start_day")),
            ("run", parts["counts"], steps.groupBy("day", "status").agg(F.sum("step").alias("amount")).where("amount <> 0")),
            ("error", parts["errors"], errors.select(F.col("instance_id").alias("tmf_id"), "job_name", F.timestamp_micros("start_us").alias("moment"), F.lit(ERROR_TYPE).alias("type"), "origin", F.col("msg").alias("message"), "code")),
            ("stuck", parts["stuck"], rows.where("what = 'stuck'").select(*RUN_KEY, "start_us", "begin_id", "open")),
            ("late", parts["late"], rows.where("what = 'late'").select(*RUN_KEY, F.col("start_us").alias("us"), F.col("begin_id").alias("event_id"), "kind")),
        ]
        at_once(batch.sparkSession, [partial(put, df, batch_id) for what, put, df in writes if amounts.get[what]])

    return write


def mail_writer(path: str, job_templates: DataFrame, templates: DataFrame, smtp: DataFrame) -> Callable[[DataFrame, int], None]:
    """Writer of the mails of runs as they end: one row for each run (begin_id) and outcome, however often a batch
    runs or the run changes. The templates are static tables."""
    absent = absent_writer(path, ["id", "outcome"], "begin_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        ended = batch.where((F.col("what") == "run") & (F.col("status") != RUNNING) & ~F.col("status").eqNullSafe(F.col("was")))
        mails = notifications(ended.withColumn("id", F.col("begin_id")), job_templates, templates, smtp)
        absent(mails.withColumn("begin_id", F.col("id")), batch_id)

    return write


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run rows, in the columns of ``fold_runs`` and ``begin_id``."""
    kinds = dict(f.split() for f in CHANGES.split(", "))
    empty = spark.createDataFrame([], ", ".join(f"{f} {kinds[f]}" for f in RUN_FIELDS))
    return read_table(spark, f"{path}/runs", empty).select(
        *RUN_KEY, "status", "event_text", "dimension", "records_total", "records_processed", F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("last_us").alias("last_activity"), "msg", "distict_errors", "warnings", "n_begin", (F.col("n_begin") > 1).alias("ambiguous"), "begin_id",
    )


def status_counts(spark: SparkSession, path: str, by: str = "total") -> DataFrame:
    """Runs per status (``total``), or per status and ``day`` or ``month`` of their last activity, from the changes alone."""
    keys = {"total": [], "day": [F.col("day")], "month": [F.trunc("day", "month").alias("month")]}[by]
    changes = read_table(spark, f"{path}/counts", spark.createDataFrame([], "day date, status string, amount bigint"))
    return changes.groupBy(*keys, "status").agg(F.sum("amount").alias("amount")).where("amount <> 0")


def compact_counts(spark: SparkSession, path: str, target: str) -> None:
    """Write the counts so far as the first batch of a new table."""
    changes = spark.read.parquet(f"{path}/counts").groupBy("day", "status").agg(F.sum("amount").alias("amount"))
    batch_writer(target)(changes.where("amount <> 0"), -1)


def open_stuck(spark: SparkSession, path: str) -> DataFrame:
    """Runs that are reported as stuck and haven't ended since."""
    schema = "instance_id string, environment string, job_name string, start_us bigint, begin_id bigint, open boolean"
    said = read_batches(spark, f"{path}/stuck", spark.createDataFrame([], schema).schema)
    last = said.groupBy("begin_id", "start_us", *RUN_KEY).agg(F.max_by("open", F.struct("batch_id", ~F.col("open"))).alias("open"))
    return last.where("open").select(*RUN_KEY, F.timestamp_micros("start_us").alias("start_time"))


def repair(spark: SparkSession, path: str, events: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """``current_runs`` (or the run table ``now``) with the keys of late events folded again from the log ``events``; without late
    events nothing is read but the table."""
    now = (current_runs(spark, path) if now is None else now).drop("begin_id")
    schema = "instance_id string, environment string, job_name string, us bigint, event_id bigint, kind string"
    late = read_batches(spark, f"{path}/late", spark.createDataFrame([], schema).schema)
    keys = cut(late.select(*[text_key(late, k).alias(k) for k in RUN_KEY]).distinct())
    if keys.isEmpty():
        return now
    fresh = fold_runs(join_on_unique(events, keys, RUN_KEY, "left_semi"))
    fresh = fresh.select(*[F.col(f.name).cast(f.dataType) for f in now.schema])
    return join_on_unique(now, keys, RUN_KEY, "left_anti").select(*now.columns).unionByName(fresh)
