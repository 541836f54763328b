"""The lifecycle of a stream of events as tables that every micro-batch folds, without Python in the tasks.

What is held between micro-batches are events: the begins of each run key (text without regard to case) and the
updates that may still matter. A batch puts its events to them, sorts each key once by time and folds it by windows, and
writes all rows into the one of two places that the batch before didn't use; it reads that batch's place, so a batch
that runs again finds the same and writes the same. Everything else comes from the rows written:

``counts`` (changes per status, day of last activity and batch), ``errors``, ``stuck``, ``late`` and ``done`` (runs whose key
has left), each in one partition a batch, in the forms that ``run_state`` reads. The run table (``current_runs``) is
the begins held and ``done``.

The watermark is the latest event of the batches so far less the delay. No late event is discarded, and what a watermark
makes due (errors that are certain, runs that are stuck) is written by the batch that brings it, so a stream needs no
batch without rows. A late update is applied as long as its key is held. A late begin, and a late update whose key has
no begin, are also written as ``late``, for ``run_state.repair``. A key leaves ``keep_minutes`` after its last event, by the
watermark before the batch, if its only run is over; a begin that uses the same key after that is a new run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import text_key
from ..operators.lifecycle import ERROR, ERROR_TEXT, ERROR_TYPE, READY, RUN_KEY, RUNNING
from .lifecycle import at_once, batch_writer, read_table

#: An event as it is held; ``told``: its error row has been written; ``was``: status and last activity of a begin's run before the batch.
HELD = (
    "instance_id string, environment string, job_name string, us bigint, event_id bigint, kind string, event_text string, dimension string, "
    "records_total string, records_processed string, msg string, origin string, code int, told boolean, was string, was_us bigint, fresh boolean"
)
#: What the fold adds. ``n``: begins of the key up to the event; ``keep``: held for the next batch; ``gone``: the key has left.
FOLDED = (
    ", n bigint, n_begin bigint, known boolean, had boolean, keep boolean, gone boolean, status string, last_us bigint, failed boolean, "
    "end struct<us: bigint, event_id: bigint, records_total: string, records_processed: string, msg: string>"
)
EVENT = [f.split()[0] for f in HELD.split(", ")][:-4]
PLACES = "slot int, batch_id bigint, latest bigint"
EVER = -(2**62)  # a watermark before all events
KEY = ["_key0", "_key1", "_key2", "_alone"]


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def fold(rows: DataFrame, watermark: int, keep_minutes: int) -> DataFrame:
    """Held and new events (``HELD``) with the run rows at their begins (``FOLDED``). One shuffle by key; windows spill, so
    a key of any size fits."""
    keys = [text_key(rows, k) for k in RUN_KEY]
    known = keys[0].isNotNull() & keys[1].isNotNull() & keys[2].isNotNull()
    # a key with a null part meets nothing: its rows stand alone
    placed = rows.withColumns({**dict(zip(KEY, keys)), "known": known, "_alone": F.when(~known, F.struct("us", "event_id"))})
    begin, settled = _is("begin"), F.col("us") < watermark
    by_key = Window.partitionBy(*KEY)
    in_time = by_key.orderBy("us", "event_id", begin).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("n", F.sum(begin.cast("long")).over(in_time))
    update = ~begin & F.col("known")
    placed = placed.withColumns({
        "n_begin": F.sum(begin.cast("long")).over(by_key), "had": F.max(begin & ~F.col("fresh")).over(by_key), "_seen": F.max("us").over(by_key),
        "_updated": F.max(update & (F.col("n") == 1)).over(by_key),
    })
    # of the updates between two begins the last ones, which come first
    back = Window.partitionBy(*KEY, "n").orderBy(F.desc("us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda kind, *what: F.first(F.when(update & _is(kind), F.struct("us", "event_id", *what)), ignorenulls=True).over(back)
    older = lambda kind: F.sum((update & _is(kind) & settled).cast("long")).over(back)
    placed = placed.withColumns({
        "_end": last("end", "records_total", "records_processed", "msg"), "_error": last("error"), "_old_ends": older("end"), "_old_errors": older("error"),
    })
    only = begin & F.col("known") & (F.col("n") == 1)  # updates count for the first run, up to the second begin
    end, error = F.when(only, F.col("_end")), F.when(only, F.col("_error"))
    error_last = error.isNotNull() & (end.isNull() | (error > F.struct(end["us"], end["event_id"])))
    worth = (F.col("n_begin") == 0) | ~settled | (F.col("n") == 1) & (F.when(_is("end"), F.col("_old_ends")).otherwise(F.col("_old_errors")) == 1)
    over = (F.col("n_begin") == 0) | (F.col("n_begin") == 1) & F.col("_updated")
    return placed.withColumns({
        "keep": begin | update & worth,
        "gone": F.col("known") & over & (F.col("_seen") + keep_minutes * 60_000_000 < watermark),
        "status": F.when(begin, F.when(error_last, ERROR).when(end.isNotNull(), READY).otherwise(RUNNING)),
        "last_us": F.when(begin, F.greatest("us", end["us"], error["us"])), "failed": error.isNotNull(), "end": end,
    }).select(*_fields(HELD + FOLDED))


def _fields(schema: str) -> list[str]:
    return [f.name for f in _type(schema)]


def _type(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may be missing."""
    return read_table(spark, path, spark.createDataFrame([], _type(schema)))


def _last(spark: SparkSession, path: str, before: int | None = None) -> Row | None:
    """Place, number and latest event of the last batch."""
    places = _rows(spark, f"{path}/places", PLACES).collect()  # two rows
    return max((p for p in places if before is None or p["batch_id"] < before), key=lambda p: p["batch_id"], default=None)


def _events(batch: DataFrame) -> DataFrame:
    """New events in the form of ``HELD``; those without a time are left out."""
    named = batch.where("ts is not null").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    none = {"told": F.lit(False), "was": F.lit(None).cast("string"), "was_us": F.lit(None).cast("long"), "fresh": F.lit(True)}
    return named.select(*EVENT).withColumns(none)


def tables_writer(path: str, stuck_seconds: int = 3600, delay_minutes: int = 10, keep_minutes: int = 7 * 24 * 60) -> Callable[[DataFrame, int], None]:
    """Writer of micro-batches of events that keeps the tables below ``path``."""
    limit, delay = stuck_seconds * 1_000_000, delay_minutes * 60_000_000
    parts = {name: batch_writer(f"{path}/{name}") for name in ("counts", "errors", "stuck", "late", "done")}
    watermark_of = lambda latest: EVER if latest is None else latest - delay

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = _last(spark, path, batch_id)
        slot, latest = (1 - last["slot"], last["latest"]) if last else (0, None)
        before, rows = watermark_of(latest), _events(batch)
        if last:
            held = _rows(spark, f"{path}/live-{last['slot']}", HELD + FOLDED).where("keep and not gone")
            told = F.col("told") | _certain(before)
            held = held.withColumns({"told": told, "was": F.col("status"), "was_us": F.col("last_us"), "fresh": F.lit(False)})
            rows = held.select(*rows.columns).unionByName(rows)
        fold(rows, before, keep_minutes).write.mode("overwrite").parquet(f"{path}/live-{slot}")
        written = _rows(spark, f"{path}/live-{slot}", HELD + FOLDED)
        came = written.where("fresh").agg(F.max("us")).first()[0]
        latest = max((t for t in (latest, came) if t is not None), default=None)
        writes = _outputs(written, before, watermark_of(latest), limit)
        at_once(spark, [partial(parts[name], df, batch_id) for name, df in writes.items()])
        place = spark.createDataFrame([(slot, batch_id, latest)], _type(PLACES)).coalesce(1)
        place.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(f"{path}/places")

    return write


def _certain(watermark: int) -> Column:
    """Whether an error reaches its run, and no event is awaited any more that could change that."""
    return _is("error") & F.col("known") & (F.col("n") == 1) & (F.col("us") < watermark)


def _outputs(rows: DataFrame, before: int, now: int, limit: int) -> dict[str, DataFrame]:
    """The rows that a batch adds to each table; ``before`` and ``now`` are the watermarks before and after it."""
    begins = rows.where(_is("begin"))
    # one up for the new status, one down for the old one, each on the day of its last activity
    step = lambda status, us, n: F.struct(F.to_date(F.timestamp_micros(us)).alias("day"), F.col(status).alias("status"), F.lit(n).alias("step"))
    changed = begins.where(~(F.col("status").eqNullSafe(F.col("was")) & F.col("last_us").eqNullSafe(F.col("was_us"))))
    steps = changed.select(F.inline(F.filter(F.array(step("status", "last_us", 1), step("was", "was_us", -1)), lambda s: s["status"].isNotNull())))
    stuck = lambda status, watermark: F.coalesce(F.col(status) == RUNNING, F.lit(False)) & (F.col("us") + limit < watermark)
    return {
        "counts": steps.groupBy("day", "status").agg(F.sum("step").alias("amount")).where("amount <> 0"),
        "errors": rows.where(_certain(now) & ~F.col("told")).select(
            F.col("instance_id").alias("tmf_id"), "job_name", F.timestamp_micros("us").alias("moment"), F.lit(ERROR_TYPE).alias("type"),
            "origin", F.col("msg").alias("message"), "code",
        ),
        "stuck": begins.where(stuck("was", before) != stuck("status", now)).select(
            *RUN_KEY, F.col("us").alias("start_us"), F.col("event_id").alias("begin_id"), stuck("status", now).alias("open"),
        ),
        "late": rows.where(F.col("fresh") & (F.col("us") < before) & (_is("begin") | ~F.col("had"))).select(*RUN_KEY, "us", "event_id", "kind"),
        "done": _runs(begins.where("gone")),
    }


def _runs(begins: DataFrame) -> DataFrame:
    """Run rows in the columns of ``fold_runs``, and ``begin_id``."""
    ended = F.col("end").isNotNull()
    return begins.select(
        *RUN_KEY, "status", F.when(F.col("failed"), ERROR_TEXT).otherwise(F.col("event_text")).alias("event_text"), "dimension",
        F.when(ended, F.col("end.records_total")).otherwise("0").alias("records_total"),
        F.when(ended, F.col("end.records_processed")).otherwise("0").alias("records_processed"),
        F.timestamp_micros("us").alias("start_time"), F.timestamp_micros("last_us").alias("last_activity"), F.col("end.msg").alias("msg"),
        F.when(F.col("failed"), 1).alias("distict_errors"), F.when(F.col("failed"), "0").alias("warnings"),
        "n_begin", (F.col("n_begin") > 1).alias("ambiguous"), F.col("event_id").alias("begin_id"),
    )


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run table after the last batch."""
    last = _last(spark, path)
    if last is None:
        return _runs(spark.createDataFrame([], _type(HELD + FOLDED)))
    live = _runs(_rows(spark, f"{path}/live-{last['slot']}", HELD + FOLDED).where(_is("begin") & ~F.col("gone")))
    done = read_table(spark, f"{path}/done", live.withColumn("batch_id", F.lit(0).cast("bigint"))).where(F.col("batch_id") <= last["batch_id"])
    return live.unionByName(done.drop("batch_id"))


def changed_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs that the last batch began or whose status it changed, in the form of ``run_state.CHANGES`` as far as mails need it."""
    last = _last(spark, path)
    rows = _rows(spark, f"{path}/live-{last['slot'] if last else 0}", HELD + FOLDED)
    rows = rows.where(_is("begin") & ~F.col("status").eqNullSafe(F.col("was")))
    return rows.select(F.lit("run").alias("what"), *RUN_KEY, "status", "was", F.col("us").alias("start_us"), F.col("event_id").alias("begin_id"))


def error_rows(spark: SparkSession, path: str) -> DataFrame:
    """The error table, also before the first batch."""
    schema = "tmf_id string, job_name string, moment timestamp, type string, origin string, message string, code int, batch_id bigint"
    return _rows(spark, f"{path}/errors", schema).drop("batch_id")
