"""Run lifecycle in batch: begin, end and error events → run rows.

A begin event adds a run row. An end or error event changes the run with the same instance,
environment and job (text without regard to case), but only if at that moment exactly one such run
exists; otherwise it has no effect. A run shows the spelling of its begin. A key with a NULL part matches
nothing, so its runs stay as they began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..functions.timefmt import ntz
from ..session import cut
from .predicates import latest
from .skew import join_on_unique

RUN_KEY = ["instance_id", "environment", "job_name"]

# Texts written when a run begins, ends or fails.
RUNNING, READY, ERROR = "running", "ready", "error"
ERROR_TEXT = "Error(s) Found"
ERROR_TYPE = "Python Exception"
INTERFACE = "1"


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _order() -> Column:
    """Events in time order; the id decides between equal times."""
    return F.struct("ts", "event_id")


def _folded(events: DataFrame) -> DataFrame:
    """Events with the keys by which they meet."""
    return events.withColumns({k: text_key(events, k) for k in RUN_KEY})


def _keyless() -> Column:
    return F.col(RUN_KEY[0]).isNull() | F.col(RUN_KEY[1]).isNull() | F.col(RUN_KEY[2]).isNull()


def begin_rows(events: DataFrame) -> DataFrame:
    """Begin events → new, complete run rows. Host and user are NULL where events don't name them."""
    none = F.lit(None)
    who = [F.col(c) if c in events.columns else none.cast("string").alias(c) for c in ("hostname", "username")]
    return events.where(_is("begin")).select(
        *RUN_KEY, F.lit(INTERFACE).alias("interface_id"), F.lit(RUNNING).alias("status"), "event_text", "dimension",
        F.lit(0).alias("reprocess"), F.lit("0").alias("records_total"), F.lit("0").alias("records_processed"),
        F.col("ts").alias("start_time"), F.col("ts").alias("last_activity"),
        none.cast("interval day to second").alias("running_time"), none.cast("int").alias("distict_errors"),
        none.cast("string").alias("warnings"), *who, none.cast("string").alias("msg"),
    )


def error_rows(events: DataFrame) -> DataFrame:
    """Error events → rows of the error table.

    Error and run are written together, so an error counts only if exactly one run of its key had
    begun by then: from the first begin on, up to the second one."""
    begins = _folded(events.where(_is("begin"))).select(*RUN_KEY, _order().alias("_at"))
    first = begins.groupBy(*RUN_KEY).agg(F.min("_at").alias("_first"))
    after = join_on_unique(begins, first, RUN_KEY, "inner", fold=False).where(F.col("_at") > F.col("_first"))
    second = after.groupBy(*RUN_KEY).agg(F.min("_at").alias("_second"))
    bounds = first.join(second, RUN_KEY, "left")
    placed = join_on_unique(events.where(_is("error")), bounds, RUN_KEY, "inner")
    one = (_order() > F.col("_first")) & (F.col("_second").isNull() | (_order() < F.col("_second")))
    return error_events(placed.where(one))


def error_events(events: DataFrame) -> DataFrame:
    """All error events in the form of error rows, whether or not a run takes them."""
    return events.where(_is("error")).select(
        F.col("instance_id").alias("tmf_id"), "job_name", F.col("ts").alias("moment"),
        F.lit(ERROR_TYPE).alias("type"), "origin", F.col("msg").alias("message"), "code",
    )


def fold_state(events: DataFrame) -> DataFrame:
    """One row per run key (text in upper case): first begin, last end, last error, number of begins."""
    first = F.struct("ts", "event_id", "event_text", "dimension", *[F.col(k).alias(f"own_{k}") for k in RUN_KEY])
    end = F.struct("ts", "event_id", "records_total", "records_processed", "msg")
    return events.groupBy(*[text_key(events, k).alias(k) for k in RUN_KEY]).agg(
        F.count_if(_is("begin")).alias("n_begin"),
        F.min(F.when(_is("begin"), first)).alias("first"),
        F.max(F.when(_is("end"), end)).alias("end"),
        F.max(F.when(_is("error"), _order())).alias("error"),
    )


def run_rows(state: DataFrame) -> DataFrame:
    """Run rows from folded state of keys with one begin. Events before the begin found no run and
    count for nothing."""
    begun = F.struct("first.ts", "first.event_id")
    ended = F.coalesce(F.struct("end.ts", "end.event_id") > begun, F.lit(False))
    failed = F.coalesce(F.col("error") > begun, F.lit(False))
    error_last = failed & (~ended | (F.col("error") > F.struct("end.ts", "end.event_id")))
    return state.where(F.col("n_begin") > 0).select(
        *[F.col(f"first.own_{k}").alias(k) for k in RUN_KEY],
        F.when(error_last, ERROR).when(ended, READY).otherwise(RUNNING).alias("status"),
        F.when(failed, ERROR_TEXT).otherwise(F.col("first.event_text")).alias("event_text"),
        F.col("first.dimension").alias("dimension"),
        F.when(ended, F.col("end.records_total")).otherwise("0").alias("records_total"),
        F.when(ended, F.col("end.records_processed")).otherwise("0").alias("records_processed"),
        F.col("first.ts").alias("start_time"),
        F.greatest(
            "first.ts", F.when(ended, F.col("end.ts")), F.when(failed, F.col("error.ts"))
        ).alias("last_activity"),
        F.when(ended, F.col("end.msg")).alias("msg"),
        F.when(failed, 1).alias("distict_errors"),
        F.when(failed, "0").alias("warnings"),
        "n_begin",
        (F.col("n_begin") > 1).alias("ambiguous"),
    )


def _as_begun(begins: DataFrame, n_begin: Column, ambiguous: bool) -> DataFrame:
    """Run rows of begin events that no update reaches."""
    none = F.lit(None)
    return begins.select(
        *RUN_KEY, F.lit(RUNNING).alias("status"), "event_text", "dimension",
        F.lit("0").alias("records_total"), F.lit("0").alias("records_processed"),
        F.col("ts").alias("start_time"), F.col("ts").alias("last_activity"),
        none.cast("string").alias("msg"), none.cast("int").alias("distict_errors"),
        none.cast("string").alias("warnings"), n_begin.alias("n_begin"), F.lit(ambiguous).alias("ambiguous"),
    )


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per begin event, with the updates that reached it.

    The folded state is checkpointed (eager). Only if it holds keys with several begins
    (``ambiguous``) are the events read again and those of such keys kept: the first run takes the
    updates up to the second begin, later runs stay as they began because their updates match several
    rows.
    """
    alone = _as_begun(events.where(_keyless() & _is("begin")), F.lit(1).cast("long"), False)
    events = events.where(~_keyless())
    state = cut(fold_state(events))
    clear = run_rows(state.where(F.col("n_begin") == 1)).unionByName(alone)
    unclear = state.where(F.col("n_begin") > 1).select(
        *RUN_KEY, F.col("n_begin").alias("_n"), F.struct("first.ts", "first.event_id").alias("_first")
    )
    if unclear.isEmpty():
        return clear
    # a key may hold very many events: both joins are safe for hot keys
    rows = cut(join_on_unique(events, unclear, RUN_KEY, "inner"))
    begins = rows.where(_is("begin") & (_order() > F.col("_first")))
    second = _folded(begins).groupBy(*RUN_KEY).agg(F.min(_order()).alias("_second"))
    early = join_on_unique(rows, second, RUN_KEY, "inner").where(_order() < F.col("_second"))
    heads = run_rows(fold_state(early.drop("_first", "_second"))).drop("n_begin", "ambiguous")
    heads = join_on_unique(heads, unclear.select(*RUN_KEY, F.col("_n").alias("n_begin")), RUN_KEY, "inner")
    heads = heads.withColumn("ambiguous", F.lit(True))
    return clear.unionByName(heads).unionByName(_as_begun(begins, F.col("_n"), True))


def stuck_runs(
    runs: DataFrame, strategy: str = "absolute", limit: int = 60, as_of: str | None = None
) -> DataFrame:
    """Runs still marked running for more than ``limit`` minutes (``absolute``), or without any
    activity for more than ``limit`` seconds (``no_activity``)."""
    end = latest(runs) if as_of is None else ntz(as_of)
    running = F.upper("status") == RUNNING.upper()
    if strategy == "absolute":
        old = F.col("start_time") < end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(limit))
    else:
        old = F.col("last_activity") < end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(limit))
    return runs.where(running & old)


# Run status → outcome that selects the mail template.
OUTCOMES = {"READY": "success", "ERROR": "failure", "CANCELLED": "abort"}


def notifications(runs: DataFrame, job_templates: DataFrame, templates: DataFrame, smtp: DataFrame) -> DataFrame:
    """Mails to be sent for finished runs. Sending them is not part of this library.

    ``job_templates`` names a template per job and outcome (on_success, on_failure, on_abort);
    text ``0`` or NULL means no mail. Copies follow the receivers as ``, cc:address``.
    """
    chain = F
    for status, outcome in OUTCOMES.items():
        chain = chain.when(F.upper("status") == status, F.lit(outcome))
    finished = runs.withColumn("outcome", chain.otherwise(F.lit(None)))
    choices = F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(f"on_{o}").cast("string").alias("template"))
        for o in ("success", "failure", "abort")
    ])
    chosen = job_templates.select("job_name", F.inline(choices)).where(F.col("template") != "0")
    copies = F.when(
        F.col("cc") != "", F.concat(F.lit(", cc:"), F.array_join(F.split("cc", ","), ", cc:"))
    ).otherwise(F.lit(""))
    mails = templates.select(
        F.col("name").alias("template"), F.concat(F.col("to"), F.coalesce(copies, F.lit(""))).alias("recipients"),
        F.col("from").alias("sender"), "subject", F.col("msg").alias("body"), "smtp",
    )
    server = smtp.select(F.col("name").alias("smtp"), "smtp_host", "smtp_port")
    per_job = chosen.join(mails, "template").join(server, "smtp")
    return finished.join(per_job, ["job_name", "outcome"]).select(
        "id", "job_name", "outcome", "template", "recipients", "sender", "subject", "body",
        "smtp_host", "smtp_port",
    )
