"""Rolling windows, growth and the dashboard bundle.

The windows end at one moment and contain each other, so a run is counted once under the
shortest window it falls into. Longer windows are summed from that small table afterwards.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.timefmt import days as day_span
from ..functions.timefmt import month_name, ntz
from ..operators.aggregates import STATUSES, distinct_values
from ..operators.predicates import LAYER_PATTERNS, in_layer, latest

WINDOWS = (30, 90, 180)  # fixed value: window lengths in days


def _as_of(runs: DataFrame, as_of: str | dt.datetime | Column | None) -> Column:
    return latest(runs) if as_of is None else ntz(as_of)


def _shortest_window(windows: Sequence[int], as_of: Column) -> Column:
    """Smallest window that contains the last activity, NULL outside all of them."""
    ts = F.col("last_activity")
    chain = F
    for n in sorted(windows):
        chain = chain.when(ts.between(as_of - day_span(n), as_of), F.lit(n))
    return chain.otherwise(F.lit(None))


def _month_text(column: str) -> Column:
    return month_name(F.make_date(F.lit(2000), F.col(column), F.lit(1)))


def window_counts(
    runs: DataFrame, windows: Sequence[int] = WINDOWS, as_of: str | dt.datetime | Column | None = None,
    statuses: Sequence[str] = STATUSES,
) -> DataFrame:
    """Runs per window, status and month: (days, label, month_no, month, amount, date).

    ``date`` is the last activity in the month. One scan; the range on the raw timestamp reaches it.
    """
    end = _as_of(runs, as_of)
    longest = max(windows)
    label = F.upper("status")
    small = (
        runs.where(F.col("last_activity").between(end - day_span(longest), end))
        .where(label.isin([s.upper() for s in statuses]))
        .groupBy(
            label.alias("label"), F.month("last_activity").alias("month_no"),
            _shortest_window(windows, end).alias("shortest"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.max("last_activity").alias("date"))
    )
    fits = F.filter(F.array(*[F.lit(n) for n in sorted(windows)]), lambda d: d >= F.col("shortest"))
    return (
        small.withColumn("days", F.explode(fits)).groupBy("days", "label", "month_no")
        .agg(F.sum("n").alias("amount"), F.max("date").alias("date"))
        .withColumn("month", _month_text("month_no"))
    )


def growth_of(counts: DataFrame, windows: Sequence[int] = WINDOWS, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Growth or decline per window and status from ``window_counts``.

    Compares the latest with the earliest month. Equal amounts are a decline of 0; without any run
    direction and percent are NULL.
    """
    ends = counts.groupBy("days", "label").agg(
        F.max_by("amount", "date").alias("latest"), F.min_by("amount", "date").alias("earliest")
    )
    ratio = F.col("latest") / F.col("earliest")
    up = F.col("latest") > F.col("earliest")
    every = F.array(*[
        F.struct(F.lit(d).alias("days"), F.lit(s.upper()).alias("label")) for d in windows for s in statuses
    ])
    grid = counts.sparkSession.range(1).select(F.inline(every))
    return grid.join(ends, ["days", "label"], "left").withColumns({
        "direction": F.when(up, "up").when(F.col("latest").isNotNull(), "down"),
        "percent": half_up(F.when(up, (ratio - 1) * 100).otherwise((1 - ratio) * 100)),
    })


def growth(
    runs: DataFrame, windows: Sequence[int] = WINDOWS, as_of: str | dt.datetime | Column | None = None,
    statuses: Sequence[str] = STATUSES,
) -> DataFrame:
    return growth_of(window_counts(runs, windows, as_of, statuses), windows, statuses)


# Layers whose executions the dashboard lists. The list titled after data marts filters the
# warehouse mark, as the counter ``dw`` does.
LISTED_LAYERS = ("stg", "dim", "fact", "dw")


def dashboard(
    runs: DataFrame, as_of: str | dt.datetime | Column | None = None, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """All series of the dashboard in one table, from one scan of the log.

    Columns: series, days, label, month_no, job_name, dimension, amount, date. The log is reduced
    once to a table of (status, job, dimension, month, shortest window); each of its rows is then
    handed to every series it belongs to. Series: ``month`` (status × month), ``window`` (window ×
    status × month), ``status``, ``job``, ``job_status``, ``layer`` (totals), ``layer_runs`` (per
    job or dimension) and ``all`` (total, with the last activity in ``date``).
    """
    return bundle_of(_reduced(runs, _as_of(runs, as_of), windows), windows)


def _reduced(runs: DataFrame, end: Column, windows: Sequence[int]) -> DataFrame:
    """The log by (status, job, dimension, month m, shortest window): n runs and their last activity."""
    return runs.groupBy(
        "status", "job_name", "dimension", F.month("last_activity").alias("m"),
        _shortest_window(windows, end).alias("shortest"),
    ).agg(F.count(F.lit(1)).alias("n"), F.max("last_activity").alias("date"))


def bundle_of(small: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The series of ``dashboard`` from the reduced log."""
    label, known = F.upper("status"), F.upper("status").isin([s.upper() for s in STATUSES])
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def row(series: str, when: Column | None = None, days=none_i, label=none_s, month=none_i, job=none_s, dim=none_s):
        made = F.struct(
            F.lit(series).alias("series"), days.alias("days"), label.alias("label"),
            month.alias("month_no"), job.alias("job_name"), dim.alias("dimension"),
        )
        return made if when is None else F.when(when, made)

    rows = [
        row("month", known, label=label, month=F.col("m")),
        row("status", label=F.col("status")),
        row("job", job=F.col("job_name"), dim=F.col("dimension")),
        row("job_status", label=F.col("status"), job=F.col("job_name"), dim=F.col("dimension")),
        row("all"),
    ]
    for d in windows:
        rows.append(row("window", known & (F.col("shortest") <= d), F.lit(d), label, F.col("m")))
    for layer, (column, _) in LAYER_PATTERNS.items():
        rows.append(row("layer", in_layer(layer), label=F.lit(layer)))
        if layer in LISTED_LAYERS:
            name = {"job": F.col("job_name")} if column == "job_name" else {"dim": F.col("dimension")}
            rows.append(row("layer_runs", in_layer(layer), label=F.lit(layer), **name))
    keys, texts = ["series", "days", "month_no"], ["label", "job_name", "dimension"]
    # spellings are summed by hash aggregation before the few that are left are folded
    spelled = (
        small.select(F.inline(F.array_compact(F.array(*rows))), "n", "date").groupBy(*keys, *texts)
        .agg(F.sum("n").alias("n"), F.max("date").alias("date"))
    )
    folded = spelled.groupBy(*keys, *[F.upper(c).alias(f"_{c}") for c in texts])
    found = folded.agg(*[F.min(c).alias(c) for c in texts], F.sum("n").alias("amount"), F.max("date").alias("date"))
    return found.select("series", "days", "label", "month_no", "job_name", "dimension", "amount", "date")


def series(bundle: DataFrame, name: str) -> DataFrame:
    """One series of the bundle."""
    return bundle.where(F.col("series") == name).drop("series")


def filter_panel(runs: DataFrame) -> DataFrame:
    """Values offered by the run filter, with the number of runs of each."""
    return distinct_values(runs, ["status", "job_name", "dimension", "environment", "reprocess"])
