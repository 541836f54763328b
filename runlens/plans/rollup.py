"""Day roll-up of the run log, kept up to date, and the dashboard from it.

The roll-up holds one row per day of last activity, status, job and dimension, in one partition a day.
``refresh`` replaces the partitions of the days that have changed and reads only these days of the log.
``dashboard`` takes whole days from the roll-up. The few days in which a window begins or ends are counted
from the log itself, so the result is that of the one-scan dashboard to the second.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import ntz
from .trends import WINDOWS, _reduced, bundle_of

KEYS = ["status", "job_name", "dimension"]
NO_DAY = dt.date(1000, 1, 1)  # partition of runs without any activity


def _day() -> Column:
    return F.coalesce(F.to_date("last_activity"), F.lit(NO_DAY))


def day_counts(runs: DataFrame) -> DataFrame:
    """(day, status, job_name, dimension): runs n and their last activity."""
    return runs.groupBy(_day().alias("day"), *KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("last_activity").alias("date"))


def build(runs: DataFrame, path: str) -> None:
    day_counts(runs).repartition("day").write.partitionBy("day").parquet(path)


def changed_days(*changes: DataFrame) -> list[dt.date]:
    """Days of any of the tables; give the old and the new rows of a change. As many values as days."""
    days: set[dt.date] = set()
    for rows in changes:
        days |= {r["day"] for r in rows.select(_day().alias("day")).distinct().collect()}
    return sorted(days)


def refresh(runs: DataFrame, path: str, days: Iterable[dt.date]) -> None:
    """Count the given days again, from the log as it is now, and replace their partitions; a day that has no runs any
    more is left with a row of none. The same call again changes nothing."""
    days = sorted(set(days))
    if not days:
        return
    wanted = runs.where(_any([_covers(d) for d in days]) if len(days) <= 64 else _day().isin(days))
    spark = runs.sparkSession
    counted = day_counts(wanted)
    # a partition is only replaced if it gets a row
    blank = spark.createDataFrame([(d,) for d in days], "day date").select("day", *[F.lit(None).cast(runs.schema[k].dataType).alias(k) for k in KEYS], F.lit(0).cast("long").alias("n"), F.lit(None).cast(runs.schema["last_activity"].dataType).alias("date"))
    rows = counted.unionByName(blank).repartition("day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def _covers(day: dt.date) -> Column:
    """Rows of a day as a range on the raw column, which reaches the file scan."""
    if day == NO_DAY:
        return F.col("last_activity").isNull()
    return (F.col("last_activity") >= ntz(f"{day} 00:00:00")) & (F.col("last_activity") < ntz(f"{day + dt.timedelta(days=1)} 00:00:00"))


def dashboard(rollup: DataFrame, runs: DataFrame, as_of: str | dt.datetime, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The series of ``trends.dashboard`` from the stored roll-up; of ``runs`` only the days at the ends of windows are read."""
    moment = dt.datetime.fromisoformat(str(as_of))
    ends = sorted({moment.date(), *[(moment - dt.timedelta(days=n)).date() for n in windows]})
    rest = runs.where(F.coalesce(_any([_covers(d) for d in ends]), F.lit(False)))
    chain = F
    for n in sorted(windows):
        inside = (F.col("day") > F.lit((moment - dt.timedelta(days=n)).date())) & (F.col("day") < F.lit(moment.date()))
        chain = chain.when(inside, F.lit(n))
    whole = rollup.where(~F.col("day").isin(ends) & (F.col("n") > 0)).select(
        *KEYS, F.when(F.col("day") != F.lit(NO_DAY), F.month("day")).alias("m"), chain.otherwise(F.lit(None)).alias("shortest"), "n", "date",
    )
    return bundle_of(whole.unionByName(_reduced(rest, ntz(str(moment)), windows)), windows)


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found
