"""Build records of scheduled jobs: latest builds, builds by outcome, ranges by position.

A build is one row (job, number, timestamp, duration, result); ``sources.builds`` reads the nested
feed into this form. Build numbers of a job are consecutive and unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefmt import fmt_ts, ms_text, ms_to_ts
from .skew import join_on_unique


def latest_build(builds: DataFrame) -> DataFrame:
    """The build with the highest number of every job: the number by hash aggregation, then its row."""
    newest = builds.groupBy("job").agg(F.max("number").alias("_newest"))
    found = join_on_unique(builds, newest, ["job"], "inner", fold=False)
    return found.where(F.col("number") == F.col("_newest")).select(*builds.columns)


# The "last …" builds of a job and the results that count for each.
LAST_KINDS = {
    "last": None,
    "last_completed": ["SUCCESS", "UNSTABLE", "FAILURE", "ABORTED", "NOT_BUILT"],
    "last_stable": ["SUCCESS"],
    "last_unstable": ["UNSTABLE"],
    "last_successful": ["SUCCESS", "UNSTABLE"],
    "last_unsuccessful": ["UNSTABLE", "FAILURE", "ABORTED", "NOT_BUILT"],
    "last_failed": ["FAILURE"],
}


def _counts_for(kind: str) -> Column:
    results = LAST_KINDS[kind]
    return F.lit(True) if results is None else F.col("result").isin(results)


def last_build_numbers(builds: DataFrame) -> DataFrame:
    """One row per job with the number of each "last …" build."""
    return builds.groupBy("job").agg(
        *[F.max(F.when(_counts_for(k), F.col("number"))).alias(k) for k in LAST_KINDS]
    )


def last_build_by_result(builds: DataFrame, kind: str = "last_failed") -> DataFrame:
    """The full record of one "last …" build per job; a job without one is left out."""
    return latest_build(builds.where(_counts_for(kind)))


POSITION_BLOCK = 100_000  # build numbers per block


def build_range(
    builds: DataFrame, job: str | None = None, lo: int = 0, hi: int | None = None,
    block: int = POSITION_BLOCK,
) -> DataFrame:
    """Builds at positions ``lo`` (included) to ``hi`` (excluded, None: to the oldest), newest first, 0 = newest.

    Positions are counted in two steps so that no task sorts a whole job: rows per block of build
    numbers, then the order inside each block. Blocks outside the range are left out before the
    rows are shuffled. A block holds at most ``block`` rows.
    """
    rows = builds if job is None else builds.where(F.col("job") == job)
    rows = rows.withColumn("_block", F.floor(F.col("number") / block))
    sizes = rows.groupBy("job", "_block").agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy("job").orderBy(F.col("_block").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    ends = F.lit(True) if hi is None else F.col("_before") < hi
    needed = starts.where(ends & (F.col("_before") + F.col("_n") > lo))
    inside = Window.partitionBy("job", "_block").orderBy(F.col("number").desc())
    placed = rows.join(needed.drop("_n"), ["job", "_block"]).withColumn(
        "position", (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint")
    )
    found = placed.where(F.col("position") >= lo) if hi is None else placed.where(F.col("position").between(lo, hi - 1))
    return found.drop("_block", "_before")


def build_table(builds: DataFrame, wrap: bool = True) -> DataFrame:
    """Builds with their start as a moment and as text, and their duration as text."""
    started = ms_to_ts(F.col("timestamp"))
    return builds.withColumns({
        "started": started,
        "started_text": fmt_ts(started, "moment"),
        "duration_text": ms_text(F.col("duration"), wrap),
    })


def builds_per_result(builds: DataFrame) -> DataFrame:
    return builds.groupBy("job", "result").agg(F.count(F.lit(1)).alias("amount"))
