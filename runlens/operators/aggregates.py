"""Counts, groupings, distinct lists and percentages over runs and other tables.

All of these aggregate with a partial step before the shuffle, so a value that holds a third of
the rows costs one partial row per task, not a hot partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..functions.timefmt import month_name, percent_of
from .predicates import LAYER_PATTERNS, in_layer

STATUSES = ("ready", "error", "warning", "running")


def _n(name: str = "amount") -> Column:
    return F.count(F.lit(1)).alias(name)


def count_where(df: DataFrame, condition: Column | None = None, name: str = "amount") -> DataFrame:
    """Number of rows, as a one-row table; no row leaves the executors."""
    return (df if condition is None else df.where(condition)).agg(_n(name))


def count_all(df: DataFrame, name: str = "amount") -> DataFrame:
    return count_where(df, None, name)


def count_results(df: DataFrame, name: str = "amount") -> DataFrame:
    """Number of rows of any query, whatever its grouping, limit or order."""
    return df.agg(_n(name))


# ---------------------------------------------------------------- by status and month


def month_keys(ts: Column, grain: str = "month") -> dict[str, Column]:
    """Grouping columns of a month. ``month`` merges the years, ``year_month`` keeps them apart."""
    keys = {"month_no": F.month(ts)}
    return keys if grain == "month" else {"year_no": F.year(ts), **keys}


def runs_by_status_month(runs: DataFrame, grain: str = "month", ts: str = "last_activity") -> DataFrame:
    """Runs per upper-case status and month, with the English month name."""
    keys = month_keys(F.col(ts), grain)
    return (
        runs.groupBy(F.upper("status").alias("label"), *[c.alias(k) for k, c in keys.items()])
        .agg(F.count("status").alias("amount"))
        .withColumn("month", _name_of_month("month_no"))
    )


def _name_of_month(column: str) -> Column:
    return month_name(F.make_date(F.lit(2000), F.col(column), F.lit(1)))


def runs_by_month_for_status(runs: DataFrame, status: str, grain: str = "month") -> DataFrame:
    return runs_by_status_month(runs.where(F.upper("status") == status.upper()), grain)


def month_labels(runs: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Names of the months that have a run of one of the statuses."""
    wanted = [s.upper() for s in statuses]
    months = runs.where(F.upper("status").isin(wanted)).select(F.month("last_activity").alias("month_no"))
    return months.distinct().select(_name_of_month("month_no").alias("month"))


def month_status_matrix(runs: DataFrame, statuses: Sequence[str] = STATUSES, grain: str = "month") -> DataFrame:
    """One row per month and one column per status; a month without such runs shows 0."""
    keys = month_keys(F.col("last_activity"), grain)
    wanted = [s.upper() for s in statuses]
    counts = [F.count_if(F.upper("status") == s).alias(s.lower()) for s in wanted]
    return (
        runs.where(F.upper("status").isin(wanted) & F.col("last_activity").isNotNull())
        .groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*counts)
        .withColumn("month", _name_of_month("month_no"))
    )


def counts_by_text(df: DataFrame, cols: Sequence[str], counted: str) -> DataFrame:
    """Rows per group of text columns without regard to case; each column shows its smallest spelling.

    Spellings are counted first by hash aggregation, so only the few spellings are folded."""
    spelled = df.groupBy(*cols).agg(F.count(counted).alias("_n"))
    folded = spelled.groupBy(*[text_key(spelled, c).alias(f"_{c}") for c in cols])
    return folded.agg(*[F.min(c).alias(c) for c in cols], F.sum("_n").alias("amount")).select(*cols, "amount")


def runs_by_status(runs: DataFrame) -> DataFrame:
    return counts_by_text(runs, ["status"], "status").orderBy("status")


def runs_by_job(runs: DataFrame) -> DataFrame:
    return counts_by_text(runs, ["job_name", "dimension"], "job_name").orderBy("dimension")


def runs_by_job_status(runs: DataFrame) -> DataFrame:
    return counts_by_text(runs, ["job_name", "dimension", "status"], "status").orderBy("dimension")


def layer_counts(runs: DataFrame) -> DataFrame:
    """Runs per warehouse layer, all layers in one pass."""
    return runs.agg(*[F.count_if(in_layer(name)).alias(name) for name in LAYER_PATTERNS])


def executions_by_layer(runs: DataFrame, layer: str) -> DataFrame:
    """Runs per job (or per dimension, for ``dw`` and ``dm``) of one layer."""
    column = LAYER_PATTERNS[layer][0]
    return counts_by_text(runs.where(in_layer(layer)), [column], column).withColumnRenamed(column, layer)


# ---------------------------------------------------------------- column statistics


def total(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """SUM; NULL over no rows."""
    return df.agg(F.sum(column).alias(name or column))


def summary(
    df: DataFrame, column: str, fns: Sequence[str] = ("max", "min", "avg", "sum"), alias: str | None = None
) -> DataFrame:
    """MAX, MIN, AVG, SUM in one pass; a single function is named after its column by default."""
    known = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}
    base = alias or column
    names = {fn: base if len(fns) == 1 else f"{fn}_{base}" for fn in fns}
    return df.agg(*[known[fn](column).alias(names[fn]) for fn in fns])


def date_span(df: DataFrame, column: str = "last_activity") -> DataFrame:
    """First and last moment of a log. NULLs are left out of the first one."""
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))


# ---------------------------------------------------------------- distinct


def group_count(df: DataFrame, *cols: str, name: str = "amount") -> DataFrame:
    """Number of groups, text without regard to case; NULL forms a group of its own."""
    return df.select(*[text_key(df, c).alias(c) for c in cols]).distinct().agg(_n(name))


def distinct_count(df: DataFrame, column: str, name: str = "amount") -> DataFrame:
    return group_count(df, column, name=name)


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows, text without regard to case and in its smallest spelling."""
    spelled = df.select(*cols).distinct()
    folded = spelled.groupBy(*[text_key(spelled, c).alias(f"_{c}") for c in cols])
    return folded.agg(*[F.min(c).alias(c) for c in cols]).select(*cols)


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The distinct values of several columns as rows (field, value, amount), in one scan; text without
    regard to case and in its smallest spelling.

    Values stay rows instead of being collected into one list, so a column with very many
    values is no problem. Rows are counted per combination first, which keeps the unpivot small.
    """
    combos = df.groupBy(*cols).agg(_n("n"))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols
    ])
    spelled = combos.select(F.inline(pairs), "n").groupBy("field", "value").agg(F.sum("n").alias("n"))
    folded = spelled.groupBy("field", F.upper("value").alias("_value"))
    return folded.agg(F.min("value").alias("value"), F.sum("n").alias("amount")).select("field", "value", "amount")


def reprocess_jobs(runs: DataFrame) -> DataFrame:
    """Distinct rows (job, flag) of jobs enabled for another run."""
    return distinct_rows(runs.where(F.col("reprocess") == 1), ["job_name", "reprocess"])


def active_count(df: DataFrame, column: str = "IsActive", value: int = 1, name: str = "amount") -> DataFrame:
    return df.agg(F.count_if(F.col(column) == value).alias(name))


# ---------------------------------------------------------------- status tally and shares


def status_tally(runs: DataFrame) -> DataFrame:
    """One row with a count per known status, exact case, and one for all others."""
    known = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    other = F.count_if(F.col("status").isNull() | ~F.col("status").isin(list(STATUSES)))
    return runs.agg(*known, other.alias("other"), _n("total"))


def status_percent(runs: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Rounded share of each status in all runs; NULL for an empty log."""
    counts = [F.count_if(F.upper("status") == s.upper()).alias(s) for s in statuses]
    one = runs.agg(*counts, _n("total"))
    pairs = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("amount")) for s in statuses])
    return one.select(F.inline(pairs), "total").withColumn(
        "percent", percent_of(F.col("amount"), F.col("total"))
    )


# ---------------------------------------------------------------- general grouping


def group_by(df: DataFrame, cols: Sequence[str | Column], aggs: Mapping[str, Column], exact: bool = False) -> DataFrame:
    """Aggregates per group. Named text columns are grouped without regard to case and show their smallest
    spelling, which sorts the rows of a task; with ``exact``, or for expressions, values are taken as they are."""
    texts = [] if exact else [c for c in cols if isinstance(c, str) and df.schema[c].dataType.typeName() == "string"]
    keys = [F.upper(c).alias(f"_{c}") if c in texts else c for c in cols] if texts else list(cols)
    found = df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in texts], *[c.alias(k) for k, c in aggs.items()])
    if not texts:
        return found
    shown = [c if isinstance(c, str) else found.columns[i] for i, c in enumerate(cols)]
    return found.select(*shown, *aggs)


def having(
    df: DataFrame, cols: Sequence[str | Column], aggs: Mapping[str, Column], condition: Column, exact: bool = False
) -> DataFrame:
    """Grouping with a condition on the aggregates; combine several with ``&`` or ``|``."""
    return group_by(df, cols, aggs, exact).where(condition)
