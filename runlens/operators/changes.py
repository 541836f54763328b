"""Table changes as set-based rewrites.

Each function returns the new content of a table; ``sources.tables`` writes it. A join keeps all
rows of the table and touches only those with a matching change.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..functions.timefmt import ntz
from .skew import join_on_unique


def last_change(changes: DataFrame, keys: Sequence[str], order_by: str | None) -> DataFrame:
    """At most one change per key: the last by ``order_by``. Without it keys must be unique."""
    if order_by is None:
        return changes
    picked = F.max_by(F.struct(*changes.columns), F.col(order_by)).alias("row")
    return changes.groupBy(*[text_key(changes, k).alias(f"_{k}") for k in keys]).agg(picked).select("row.*").drop(order_by)


def _folded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key columns, text in upper case."""
    return df.select(*[text_key(df, k).alias(k) for k in keys])


def update_by_key(
    df: DataFrame, changes: DataFrame, keys: Sequence[str], order_by: str | None = None
) -> DataFrame:
    """Set the columns of ``changes`` on the rows with the same key; a NULL is set as NULL."""
    return _apply(df, last_change(changes, keys, order_by), keys, lambda hit, new, old: F.when(hit, new).otherwise(old))


def update_batch(
    df: DataFrame, changes: DataFrame, keys: Sequence[str], order_by: str | None = None
) -> DataFrame:
    """Per-row values by index; a NULL in ``changes`` keeps the old value."""
    return _apply(df, last_change(changes, keys, order_by), keys, lambda hit, new, old: F.coalesce(new, old))


def _apply(df: DataFrame, changes: DataFrame, keys: Sequence[str], pick) -> DataFrame:
    keys = list(keys)
    new = {c: f"_new_{c}" for c in changes.columns if c not in keys}
    renamed = changes.withColumnsRenamed(new).withColumn("_hit", F.lit(True))
    joined = join_on_unique(df, renamed, keys, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    cols = [
        pick(hit, F.col(new[c]).cast(df.schema[c].dataType), F.col(c)).alias(c) if c in new else F.col(c)
        for c in df.columns
    ]
    return joined.select(*cols)


def replace_rows(df: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the rows whose key comes in, then add the incoming rows."""
    gone = incoming.select(*keys).distinct()
    kept = join_on_unique(df, gone, keys, "left_anti").select(*df.columns)
    return kept.unionByName(incoming.select(*df.columns))


def delete_rows(
    df: DataFrame, condition: Column | None = None, keys: DataFrame | None = None,
    affected: Observation | None = None,
) -> DataFrame:
    """Rows that remain after a delete by condition or by a table of keys.

    A condition that is NULL deletes nothing. ``affected`` receives ``deleted`` when the result is
    written, without a second pass.
    """
    if keys is not None:
        on = keys.columns
        flagged = join_on_unique(df, _folded(keys, on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    else:
        flagged = df.withColumn("_hit", condition)
    flagged = flagged.withColumn("_hit", F.coalesce(F.col("_hit"), F.lit(False)))
    if affected is not None:
        flagged = flagged.observe(affected, F.count_if("_hit").alias("deleted"))
    return flagged.where(~F.col("_hit")).select(*df.columns)


def soft_delete(
    df: DataFrame, ids: Sequence[int] | DataFrame, by: int, at: str | dt.datetime, id_col: str = "userId"
) -> DataFrame:
    """Set the deleted flag with who and when; the rows stay."""
    if isinstance(ids, DataFrame):
        marks = ids.toDF(id_col).distinct().withColumn("_hit", F.lit(True))
        marked = df.join(marks, id_col, "left")
    else:
        marked = df.withColumn("_hit", F.col(id_col).isin(list(ids)))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    audit = {"isDeleted": F.lit(1), "updatedBy": F.lit(by), "updatedDtm": ntz(str(at))}
    cols = []
    for name, value in audit.items():
        old = F.col(name) if name in df.columns else F.lit(None)
        kind = df.schema[name].dataType if name in df.columns else None
        new = F.when(hit, value.cast(kind) if kind else value).otherwise(old)
        cols.append(new.alias(name))
    return marked.select(*[c for c in df.columns if c not in audit], *cols)


def increment(
    df: DataFrame, arrivals: DataFrame, keys: Sequence[str], column: str
) -> DataFrame:
    """Add the number of arriving rows per key to a counter; keys without arrivals keep theirs."""
    counted = _folded(arrivals, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = join_on_unique(df, counted, keys, "left")
    new = (F.coalesce(F.col(column), F.lit(0)) + F.coalesce(F.col("_n"), F.lit(0))).alias(column)
    return joined.select(*[new if c == column else F.col(c) for c in df.columns])


def copy_rows(df: DataFrame, condition: Column, **overrides: object) -> DataFrame:
    """The table with copies of some rows in which the given columns are replaced."""
    copies = df.where(condition)
    for name, value in overrides.items():
        new = value if isinstance(value, Column) else F.lit(value)
        copies = copies.withColumn(name, new.cast(df.schema[name].dataType))
    return df.unionByName(copies)


def cancel_runs(runs: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Set the status of runs to Cancelled."""
    cancelled = F.lit("Cancelled")  # fixed value: status text of a cancelled run
    if isinstance(ids, DataFrame):
        return update_by_key(runs, ids.toDF("id").distinct().withColumn("status", cancelled), ["id"])
    hit = F.col("id").isin(list(ids))
    return runs.withColumn("status", F.when(hit, cancelled).otherwise(F.col("status")))
