"""Row filters: single predicates, their combination, and the filters built from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_texts, like_contains, or_like, same_text, text_key, upper_lit
from ..functions.timefmt import day_end, day_start, days, next_day_start, ntz

# ---------------------------------------------------------------- single predicates


def _equals(df: DataFrame, column: str, value: object) -> Column:
    """Equality; text is compared without regard to case."""
    if value is None:
        return F.col(column).isNull()
    if isinstance(value, str) and df.schema[column].dataType.typeName() == "string":
        return same_text(F.col(column), value)
    return F.col(column) == F.lit(value)


def by_id(df: DataFrame, id: int) -> DataFrame:
    return df.where(F.col("id") == id)


def by_status(df: DataFrame, status: str) -> DataFrame:
    return df.where(same_text(F.col("status"), status))


def by_job(df: DataFrame, job_name: str) -> DataFrame:
    return df.where(same_text(F.col("job_name"), job_name))


def by_keys(df: DataFrame, **keys: object) -> DataFrame:
    """Several equalities, all of which must hold."""
    for column, value in keys.items():
        df = df.where(_equals(df, column, value))
    return df


def not_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """``!=``; rows with NULL are dropped."""
    return df.where(~_equals(df, column, value))


def between(df: DataFrame, column: str, lo: object = None, hi: object = None) -> DataFrame:
    """``>= lo`` and ``<= hi``; an end that is None is open."""
    if lo is not None:
        df = df.where(F.col(column) >= lo)
    if hi is not None:
        df = df.where(F.col(column) <= hi)
    return df


def _in(df: DataFrame, column: str, values: Iterable[object]) -> Column:
    values = list(values)
    if df.schema[column].dataType.typeName() == "string":
        return in_texts(F.col(column), [str(v) for v in values])
    return F.col(column).isin(values)


def where_in(df: DataFrame, column: str, values: Iterable[object] | DataFrame) -> DataFrame:
    """IN, text without regard to case. Values may be a one-column DataFrame, which becomes a semi join."""
    if isinstance(values, DataFrame):
        wanted = values.toDF("_wanted")
        keys = wanted.select(text_key(wanted, "_wanted").alias("_wanted")).distinct()
        return df.join(keys, text_key(df, column) == F.col("_wanted"), "left_semi")
    return df.where(_in(df, column, values))


def where_not_in(df: DataFrame, column: str, values: Iterable[object]) -> DataFrame:
    return df.where(~_in(df, column, values))


def or_where_in(
    df: DataFrame, parts: Sequence[tuple[str, Sequence[object], bool]]
) -> DataFrame:
    """Several IN tests joined by OR; each part is (column, values, negate)."""
    tests = [(~_in(df, c, v) if negate else _in(df, c, v)) for c, v, negate in parts]
    return or_where(df, *tests)


def or_where(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, conditions))


def where_value(df: DataFrame, column: str, value: object, op: str = "=") -> DataFrame:
    """Comparison by operator text; with value None ``=`` tests IS NULL and ``!=`` IS NOT NULL."""
    c = F.col(column)
    if value is None:
        return df.where(c.isNotNull() if op in ("!=", "<>") else c.isNull())
    tests = {
        "=": lambda: _equals(df, column, value),
        "!=": lambda: ~_equals(df, column, value),
        "<>": lambda: ~_equals(df, column, value),
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
    }
    return df.where(tests[op]())


def grouped(*conditions: Column, op: str = "and", negate: bool = False) -> Column:
    """A bracketed group of predicates joined by AND or OR, optionally negated."""
    joined = reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), conditions)
    return ~joined if negate else joined


def optional(df: DataFrame, condition: Column, given: object) -> DataFrame:
    """Apply a condition only when its argument was given (not None, '' or below 1)."""
    skip = given is None or given == "" or (isinstance(given, int) and given < 1)
    return df if skip else df.where(condition)


def recent(
    df: DataFrame, n_days: int, as_of: str | dt.datetime | Column | None = None,
    column: str = "last_activity",
) -> DataFrame:
    """Rows of the last ``n_days`` days up to ``as_of``, both ends included."""
    end = latest(df, column) if as_of is None else ntz(as_of)
    return df.where(F.col(column).between(end - days(n_days), end))


def latest(df: DataFrame, column: str = "last_activity") -> Column:
    """Largest value of a column as a scalar subquery: the default ``as_of`` of this library."""
    return df.agg(F.max(column)).scalar()


# ---------------------------------------------------------------- users and logins


def active(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col("isDeleted") == 0)


def search_users(df: DataFrame, text: str, columns: Sequence[str] = ("email", "name", "mobile")) -> DataFrame:
    """One text looked for in several columns; ``%`` and ``_`` act as wildcards."""
    return df.where(or_like([F.col(c) for c in columns], text, escape=False))


def login_history(
    logins: DataFrame, user: int = 0, text: str = "", from_: str = "", to: str = ""
) -> DataFrame:
    """Login rows by user, text in the session data and whole days.

    The day range is a range on the raw timestamp, so it reaches the file scan.
    """
    out = optional(logins, like_contains(F.col("sessionData"), text, escape=False), text)
    out = optional(out, F.col("createdDtm") >= day_start(from_), from_)
    out = optional(out, F.col("createdDtm") < next_day_start(to), to)
    return optional(out, F.col("userId") == user, user)


# Columns of the login history.
LOGIN_COLUMNS = ("userId", "sessionData", "machineIp", "userAgent", "agentString", "platform", "createdDtm")


def login_page(
    logins: DataFrame, user: int = 0, text: str = "", from_: str = "", to: str = "", limit: int = 10, offset: int = 0
) -> DataFrame:
    """One page of the login history, newest first."""
    from .paging import page

    found = page(login_history(logins, user, text, from_, to), [("id", "desc")], limit, offset)
    return found.select(*[c for c in LOGIN_COLUMNS if c in found.columns])


# ---------------------------------------------------------------- the run filter

FILTER_START = "2010-01-01"  # fixed value: first day used when only an end day is given


def _listed(values: Sequence[str] | None) -> list[str] | None:
    """The list of a filter, or None when the filter is off: empty, or ``*`` in first place."""
    if not values or values[0] == "*":
        return None
    return list(values)


def filter_runs(
    runs: DataFrame,
    status: Sequence[str] | None = None,
    job_name: Sequence[str] | None = None,
    dimension: Sequence[str] | None = None,
    environment: Sequence[str] | None = None,
    reprocess: int | str | None = "*",
    event_text: str | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Runs that satisfy every given filter.

    Where the table has ``<column>_key`` columns (see ``with_keys``) the list filters use them;
    an equality on a stored column reaches the parquet scan, one on ``upper(column)`` does not.
    Where it has ``start_day`` (see ``with_day``) the date range also names the days, so that a
    table partitioned by day is read in part only.
    Dates are ``dd-mm-yyyy`` and include both days up to 23:59:59. ``as_of`` closes the range
    when only a start is given; by default the latest ``start_time`` of the log does.
    """
    out = runs
    lists = {"status": status, "job_name": job_name, "dimension": dimension, "environment": environment}
    for column, values in lists.items():
        wanted = _listed(values)
        if wanted is None:
            continue
        if f"{column}_key" in runs.columns:
            out = out.where(F.col(f"{column}_key").isin([v.upper() for v in wanted]))
        else:
            out = out.where(in_texts(F.col(column), wanted))
    if reprocess is not None and reprocess != "*":
        out = out.where(F.col("reprocess") == int(reprocess))
    if event_text is not None and event_text not in ("", " "):
        out = out.where(like_contains(F.col("event_text"), event_text))
    if from_date or to_date:
        first = day_start(from_date or FILTER_START)
        if to_date:
            last = day_end(to_date)
        elif as_of:
            last = day_end(as_of)
        else:
            last = latest(runs, "start_time")
        out = out.where(F.col("start_time").between(first, last))
        if "start_day" in runs.columns:
            out = out.where(F.col("start_day").between(first.cast("date"), last.cast("date")))
    return out


KEYED = ("status", "job_name", "dimension", "environment")


def with_keys(runs: DataFrame, columns: Sequence[str] = KEYED) -> DataFrame:
    """Add upper-case key columns when a log is stored, so that filters on it can be pushed down."""
    return runs.withColumns({f"{c}_key": F.upper(F.col(c)) for c in columns})


def with_day(runs: DataFrame) -> DataFrame:
    """Add the day a run started, the partition column of a stored log."""
    return runs.withColumn("start_day", F.to_date("start_time"))


# ---------------------------------------------------------------- layers, mime types, mounts

# Text in a job name or dimension that marks a warehouse layer.
LAYER_PATTERNS = {
    "stg": ("job_name", ["STG"]),
    "dim": ("job_name", ["DIM"]),
    "fact": ("job_name", ["MET", "METRIC", "FATO", "FAT", "FACT"]),
    "dw": ("dimension", ["DW"]),
    "dm": ("dimension", ["DM"]),
}


def in_layer(layer: str) -> Column:
    """Does the run belong to a layer? A run may belong to several."""
    column, patterns = LAYER_PATTERNS[layer]
    tests = [F.upper(F.col(column)).contains(p) for p in patterns]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def layer_flags(runs: DataFrame) -> DataFrame:
    return runs.withColumns({f"is_{name}": in_layer(name) for name in LAYER_PATTERNS})


def mime_match(c: Column, mimes: Sequence[str]) -> Column:
    """A name without slash matches the whole family, one with slash that type only."""
    tests = [same_text(c, m) if "/" in m else F.upper(c).startswith(upper_lit(m + "/")) for m in mimes]
    return reduce(lambda a, b: a | b, tests)


def ignore_rows(
    df: DataFrame, mounts: Sequence[str] = (), types: Sequence[str] = ("tmpfs",),
    devices: Sequence[str] = ("/dev/loop",),
) -> DataFrame:
    """Drop listed mounts, and file systems or devices whose name contains a listed text."""
    out = df.where(~F.col("mount").isin(list(mounts))) if mounts else df
    for t in types:
        out = out.where(~F.col("type").contains(t))
    for d in devices:
        out = out.where(~F.col("filesystem").contains(d))
    return out
