"""Date and duration expressions. Wall-clock columns are ``timestamp_ntz``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up

DAY_MS = 86_400_000


def ntz(value: str | dt.datetime | Column) -> Column:
    """A timestamp without zone from text, datetime or Column."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def month_no(c: Column) -> Column:
    return F.month(c)


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def day_of(c: Column) -> Column:
    return F.to_date(c)


def _day(value: str | Column) -> Column:
    c = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.try_to_date(c, "dd-MM-yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def day_start(value: str | Column) -> Column:
    """First moment of a day given as ``dd-mm-yyyy`` or ISO text."""
    return _day(value).cast("timestamp_ntz")


def day_end(value: str | Column) -> Column:
    """23:59:59 of a day; fractions of the last second lie outside, as in the run filter."""
    return day_start(value) + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59))


def next_day_start(value: str | Column) -> Column:
    return day_start(value) + days(1)


def ordinal_day(c: Column) -> Column:
    """1st, 2nd, 3rd, 4th …, 11th, 12th, 13th."""
    d = F.day(c)
    suffix = (
        F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd")
        .when(d % 10 == 3, "rd").otherwise("th")
    )
    return F.concat(d.cast("string"), suffix)


def fmt_ts(c: Column, style: str = "short") -> Column:
    """``short`` = 01-31-2024 13:05:09; ``long`` = Wednesday, January 31st 2024;
    ``moment`` = January 31st 2024, 1:05:09 pm."""
    if style == "short":
        return F.date_format(c, "MM-dd-yyyy HH:mm:ss")
    if style == "long":
        return F.concat(
            F.date_format(c, "EEEE, MMMM "), ordinal_day(c), F.date_format(c, " yyyy")
        )
    return F.concat(
        F.date_format(c, "MMMM "), ordinal_day(c), F.date_format(c, " yyyy, h:mm:ss "),
        F.lower(F.date_format(c, "a")),
    )


EPOCH = "1970-01-01 00:00:00"


def to_epoch(c: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock timestamp or of text ``YYYY-MM-DD HH:MM:SS``.

    Wall-clock times are subtracted as such, so daylight saving of the session's zone plays no part.
    """
    since = (c.cast("timestamp_ntz") - ntz(EPOCH)).cast("interval second")
    return F.floor(since.cast("decimal(18,6)")).cast("bigint")


def ms_to_ts(c: Column) -> Column:
    """Milliseconds since 1970 as wall-clock time in UTC, whatever the session's time zone."""
    seconds = (c.cast("decimal(18,0)") / 1000).cast("decimal(18,6)")
    return ntz(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def running_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two moments, fractions of both sides dropped."""
    return F.abs(to_epoch(end) - to_epoch(start))


def _second_start(c: Column) -> Column:
    return ntz(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), to_epoch(c).cast("decimal(18,6)"))


def running_text(start: Column, end: Column) -> Column:
    """``D days, HH hours, MM minutes, SS seconds`` where whole months are left out of D."""
    a, b = _second_start(F.least(start, end)), _second_start(F.greatest(start, end))
    span = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    months = span - F.when(a + F.make_ym_interval(F.lit(0), span) > b, 1).otherwise(0)
    rest = to_epoch(b) - to_epoch(a + F.make_ym_interval(F.lit(0), months))
    return F.format_string(
        "%d days, %02d hours, %02d minutes, %02d seconds",
        F.floor(rest / 86400), F.floor(rest % 86400 / 3600), F.floor(rest % 3600 / 60), rest % 60,
    )


def ms_text(c: Column, wrap: bool = True) -> Column:
    """Milliseconds as hours to milliseconds text; ``wrap`` starts again after 24 hours."""
    ms = c % DAY_MS if wrap else c
    return F.format_string(
        "%02d Hours,  %02d Minutes,  %02d Seconds,  %03d Miliseconds.",
        F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000),
        ms % 1000,
    )


def _pieces(sec: Column, units: list[tuple[str, int]]) -> list[Column]:
    """One text per unit, NULL when its count is zero."""
    out, rest = [], sec
    for name, size in units:
        n = F.floor(rest / size)
        label = F.when(n == 1, F.lit(f" {name}")).otherwise(F.lit(f" {name}s"))
        out.append(F.when(n > 0, F.concat(n.cast("string"), label)))
        rest = rest % size
    return out


# Unit sizes in seconds of the two elapsed-time texts.
UPTIME_UNITS = [("year", 31_536_000), ("day", 86_400), ("hour", 3_600), ("minute", 60)]
TIMESPAN_UNITS = [
    ("Year", 31_557_600), ("Month", 2_629_743), ("Week", 604_800), ("Day", 86_400),
    ("Hour", 3_600), ("Minute", 60),
]


def human_time(sec: Column) -> Column:
    """``1 year, 57 days, 23 hours and 33 minutes``; NULL below one minute."""
    parts = F.array_compact(F.array(*_pieces(sec, UPTIME_UNITS)))
    lead = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", ")
    last = F.try_element_at(parts, F.lit(-1))
    return (
        F.when(F.size(parts) > 1, F.concat(lead, F.lit(" and "), last))
        .when(F.size(parts) == 1, last)
    )


def timespan(sec: Column, units: int = 7) -> Column:
    """Elapsed seconds as at most ``units`` texts; seconds are shown only below one minute."""
    s = F.greatest(sec, F.lit(1))
    parts = F.slice(F.array_compact(F.array(*_pieces(s, TIMESPAN_UNITS))), 1, units)
    seconds = F.concat(s.cast("string"), F.when(s > 1, " Seconds").otherwise(" Second"))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(seconds)


def days_in_month(c: Column) -> Column:
    return F.day(F.last_day(c))


def date_spine(first: Column, last: Column) -> Column:
    """One row per day, both ends included (use in ``select``)."""
    return F.explode(F.sequence(F.to_date(first), F.to_date(last), F.expr("INTERVAL 1 DAY")))


def parse_date(c: Column) -> Column:
    """``YYYYMM``/``MMYYYY``, ``YYYYMMDD``, ``M-D-YYYY`` or ISO text → date, else NULL."""
    six = c.rlike(r"^\d{6}$")
    year_first = F.substring(c, 1, 2).isin("19", "20")
    return (
        F.when(six & year_first, F.try_to_date(c, "yyyyMM"))
        .when(six, F.try_to_date(c, "MMyyyy"))
        .when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
        .when(c.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(c, "M-d-yyyy"))
        .otherwise(c.try_cast("date"))
    )


def cron_fields(c: Column) -> Column:
    """Schedule text → struct of its five fields; a text such as ``@daily`` goes to ``tag``."""
    tagged = c.startswith("@")
    parts = F.split(c, " ")
    names = ["minute", "hour", "day_of_month", "month", "day_of_week"]
    fields = [F.when(~tagged, F.try_element_at(parts, F.lit(i + 1))).alias(n) for i, n in enumerate(names)]
    return F.struct(*fields, F.when(tagged, c).alias("tag"))


def percent_of(part: Column, total: Column) -> Column:
    """Percent of a total, halves rounded up, NULL for total 0."""
    return half_up(F.try_divide(part * 100, total))
