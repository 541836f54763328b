"""Rounding, sizes and utilisation arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Nearest whole number, halves towards plus infinity (``-2.5`` → ``-2``)."""
    return F.floor(c + F.lit(0.5))


def _plain(c: Column) -> Column:
    """Two decimals at most, no trailing zeros."""
    return F.regexp_replace(F.round(c, 2).cast("decimal(24,2)").cast("string"), r"\.?0+$", "")


# Unit letters of the two size texts.
SIZE_UNITS = ["", "K", "M", "G", "T", "P", "E"]
BYTE_UNITS = [("TB", 10**12, 2**40), ("GB", 10**9, 2**30), ("MB", 10**6, 2**20), ("KB", 10**3, 2**10)]


def human_size(c: Column) -> Column:
    """Bytes with a unit; the next unit starts strictly above 1024."""
    out = F.concat(_plain(c.cast("double")), F.lit(" B"))
    for power in range(1, len(SIZE_UNITS)):
        scaled = F.concat(_plain(c / F.lit(float(1024**power))), F.lit(f" {SIZE_UNITS[power]}B"))
        out = F.when(c > F.lit(1024**power), scaled).otherwise(out)
    return out


def byte_format(c: Column, precision: int = 1) -> Column:
    """Bytes with a unit chosen at powers of 1000 but divided by powers of 1024."""
    out = F.concat(F.format_number(c, 0), F.lit(" Bytes"))
    for unit, start, size in reversed(BYTE_UNITS):
        scaled = F.format_number(F.round(c / F.lit(float(size)), precision), precision)
        out = F.when(c >= start, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


def percent_used(free: Column, total: Column) -> Column:
    """Used share in percent; 0 when the total is 0."""
    return F.when(total > 0, 100 - half_up(free / total * 100)).otherwise(F.lit(0)).cast("bigint")


def load_pct(load: Column, cores: Column) -> Column:
    """Load per core in percent, cut to a whole number and capped at 100."""
    return F.least((load.cast("double") * 100 / cores).cast("bigint"), F.lit(100).cast("bigint"))
