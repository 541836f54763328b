"""Order, top-k, pages and grids."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 10  # fixed value: rows per page of the user and login lists
DEEP = 10_000  # rows that a page may have to sort
SAMPLE, RANGES = 4096, 16  # values that cut a column, and the ranges they make


def _order(order: Sequence[tuple[str, str]]) -> list[Column]:
    return [F.col(c).desc() if d.lower() == "desc" else F.col(c).asc() for c, d in order]


def sort(df: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    """ORDER BY with a direction per column; NULL comes first ascending, last descending."""
    return df.orderBy(*_order(order))


def shuffle_rows(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed) if seed is not None else F.rand())


def latest_rows(df: DataFrame, k: int = 6, by: str = "id") -> DataFrame:
    """The k rows with the largest ``by``: a top-k per task, then a top-k of those."""
    return df.orderBy(F.col(by).desc()).limit(k)


def page(
    df: DataFrame, order: Sequence[tuple[str, str]], limit: int = PAGE_SIZE, offset: int = 0
) -> DataFrame:
    """One page. The order must be total, otherwise pages can overlap. A page beyond the first ``DEEP`` rows is
    found by ``narrowed`` (eager counts) and sorts its own range only."""
    if offset + limit > DEEP:
        df, offset, _ = narrowed(df, order, limit, offset)
    ordered = df.orderBy(*_order(order))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def _ranges(df: DataFrame, column: str, values: list, direction: str) -> list[Column]:
    """Conditions that share out all rows, in the order of the column: NULL, then what lies below, at and
    between the values. Every second one, from the first on, holds equal rows only."""
    c, kind = F.col(column), df.schema[column].dataType
    # a time without zone must not pass through the zone of the driver
    bounds = [F.lit(str(v)).cast(kind) if kind.typeName() == "timestamp_ntz" else F.lit(v).cast(kind) for v in values]
    ranges = [c.isNull(), c < bounds[0]]
    for low, high in zip(bounds, [*bounds[1:], None]):
        ranges += [c == low, c > low if high is None else (c > low) & (c < high)]
    return ranges[::-1] if direction.lower() == "desc" else ranges


def narrowed(
    df: DataFrame, order: Sequence[tuple[str, str]], limit: int, offset: int
) -> tuple[DataFrame, int, int]:
    """The rows of a range that holds the page, the offset within them, and the number of all rows.

    A sample of one column gives RANGES values, one pass counts the rows at and between them, and the
    ranges that the page touches are kept as a condition on the raw column, which reaches the file scan; again until
    at most ``DEEP`` rows are left. A page among equal rows goes on with the next column. Each
    round reads about a RANGES-th of the one before. A page across the end of a very common value
    sorts all rows of that value."""
    total, columns = None, list(order)
    for seed in range(64):
        if not columns:
            break
        column, direction = columns[0]
        sample = df.select(column).where(F.col(column).isNotNull()).orderBy(F.rand(seed)).limit(SAMPLE).collect()
        values = sorted(r[0] for r in sample if r[0] == r[0]) + [r[0] for r in sample if r[0] != r[0]]  # NaN comes last
        if not values:  # nothing but NULL
            total = df.count() if total is None else total
            columns.pop(0)
            continue
        bounds = list({repr(values[len(values) * i // RANGES]): values[len(values) * i // RANGES] for i in range(RANGES)}.values())
        ranges = _ranges(df, column, bounds, direction)
        counts = df.agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(f"n{i}") for i, r in enumerate(ranges)]).first()
        total = sum(counts) if total is None else total
        ends = list(itertools.accumulate(counts))
        first = next((i for i, end in enumerate(ends) if end > offset), len(ranges) - 1)
        last = next((i for i, end in enumerate(ends) if end >= offset + limit), len(ranges) - 1)
        before, size = sum(counts), sum(counts[first : last + 1])
        df, offset = df.where(reduce(lambda x, y: x | y, ranges[first : last + 1])), offset - (ends[first] - counts[first])
        if size <= max(DEEP, 4 * limit) or size == before and first < last:
            break
        place = len(ranges) - 1 - first if direction.lower() == "desc" else first
        if first == last and place % 2 == 0:
            columns.pop(0)  # equal rows
    return df, offset, df.count() if total is None else total


def page_after(df: DataFrame, key: str, last_seen: object, limit: int = PAGE_SIZE, direction: str = "desc") -> DataFrame:
    """The page that follows the last key seen; the key range reaches the file scan."""
    beyond = F.col(key) < last_seen if direction == "desc" else F.col(key) > last_seen
    return df.where(beyond).orderBy(*_order([(key, direction)])).limit(limit)


def page_with_total(
    df: DataFrame, order: Sequence[tuple[str, str]], limit: int = PAGE_SIZE, offset: int = 0
) -> DataFrame:
    """One page with the number of all matching rows in ``total``. For a deep page the total comes from the
    counts that find it."""
    if offset + limit > DEEP:
        inside, rest, total = narrowed(df, order, limit, offset)
        return inside.orderBy(*_order(order)).offset(rest).limit(limit).withColumn("total", F.lit(total).cast("long"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return page(df, order, limit, offset).withColumn("total", total)


def grid(
    df: DataFrame, text: str = "", order: Sequence[tuple[str, str]] | None = None,
    limit: int = PAGE_SIZE, offset: int = 0,
) -> DataFrame:
    """Grid view: every word of the search must occur in some shown column; second column
    descending by default."""
    shown = F.lower(F.concat_ws("  ", *[F.col(c).cast("string") for c in df.columns]))
    for word in text.lower().split():
        df = df.where(shown.contains(word))
    second = df.columns[1] if len(df.columns) > 1 else df.columns[0]
    return page(df, order or [(second, "desc"), (df.columns[0], "asc")], limit, offset)


def row_at(df: DataFrame, key: str, which: str = "first", current: object = None) -> DataFrame:
    """First or last row by a key, or the row next to a current key.

    Each is a top-1 over the whole table, never a window over one global partition.
    """
    asc, desc = F.col(key).asc(), F.col(key).desc()
    if which == "first":
        return df.orderBy(asc).limit(1)
    if which == "last":
        return df.orderBy(desc).limit(1)
    if which == "next":
        return df.where(F.col(key) > current).orderBy(asc).limit(1)
    return df.where(F.col(key) < current).orderBy(desc).limit(1)
