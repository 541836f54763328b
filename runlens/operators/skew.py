"""Join of a large side with a side that holds one row per key, safe for hot keys.

Spark splits an oversized partition of a join by itself, at run time and by its measured size, but only
when both sides come straight out of a shuffle made for the join. A side that was just reduced to one
row per key is already partitioned by that key, so Spark would not shuffle it again and could not split
the other side either. Here the sides meet on a struct of the keys, which no earlier partitioning
covers: both are shuffled once for the join, whatever was done to them before, and a key of any share
of the rows is cut as finely as its partition demands. Nothing is counted or collected beforehand, and
the large side is planned once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key


def meeting_key(df: DataFrame, on: Sequence[str], like: DataFrame | None = None, fold: bool = True) -> Column:
    """The key columns as one value, text without regard to case; NULL if any of them is NULL.

    ``like``: the other side of the join, whose types count."""
    parts = []
    for c in on:
        key = text_key(df, c) if fold else F.col(c)
        if like is not None and like.schema[c].dataType != df.schema[c].dataType:
            key = key.cast(like.schema[c].dataType)
        parts.append(key)
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(known, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))


def join_on_unique(big: DataFrame, unique: DataFrame, on: Sequence[str], how: str = "left", fold: bool = True) -> DataFrame:
    """Join ``big`` with ``unique`` (at most one row per key; text keys without regard to case unless
    ``fold`` is False). A NULL key meets nothing. Columns: keys, rest of ``big``, rest of ``unique``."""
    on = list(on)
    rest = [c for c in big.columns if c not in on]
    others = [] if how in ("left_semi", "left_anti") else [c for c in unique.columns if c not in on]
    left = big.withColumn("_key", meeting_key(big, on, fold=fold))
    right = unique.select(meeting_key(unique, on, big, fold).alias("_key"), *others)
    return left.join(right, "_key", how).select(*on, *rest, *others)
