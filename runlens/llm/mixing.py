"""Mixing documents to target weights by iterative proportional fitting.

Tokens are counted in cells of (source, language, topic). An axis has either targets by category, and
categories without one of their own share one, or a power: then every category found is a cell of its
own and its target is its tokens to that power (1: as they are, 0: all equal). More than MAX_CELLS cells are
refused. The cells reach the driver and are raked to the three marginals in turn. The fitted weight of its cell is
a document's probability, found by a join with the small table of cells, and a hash of its id draws it.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

OTHER = "(other)"  # every category without a target of its own, and null
MAX_CELLS = 100_000  # cells with rows; more are refused, so the table of cells may be broadcast
ROUNDS = 200
CLOSE = 1e-12  # largest relative error of a marginal at which raking ends
LARGEST = 1e6  # bound of a weight, for targets that can't be reached


def token_count(text: Column) -> Column:
    """Words, parted at blanks, tabs and line ends; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\r\n]+"), lambda w: w != "")).cast("long")


#: Shares by category, or the power of a category's own tokens.
Targets = Mapping[str, float] | float


def category(column: Column, targets: Targets) -> Column:
    if not isinstance(targets, Mapping):
        return F.coalesce(column, F.lit(OTHER))
    named = [k for k in targets if k != OTHER]
    return F.when(column.isin(named), column).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def rake(cells: np.ndarray, marginals: list[np.ndarray], keep: float, rounds: int = ROUNDS) -> np.ndarray:
    """A weight for each cell so that ``cells * min(weight, 1)`` has ``keep`` of all tokens and the
    ``marginals``.

    A category without tokens can't get any: its share goes to the others of its axis in proportion.
    Where more is asked of a category than it has, all of it is kept, and the marginals come as close as
    raking gets. Axes are fitted in their order."""
    total = cells.sum()
    axes = range(cells.ndim)
    weights = np.full(cells.shape, float(keep))
    if not total:
        return weights
    goals = []
    for k in axes:
        has = cells.sum(axis=tuple(a for a in axes if a != k)) > 0
        goal = np.where(has, marginals[k], 0.0)
        if goal.sum() <= 0:
            raise ValueError("no category with a target has any tokens")
        goals.append(goal / goal.sum() * total * keep)
    for _ in range(rounds):
        worst = 0.0
        for k in axes:
            now = (cells * np.minimum(weights, 1.0)).sum(axis=tuple(a for a in axes if a != k))
            ratio = np.divide(goals[k], now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(ratio - 1).max(initial=0)))
            weights = np.minimum(weights * ratio.reshape([-1 if a == k else 1 for a in axes]), LARGEST)
        if worst < CLOSE:
            break
    return weights


def uniform(doc_id: Column, seed: str) -> Column:
    """A number from 0 up to 1 that only the id and the seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Mapping[str, Targets], topic: Column, keep: float = 0.5, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with ``tokens``, ``weight``, ``probability`` and ``selected``.

    ``targets`` has shares by category, or a power, for ``source``, ``lang`` and ``topic``; shares of an axis are
    scaled to one. A weight is at most LARGEST, which only those of unreachable targets are. The selected documents are expected to have ``keep`` of all tokens with these
    marginals, as far as there are enough (see ``rake``). Documents without tokens take the
    probability of their cell, and ``keep`` where it has no tokens at all. Nulls count as other;
    repeated rows are drawn alike, since the id decides; an empty table gives no rows. Columns of
    ``docs`` with the four new names are replaced."""
    axes = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    keyed = docs.select(*[category(c, targets[a]).alias(a) for a, c in axes.items()], token_count(F.col("text")).alias("tokens"))
    counted = keyed.groupBy(*axes).agg(F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).collect()
    names = {a: sorted({*t, OTHER} if isinstance(t, Mapping) else {OTHER, *[r[a] for r in counted]}) for a, t in targets.items()}
    if len(counted) > MAX_CELLS or np.prod([len(n) for n in names.values()]) > 100 * MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of targets")
    cells = np.zeros([len(names[a]) for a in axes])
    at = [tuple(names[a].index(r[a]) for a in axes) for r in counted]
    for place, r in zip(at, counted):
        cells[place] = r["tokens"]
    goals = []
    for k, a in enumerate(axes):
        own = cells.sum(axis=tuple(x for x in range(3) if x != k))
        goals.append(np.array([targets[a].get(c, 0.0) for c in names[a]]) if isinstance(targets[a], Mapping) else np.where(own > 0, own, 1.0) ** targets[a] * (own > 0))
    weights = rake(cells, goals, keep)

    rows = [(*(names[a][i] for a, i in zip(axes, place)), float(weights[place]) if cells[place] else keep) for place in at]
    keys = unused(docs.columns, *axes)
    fitted = docs.sparkSession.createDataFrame(rows, ", ".join(f"{k} string" for k in keys) + ", weight double")
    own = [c for c in docs.columns if c not in ("tokens", "weight", "probability", "selected")]
    placed = docs.select(*own, token_count(F.col("text")).alias("tokens"), *[category(c, targets[a]).alias(k) for k, (a, c) in zip(keys, axes.items())])
    out = placed.join(F.broadcast(fitted), keys, "left").select(*own, "tokens", "weight")
    out = out.withColumn("probability", F.least(F.col("weight"), F.lit(1.0)))
    return out.withColumn("selected", (uniform(F.col("doc_id"), seed) < F.col("probability")).cast("int"))
