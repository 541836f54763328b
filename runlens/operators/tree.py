"""Parent/child tables: file catalogue and job dependencies.

Walks go level by level; one level is a join of the current level with the table. Each level is
checkpointed in the shared folder, so plans stay short and lost executors cost one level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_contains
from ..session import cut
from .predicates import mime_match
from .skew import join_on_unique

COMPACT = 50  # levels after which the rows reached so far become one stored table


def _walk(start: DataFrame, step) -> DataFrame:
    """Union of ``start`` and all levels that ``step`` makes from the level before, of any number.

    ``step`` leaves out what has been reached already, so a cycle ends the walk."""
    level = cut(start)
    levels = [level]
    while True:
        level = cut(step(level, reduce(DataFrame.unionByName, levels)))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
        if len(levels) == COMPACT:
            levels = [cut(reduce(DataFrame.unionByName, levels))]


def descendants(tree: DataFrame, root: int, directories_only: bool = False) -> DataFrame:
    """The root and everything below it: (id, parent_id, name, depth, path), each id once.

    The edges are stored once, dealt by parent, so a level shuffles itself and not the table."""
    rows = tree.where(F.col("mime") == "directory") if directories_only else tree
    rows = cut(rows.select("id", "parent_id", "name").where(F.col("id") != F.col("parent_id")).repartition("parent_id"))
    start = tree.where(F.col("id") == root).select(
        "id", "parent_id", "name", F.lit(0).alias("depth"), F.col("name").alias("path")
    )

    def step(level: DataFrame, seen: DataFrame) -> DataFrame:
        above = level.select(
            F.col("id").alias("parent_id"), F.col("depth").alias("_d"), F.col("path").alias("_p")
        )
        # merged: Spark takes the stored edges for as small as their compressed file and would send them to the driver at every level
        below = rows.join(above.hint("merge"), "parent_id").select(
            "id", "parent_id", "name", (F.col("_d") + 1).alias("depth"),
            F.concat_ws("/", "_p", "name").alias("path"),
        )
        return below.join(seen.select("id"), "id", "left_anti").select(*below.columns)

    return _walk(start, step)


def ancestors(tree: DataFrame, ids: int | DataFrame) -> DataFrame:
    """The chain of parents of one id or of a table of ids: (id, ancestor_id, depth), each ancestor once.

    Links double their reach: round k holds the ancestor 2**k levels up of every row, and all chains of up to
    2**k levels grow to twice that. A chain of n levels takes log2(n) rounds, and a cycle ends when a
    round brings nothing new. One row for each id and ancestor: for all ids that is rows times depth."""
    rows = cut(tree.select("id", "parent_id"))
    wanted = ids.toDF("id") if isinstance(ids, DataFrame) else rows.where(F.col("id") == ids).select("id")
    # an id that is no row (above the root) ends the chain and is not an ancestor
    known = rows.join(rows.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    found = cut(known.join(wanted, "id", "left_semi").select("id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")))
    jump = cut(known.where(F.col("parent_id") != F.col("id")).select("id", F.col("parent_id").alias("up")))
    reach = 1
    while True:
        on = jump.select(F.col("id").alias("ancestor_id"), F.col("up"))
        more = join_on_unique(found, on, ["ancestor_id"], "inner").select("id", F.col("up").alias("ancestor_id"), (F.col("depth") + reach).alias("depth"))
        fresh = cut(more.join(found, ["id", "ancestor_id"], "left_anti").groupBy("id", "ancestor_id").agg(F.min("depth").alias("depth")))
        if fresh.isEmpty():
            return found
        found = cut(found.unionByName(fresh))
        twice = jump.select("id", F.col("up").alias("middle"))
        steps = jump.select(F.col("id").alias("middle"), "up")
        jump, reach = cut(join_on_unique(twice, steps, ["middle"], "inner").select("id", "up")), 2 * reach


# ---------------------------------------------------------------- interval labels


def label_tree(tree: DataFrame) -> DataFrame:
    """Interval labels of every row below a root: (id, parent_id, name, mime, depth, path, low, high).

    ``low`` is the chain of ids from the root down, 16 digits each, and ``high`` is what follows all that
    begins with it: a row lies in the subtree of another one if its ``low`` is in the other's range
    [low, high). Chains double their length each round, so a tree of n levels takes log2(n) rounds. A
    root is a row whose parent is itself or no row. Rows on a cycle, or below one, have no root and no label."""
    rows = cut(tree.select("id", "parent_id", "name", "mime"))
    parents = rows.select(F.col("id").alias("parent_id")).distinct().withColumn("there", F.lit(True))
    linked = join_on_unique(rows, parents, ["parent_id"], "left")
    up = F.when((F.col("parent_id") != F.col("id")) & F.col("there"), F.col("parent_id")).alias("up")
    now = cut(linked.select("id", up, F.lit(0).alias("depth"), F.col("name").alias("path"), F.lpad(F.hex("id"), 16, "0").alias("low")))
    left = now.where("up is not null").count()
    while left:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("path").alias("p"), F.col("low").alias("l"))
        grown = join_on_unique(now.where("up is not null"), above, ["up"], "inner").select(
            "id", F.col("next").alias("up"), (F.col("depth") + F.col("d") + 1).alias("depth"), F.concat_ws("/", "p", "path").alias("path"), F.concat("l", "low").alias("low"),
        )
        now = cut(now.where("up is null").unionByName(grown))
        before, left = left, now.where("up is not null").count()
        if left == before:  # depths have no gaps: what is left has no root
            break
    named = rows.join(now.where("up is null").drop("up"), "id")
    return named.select("id", "parent_id", "name", "mime", "depth", "path", "low", F.concat("low", F.lit("g")).alias("high"))  # g follows the digits


def store_labels(labels: DataFrame, path: str) -> None:
    """Write labels in the order of ``low``: a subtree lies in neighbouring files, and a range of ``low`` reads only those."""
    labels.repartitionByRange("low").sortWithinPartitions("low").write.parquet(path)


def labelled_descendants(labels: DataFrame, root: int, directories_only: bool = False) -> DataFrame:
    """``descendants`` as one range of stored labels; the label of the root is read first (eager). A root without a
    label has none."""
    own = labels.where(F.col("id") == root).first()
    if own is None:
        return labels.limit(0).select("id", "parent_id", "name", "depth", "path")
    inside = labels.where((F.col("low") >= own["low"]) & (F.col("low") < own["high"]))
    if directories_only:
        # a directory below a plain row is not reached by directories alone: none of its chain may be plain
        plain = inside.where((F.col("mime") != "directory") & (F.col("id") != root)).select(F.col("low").alias("chain"))
        rows = inside.where((F.col("mime") == "directory") | (F.col("id") == root))
        chain = F.explode(F.transform(F.sequence(F.lit(len(own["low"]) // 16), (F.length("low") / 16).cast("int")), lambda n: F.substring("low", F.lit(1), n * 16)))
        cut_off = rows.select("id", chain.alias("chain")).join(plain, "chain", "left_semi").select("id").distinct()
        inside = rows.join(cut_off, "id", "left_anti")
    start = len(own["path"]) - len(own["name"] or "") + 1
    return inside.select("id", "parent_id", "name", (F.col("depth") - own["depth"]).alias("depth"), F.substring("path", start, 2**31 - 1).alias("path"))


def children_with_flag(tree: DataFrame, parent: int | None = None) -> DataFrame:
    """Children of a directory (or all rows) with ``dirs`` = 1 when they hold a directory."""
    rows = tree if parent is None else tree.where(F.col("parent_id") == parent)
    holders = (
        tree.where(F.col("mime") == "directory").select(F.col("parent_id").alias("id")).distinct()
        .withColumn("_has", F.lit(1))
    )
    return rows.join(holders, "id", "left").withColumn("dirs", F.coalesce("_has", F.lit(0))).drop("_has")


def list_dir(tree: DataFrame, id: int) -> DataFrame:
    return children_with_flag(tree, id)


def search_tree(
    tree: DataFrame, root: int | None = None, text: str = "", mimes: Sequence[str] = (), labels: DataFrame | None = None
) -> DataFrame:
    """Entries whose mime type (if given, else name) matches, below a directory or anywhere.

    Below a directory each hit also gets its full path. With ``labels`` the directories are one range of them, without
    they are found level by level.
    """
    test = mime_match(F.col("mime"), mimes) if mimes else like_contains(F.col("name"), text)
    hits = tree.where(test)
    if root is None:
        return hits
    folders = descendants(tree, root, directories_only=True) if labels is None else labelled_descendants(labels, root, True)
    inside = folders.select(F.col("id").alias("parent_id"), F.col("path").alias("_p"))
    found = join_on_unique(hits.where(F.col("id") != root), inside, ["parent_id"], "inner")
    return found.withColumn("path", F.concat_ws("/", "_p", "name")).select(*tree.columns, "path")


def merge_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of both tables, each once."""
    return a.union(b).distinct()


def child_edges(jobs: DataFrame) -> DataFrame:
    """Job and comma-joined children → one row (job, child) each."""
    children = F.explode(F.transform(F.split("children", ","), lambda c: F.trim(c)))
    return jobs.select("job", children.alias("child")).where(F.col("child") != "").distinct()


def job_closure(edges: DataFrame, root: str) -> DataFrame:
    """Jobs that a job starts directly or through others, with the fewest steps to each.

    Jobs already reached are left out of the next level, so cycles end. The edges usually come out
    of job documents; they are checkpointed, so the documents are read once and not per level.
    """
    pairs = cut(edges.select("job", "child"))
    start = pairs.where(F.col("job") == root).select(F.col("child").alias("job")).distinct()
    start = start.where(F.col("job") != root).withColumn("depth", F.lit(1))

    def step(level: DataFrame, seen: DataFrame) -> DataFrame:
        reached = pairs.join(level.select("job"), "job", "left_semi").select(F.col("child").alias("job")).distinct()
        fresh = reached.join(seen.select("job"), "job", "left_anti").where(F.col("job") != root)
        # the depth is the same for the whole level: one scalar instead of a join
        return fresh.withColumn("depth", level.agg(F.max("depth") + 1).scalar())

    return _walk(start, step)
