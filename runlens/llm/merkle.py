"""Merkle manifest of a dataset: a tree of digests for each group of rows, and a tree over the groups.

Leaves are numbered in order within their group and cut into aligned subtrees of 2**height leaves (1024), the
blocks. A block is one row that keeps all digests of its subtree in van Emde Boas layout: a tree of so
many levels is split at half its height, the top tree comes first, then the bottom trees from left to
right, each laid out in the same way. The place of a node follows from its depth and number alone, so
building and looking up siblings need no pointers and touch few cache lines whatever a line's size.

The roots of a group's blocks are the leaves of its next level, again in blocks, until one is left: the
group's root. These roots, in order of the groups, make the top tree by the same steps. Proofs come down
the same way: a block hands each of its leaves the siblings within the block and all those above it.

A node is the lower-case hex sha256 of its children's hex digests one after the other; a last node
without a neighbour goes up as the digest of itself alone. Tables keep digests as 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, trimmed

HEIGHT = 10  # levels of a block above its leaves, unless told otherwise
SIZE = 32
#: One step of a proof: where the sibling stands, then its digest.
STEP = 1 + SIZE
NONE, RIGHT, LEFT = 0, 1, 2
WHOLE = "all"  # the one group of the top tree


def digest_of(*columns: str | Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else its number of UTF-8 bytes, ``:`` and the field."""
    fields = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    texts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (0: the root) in the layout of a tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    bottom, below = levels - top, depth - top
    first = (1 << top) - 1 + (index >> below) * ((1 << bottom) - 1)
    return first + address(bottom, below, index & ((1 << below) - 1))


def count_at(n: int, height: int, depth: int) -> int:
    """Nodes at ``depth`` of a tree of ``height`` over ``n`` leaves."""
    return -(-n >> (height - depth))


def build(leaves: np.ndarray, height: int) -> np.ndarray:
    """All digests (rows of 32 bytes) over ``leaves``, in van Emde Boas layout."""
    n, levels = len(leaves), height + 1
    nodes = np.zeros(((1 << levels) - 1, SIZE), np.uint8)
    nodes[address(levels, height, np.arange(n))] = leaves
    for depth in range(height - 1, -1, -1):
        children = address(levels, depth + 1, np.arange(count_at(n, height, depth + 1)))
        text = nodes[children].tobytes().hex().encode()
        parents = [hashlib.sha256(text[i : i + 4 * SIZE]).digest() for i in range(0, len(text), 4 * SIZE)]
        nodes[address(levels, depth, np.arange(len(parents)))] = np.frombuffer(b"".join(parents), np.uint8).reshape(-1, SIZE)
    return nodes


def siblings(nodes: np.ndarray, n: int, height: int) -> np.ndarray:
    """The proof of each leaf within a block: (n, height, STEP) bytes, lowest step first."""
    steps = np.zeros((n, height, STEP), np.uint8)
    for k in range(height):
        depth = height - k
        own = np.arange(n) >> k
        other = own ^ 1
        there = other < count_at(n, height, depth)
        steps[:, k, 0] = np.where(there, np.where(own & 1, LEFT, RIGHT), NONE)
        steps[there, k, 1:] = nodes[address(height + 1, depth, other[there])]
    return steps


def fold(leaf: bytes, path: bytes) -> tuple[bytes, bytes]:
    """(root that a leaf and its proof lead to, digest of the proof's siblings)."""
    now, text, seen = leaf.hex(), path.hex(), []
    for i in range(0, len(text), 2 * STEP):
        side, other = text[i + 1], text[i + 2 : i + 2 * STEP]
        if side == "0":
            both = now
        else:
            seen.append(other)
            both = other + now if side == "2" else now + other
        now = hashlib.sha256(both.encode()).hexdigest()
    return bytes.fromhex(now), hashlib.sha256("".join(seen).encode()).digest()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition, the number of their group in it and their place in the group's part."""
    part, last, group_no, before = TaskContext.get().partitionId(), None, -1, 0
    for batch in batches:
        groups, n = batch.column("group"), batch.num_rows
        if not n:
            continue
        codes = np.asarray(groups.dictionary_encode().indices)
        new = np.append(groups[0].as_py() != last, codes[1:] != codes[:-1])
        numbers = group_no + np.cumsum(new)
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        at = np.arange(n) - begin + np.where(numbers == group_no, before, 0)
        last, group_no, before = groups[n - 1].as_py(), int(numbers[-1]), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(numbers), pa.array(at)], names=[*batch.schema.names, "part", "group_no", "at"])


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 in the order of ``order`` within ``group`` (its first column).

    Ranges of the whole order are sorted apart, so a large group is spread over as many tasks as its
    share; for each range the driver gets the sizes of its first and last group only."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = spread.withColumns({c: F.lit(0).cast("long") for c in ("part", "group_no", "at")}).schema
    placed = saved(spread.mapInArrow(_numbered, schema), name)
    counts = placed.groupBy("part", "group_no", "group").count().withColumn("last", F.max("group_no").over(Window.partitionBy("part")))
    ends: dict[int, list] = {}
    for row in counts.where("group_no = 0 or group_no = last").collect():
        ends.setdefault(row["part"], []).append(row)
    before, open_group, total = [], None, 0
    for part in sorted(ends):
        first, last = min(ends[part], key=lambda r: r["group_no"]), max(ends[part], key=lambda r: r["group_no"])
        if first["group"] != open_group:
            total = 0
        before.append((part, total))
        total = last["count"] + (total if first is last else 0)
        open_group = last["group"]
    starts = rows.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("at") + F.when(F.col("group_no") == 0, F.col("before")).otherwise(0)
    # one row for each range
    return placed.join(F.broadcast(starts), "part").withColumn("rank", rank).drop("part", "group_no", "at", "before")


@dataclass
class Manifest:
    """Blocks of every level, the groups' trees first. A block: group, block (number in its level), n, height, nodes,
    keys and claimed of its leaves. ``roots``: one row a group. ``height``: of full blocks."""

    height: int
    levels: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None
    top: Manifest | None = None
    root: bytes | None = None  # of the top tree; None for an empty table


def _blocks(rows: DataFrame, name: str, full: int) -> DataFrame:
    """Rows (group, rank, key, leaf, claimed) to stored blocks."""
    key_type = rows.schema["key"].dataType.simpleString()
    schema = f"group string, block long, n int, height int, root binary, nodes binary, keys array<{key_type}>, claimed array<binary>"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank").combine_chunks()
        n, block = t.num_rows, t["rank"][0].as_py() >> full
        # a first block that isn't full is alone and as high as it must be
        height = full if block or n == 1 << full else (n - 1).bit_length()
        nodes = build(np.frombuffer(b"".join(t["leaf"].to_pylist()), np.uint8).reshape(-1, SIZE), height)
        lists = [pa.ListArray.from_arrays([0, n], t[c].combine_chunks()) for c in ("key", "claimed")]
        cols = [pa.array([t["group"][0].as_py()]), pa.array([block]), pa.array([n], pa.int32()), pa.array([height], pa.int32()), pa.array([nodes[0].tobytes()]), pa.array([nodes.tobytes()]), *lists]
        return pa.table(cols, names=["group", "block", "n", "height", "root", "nodes", "keys", "claimed"])

    return saved(rows.withColumn("block", F.shiftright("rank", full)).groupBy("group", "block").applyInArrow(run, schema), name)


def _grown(rows: DataFrame, name: str, height: int) -> Manifest:
    """Levels of blocks over ranked rows, until every group has one root."""
    made, more = Manifest(height), f"block > 0 or n = {1 << height}"
    while True:
        blocks = _blocks(rows, f"{name}-{len(made.levels)}", height)
        made.levels.append(blocks)
        ended = blocks.where(f"not ({more})").select("group", "root")
        made.roots = ended if made.roots is None else made.roots.unionByName(ended)
        above = blocks.where(more)
        if above.isEmpty():
            return made
        nothing = F.lit(None).cast("binary").alias("claimed")
        rows = above.select("group", F.col("block").alias("rank"), F.col("block").alias("key"), F.col("root").alias("leaf"), nothing)


def build_manifest(rows: DataFrame, height: int = HEIGHT) -> Manifest:
    """Manifest of ``rows``: group (text), key (long), leaf (32 bytes), and ``claimed``, the digest that a row
    claims now instead (null: the same).

    Leaves ascend by key within a group, a null key first; rows with one key go by leaf, then claimed, so
    repeated rows are leaves of their own in a defined order. Groups go by UTF-8 bytes, a null group first
    and apart from an empty one. An empty table has no root. Other columns are left out."""
    spark: SparkSession = rows.sparkSession
    # a text that sorts as the group and has a place for null
    group = F.when(F.col("group").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("group"))).alias("group")
    leaves = saved(rows.select(group, F.col("key").cast("long").alias("key"), "leaf", "claimed"), "merkle-leaves")
    made = _grown(ranked(leaves, ["group", "key", "leaf", "claimed"], "merkle-ranks"), "merkle", height)
    made.roots = saved(made.roots, "merkle-roots")
    tops = made.roots.select(F.lit(WHOLE).alias("group"), F.col("group").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("claimed"))
    made.top = _grown(ranked(tops, ["group", "key"], "merkle-groups"), "merkle-top", height)
    root = made.top.roots.first()
    made.root = bytes(root["root"]) if root else None
    return made


def _descend(made: Manifest, above: DataFrame, name: str) -> DataFrame:
    """(group, key, leaf, claimed, path, subroot) of every leaf. ``above``: (group, path, subroot) of each group."""
    for level in range(len(made.levels) - 1, -1, -1):
        blocks = made.levels[level]
        lone = blocks.where(f"block = 0 and n < {1 << made.height}").select("group", "block").join(above, "group")
        paths = lone.select("group", "block", "path", "subroot")
        if level + 1 < len(made.levels):
            paths = paths.unionByName(parents.select("group", F.col("key").alias("block"), "path", "subroot"))  # noqa: F821
        key_type = blocks.schema["keys"].dataType.elementType.simpleString()
        schema = f"group string, key {key_type}, leaf binary, claimed binary, path binary, subroot binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    n, height = row.column("n")[0].as_py(), row.column("height")[0].as_py()
                    nodes = np.frombuffer(row.column("nodes")[0].as_py(), np.uint8).reshape(-1, SIZE)
                    upper = np.frombuffer(row.column("path")[0].as_py(), np.uint8)
                    steps = np.empty((n, height * STEP + len(upper)), np.uint8)
                    steps[:, : height * STEP] = siblings(nodes, n, height).reshape(n, -1)
                    steps[:, height * STEP :] = upper
                    leaves = nodes[address(height + 1, height, np.arange(n))]
                    same = lambda c: pa.array([row.column(c)[0].as_py()] * n)  # noqa: B023, E731
                    bytes_of = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
                    yield pa.RecordBatch.from_arrays([same("group"), row.column("keys").flatten(), bytes_of(leaves), row.column("claimed").flatten(), bytes_of(steps), same("subroot")], names=["group", "key", "leaf", "claimed", "path", "subroot"])

        met = blocks.drop("root").join(paths, ["group", "block"]).select("group", "n", "height", "nodes", "keys", "claimed", "path", "subroot")
        parents = met.mapInArrow(trimmed(run), schema)
        if level:
            parents = saved(parents, f"{name}-{level}")
    return parents


def proofs(made: Manifest) -> DataFrame:
    """Every leaf with its proof: group, key, leaf, claimed, path (steps of one byte for the side, 0 none, 1
    right, 2 left, and 32 bytes), subroot and root."""
    start = made.top.roots.select("group", F.lit(b"").alias("path"), F.col("root").alias("subroot"))
    tops = _descend(made.top, start, "merkle-top-paths").select(F.col("key").alias("group"), "path", F.col("leaf").alias("subroot"))
    found = _descend(made, saved(tops, "merkle-group-paths"), "merkle-paths")
    group = F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1)).alias("group")
    return found.select(group, "key", "leaf", "claimed", "path", "subroot", F.lit(made.root).cast("binary").alias("root"))


def verified(found: DataFrame) -> DataFrame:
    """``proofs`` with ``proof_digest`` (of its siblings in order), ``folded``, the root that the claimed leaf (null:
    the leaf) leads to, and ``verified``, whether that is the root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claims = zip(batch.column("claimed").to_pylist(), batch.column("leaf").to_pylist(), batch.column("path").to_pylist())
            ends = [fold(claimed or leaf, path) for claimed, leaf, path in claims]
            roots = batch.column("root").to_pylist()
            more = [pa.array([p for _, p in ends], pa.binary()), pa.array([r for r, _ in ends], pa.binary()), pa.array([r == root for (r, _), root in zip(ends, roots)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "proof_digest", "folded", "verified"])

    blank = F.lit(None).cast("binary")
    schema = found.withColumns({"proof_digest": blank, "folded": blank, "verified": F.lit(None).cast("boolean")}).schema
    return found.mapInArrow(trimmed(run), schema)
