"""Packing of document pieces into sequences: dominance reduction, then best fit.

Only the number of pieces of each length decides how to pack, and there are at most ``capacity``
lengths. So the histogram of lengths (one Spark aggregation, at most ``capacity`` rows) goes to the
driver, is packed there by whole classes of equal pieces, and the plan goes back as ranges: pieces
``from_rank .. to_rank`` of a length take consecutive sequences at one offset. Ranks within a length
come from a window over bounded slices, so a length that a third of all pieces share stays spread.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions, trimmed

ROWS_PER_SLICE = 20_000  # pieces of one length that a task ranks together, on average


@dataclass
class Plan:
    """Placements ``(length, from_rank, count, first sequence, offset)``: the piece with rank
    ``from_rank + i`` goes to sequence ``first + i``."""

    capacity: int
    placed: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    ranks: dict[int, int] = field(default_factory=dict)
    sequences: int = 0
    fixed: int = 0  # sequences closed by the reduction

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.placed.append((length, rank, count, first, offset))
        self.ranks[length] = rank + count

    def close(self, lengths: list[int], count: int) -> None:
        """``count`` new sequences that each hold ``lengths``."""
        offset = 0
        for length in lengths:
            self.put(length, count, self.sequences, offset)
            offset += length
        self.sequences += count
        self.fixed += count


def _dominant(left: dict[int, int], lengths: list[int], own: int, capacity: int) -> list[int] | None:
    """The set with ``own`` that dominates every other feasible set with it, if one of at most three
    pieces provably does. ``lengths``: ascending lengths that are left, ``own`` among them.

    A set dominates another if the other's pieces can be dealt into groups, each no longer than a
    piece of the set that stands for it. So: the longest fitting piece alone dominates if it fills the
    sequence, if no two pieces fit beside ``own``, or if it is as long as any fitting pair (and no
    three fit). The longest fitting pair dominates if no three fit, it has the longest fitting piece,
    and every fitting pair has its second piece no longer, or is no longer than the longest piece."""
    room = capacity - own

    def has(length: int, times: int = 1) -> bool:
        return left.get(length, 0) - (length == own) >= times

    def longest(limit: int) -> int | None:
        i = bisect.bisect_right(lengths, limit) - 1
        while i >= 0 and not has(lengths[i]):
            i -= 1
        return lengths[i] if i >= 0 else None

    smallest: list[int] = []
    for length in lengths:
        smallest += [length] * min(left[length] - (length == own), 4 - len(smallest))
        if len(smallest) >= 4:
            break
    first = longest(room)
    if first is None:
        return [own]
    if first == room or sum(smallest[:2]) > room or len(smallest) < 2:
        return [own, first]
    if len(smallest) >= 3 and sum(smallest[:3]) <= room:
        return None
    best: tuple[int, int, int] | None = None  # sum, first, second of the longest pair
    pairs = []
    for a in lengths:
        if a > room or not has(a):
            continue
        b = longest(min(room - a, a))
        if b == a and not has(a, 2):
            b = longest(a - 1)
        if b is not None:
            pairs.append((a + b, a, b))
    if not pairs:
        return [own, first]
    best = max(pairs)
    if first >= best[0]:
        return [own, first]
    second = max((b for _, a, b in pairs if a == first), default=None)
    if second is not None and all(b <= second or total <= first for total, _, b in pairs):
        return [own, first, second]
    return None


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack ``histogram`` (length -> number of pieces, 1 <= length <= capacity).

    The reduction goes through the lengths from the longest on and closes every sequence that
    provably dominates its alternatives; it is repeated while it closes any. The rest is packed best
    fit, longest pieces first, by whole intervals of equally filled sequences."""
    plan = Plan(capacity)
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    again = True
    while again and left:
        again = False
        for own in sorted(left, reverse=True):
            while left.get(own):
                found = _dominant(left, lengths, own, capacity)
                if found is None:
                    break
                need = {n: found.count(n) for n in found}
                # taking pieces away only takes alternatives away, so the set dominates as long as it is there
                count = min(left[n] // k for n, k in need.items())
                plan.close(found, count)
                again = True
                for n, k in need.items():
                    left[n] -= k * count
                    if not left[n]:
                        del left[n]
                        lengths.remove(n)

    # sequences by free room: intervals (first, count) that hold the same lengths
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # ascending rooms
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                fresh = -(-count // (capacity // length))
                rooms.setdefault(capacity, []).append((plan.sequences, fresh))
                plan.sequences += fresh
                bisect.insort(order, capacity)
                continue
            room = order[i]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            used = min(n, count)
            plan.put(length, used, first, capacity - room)
            count -= used
            for rest, where in ((room - length, (first, used)), (room, (first + used, n - used))):
                if where[1] and rest:
                    if rest not in rooms:
                        bisect.insort(order, rest)
                    rooms.setdefault(rest, []).append(where)
    return plan


def pack(pieces: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """``pieces`` (with ``length``, and ``keys`` that tell them apart) plus ``sequence_id`` and
    ``offset``; a sequence holds at most ``capacity`` and has no gap.

    Pieces with null or non-positive length hold nothing: both columns are null. Longer ones than the
    capacity are an error of the caller and fail. Repeated rows are packed each. ``pieces`` is read
    twice and should be a stored table."""
    spark = pieces.sparkSession
    counted = pieces.where("length > 0").groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.where(F.col("length") <= capacity).collect()}  # <= capacity rows
    plan = plan_packing(histogram, capacity)
    total = sum(histogram.values())
    slices = max(4 * shuffle_partitions(spark), total // ROWS_PER_SLICE)
    by_length = sorted(plan.placed)
    starts = np.array([(p[0] << 44) + p[1] for p in by_length], dtype=np.int64)  # rank < 2**44
    first = np.array([p[3] for p in by_length], dtype=np.int64)
    offset = np.array([p[4] for p in by_length], dtype=np.int64)

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy().astype(np.int64) << 44) + rank.to_numpy().astype(np.int64)
        at = np.searchsorted(starts, key, side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + (key - starts[at]), "offset": offset[at]})

    valid = pieces.where("length > 0").withColumn(
        "_length", F.when(F.col("length") <= capacity, F.col("length")).otherwise(F.raise_error(F.lit("a piece is longer than the capacity")).cast("long"))
    )
    sliced = valid.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)))
    within = sliced.withColumn("_row", F.row_number().over(Window.partitionBy("_length", "_slice").orderBy(*keys)) - 1)
    sizes = sliced.groupBy("_length", "_slice").agg(F.count("*").alias("_n"))
    before = sizes.select("_length", "_slice", (F.sum("_n").over(Window.partitionBy("_length").orderBy("_slice")) - F.col("_n")).alias("_before"))
    ranked = within.join(before, ["_length", "_slice"])
    placed = ranked.withColumn("_place", place("_length", F.col("_before") + F.col("_row")))
    out = placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")
    none = F.lit(None).cast("long")
    empty = pieces.where("length is null or length <= 0").select("*", none.alias("sequence_id"), none.alias("offset"))
    return out.unionByName(empty)


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents with ``lengths``: (document, piece, start, length). Documents longer than
    the capacity are cut into full pieces; their first piece takes the rest."""
    counts = np.maximum(-(-lengths // capacity), 1)
    doc = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = lengths - (counts - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of every document (doc_id, text): doc_id, piece, start, length,
    ids_crc32. The ids end with ``end_id``; null texts are empty, so they
    are one piece with ``end_id`` alone."""
    import zlib

    from .common import slices as batch_slices
    from .tokens import encoder

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in batch_slices(batch, "text"):
                ids = [b + end for b in encode.batch(part.column("text").to_pylist())]
                doc, piece, start, length = cut(np.array([len(b) // 4 for b in ids]), capacity)
                crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n in zip(doc, start, length)]
                cols = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    spec = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), spec)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents: the columns of ``token_pieces``, ``sequence_id`` and ``offset``.

    Texts are read and encoded once; what is stored and shuffled are the few numbers of a piece."""
    pieces = saved(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
