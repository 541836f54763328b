"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors become integers. Each shard of vectors keeps, for every dimension, its values in sorted
order. A query reads each list from its better end (the upper one for a positive weight, the lower
one for a negative) down to a depth. An entry not yet read is bounded by the last value read above
and by the end of the list below, so every vector has a lower and an upper bound of its score. Once
no more than a few vectors can still reach the k-th best lower bound, reading stops and their final
scores are resolved. All queries of a block read in step, so one matrix product gives the bounds of
all of them: the values of a list, raised to the last value read, are its upper bounds.

Shards and query blocks have fixed sizes and are stored; a block meets every shard once. The blocks take turns
of a bounded number of bytes, which are sent to every task of the shards, so no copy of a block or shard is ever written
or sent for a single meeting. A shard keeps k results a query, which are merged turn by turn and by a last aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import work_dir

from .common import prepare, saved

SHARD = 4096  # vectors whose lists are read together
BLOCK = 512  # queries of a block
DEPTHS = (0.25, 0.5, 0.75, 1.0)  # shares of a list read at each step
OPEN = 64  # candidates of a query whose final scores are resolved
TURN = 16 << 20  # bytes of queries, eight a component, that meet the shards in one pass
GROUP_BYTES = 8 << 20  # bytes of matrices that are read together


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats where every partial sum is exact in them."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return q.astype(kind) @ x.astype(kind).T


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, places of its k best vectors, their scores) by bounds over sorted lists;
    higher scores first, ties to the smaller id. A query's own id doesn't count."""
    n = len(vectors)
    ordered = np.sort(vectors, axis=0)  # the lists, each read from either end
    high, low = np.maximum(queries, 0), np.minimum(queries, 0)
    waiting = np.arange(len(queries))
    for share in DEPTHS:
        depth = max(1, int(n * share))
        last = share == DEPTHS[-1] or depth >= n
        q_high, q_low = high[waiting], low[waiting]
        own = vec_ids[None, :] == query_ids[waiting][:, None]
        if last:
            upper = lower = _product(queries[waiting], vectors)
        else:
            top, bottom = ordered[n - depth], ordered[depth - 1]
            upper = _product(q_high, np.where(vectors >= top, vectors, top))
            upper = upper + _product(q_low, np.where(vectors <= bottom, vectors, bottom))
            lower = _product(q_high, np.where(vectors >= top, vectors, ordered[0]))
            lower = lower + _product(q_low, np.where(vectors <= bottom, vectors, ordered[-1]))
        worst = np.iinfo(np.int64).min if lower.dtype == np.int64 else -np.inf
        lower = np.where(own, worst, lower)
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(waiting), worst)
        open_ = (upper >= bar[:, None]) & ~own  # ties with the bar stay open
        done = np.ones(len(waiting), bool) if last else open_.sum(axis=1) <= OPEN
        for i in np.flatnonzero(done):
            at = np.flatnonzero(open_[i])
            scores = (_product(queries[waiting[i]][None, :], vectors[at])[0]).astype(np.int64)
            order = np.lexsort((vec_ids[at], -scores))[:k]
            yield int(waiting[i]), at[order], scores[order]
        waiting = waiting[~done]
        if not len(waiting):
            return


def _packed(df: DataFrame, size: int, total: int) -> DataFrame:
    """Vectors (vec_id, dims, v) as rows of matrices with about ``size`` vectors of one dimension. Rows are
    dealt by a number of their own, so that one vec_id on very many rows doesn't fill a matrix."""
    groups = max(1, -(-total // size))
    keyed = df.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        values = t["v"].combine_chunks()
        ids = np.array(t["vec_id"], dtype="<i8")
        flat = np.array(values.flatten(), dtype="<i8").reshape(len(ids), -1)
        order = np.lexsort((*flat.T[::-1], ids))
        ids, flat = ids[order], flat[order]
        return pa.table({"part": t["part"].slice(0, 1), "dims": t["dims"].slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([flat.astype("<i4" if abs(flat).max(initial=0) < 2**31 else "<i8").tobytes()], pa.binary())})

    return keyed.groupBy("part", "dims").applyInArrow(pack, "part int, dims int, ids binary, matrix binary")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """As ``saved``, in row groups of few matrices: a reader takes a group of up to thousands of rows at once."""
    path = work_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", GROUP_BYTES).option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 1).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(ids: bytes, matrix: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(matrix, f"<i{len(matrix) // (len(ids) * dims)}").reshape(len(ids), dims)


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dims, v): floor(scale * x) of each component. Null vectors, vectors that hold a null or
    non-finite component, and null ids take no part."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size("embedding").alias("dims"),
        F.transform(wide, lambda x: F.floor(x * scale)).alias("v"),
    )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each one whose vec_id is
    divisible by ``every``; ties go to the smaller vec_id. Rows that repeat a vec_id
    are candidates of their own, each with its rank; those with the query's vec_id are left out. Queries that
    repeat a vec_id share one ranking. Only vectors of equal length meet; vectors of no components score 0 with each other. Scores must fit into 64 bits. An empty table gives no rows."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = integers(vectors, scale)
    asks = F.col("vec_id") % every == 0
    held = F.sum(F.when(asks, 8 * (F.col("dims").cast("long") + 1)))
    total, asked, size = rows.agg(F.count(F.lit(1)), F.count_if(asks), F.coalesce(held, F.lit(0))).first()
    shards = _stored(_packed(rows, SHARD, total), "vector-shards")
    blocks = _stored(_packed(rows.where(asks), BLOCK, asked), "query-blocks").select("part", "dims", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    tasks = min(max(1, -(-total // SHARD)), 8 * spark.sparkContext.defaultParallelism)
    dealt = shards.repartitionById(tasks, F.col("part") % tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["dims"]:
                    q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                    queries, data = np.zeros((len(q_ids), 1), np.int64), np.zeros((len(ids), 1), np.int64)
                else:
                    q_ids, queries = _matrix(row["q_ids"], row["q_matrix"], row["dims"])
                    ids, data = _matrix(row["ids"], row["matrix"], row["dims"])
                found = [(q_ids[i], ids[at], s) for i, at, s in search(queries, q_ids, data, ids, k)]
                if found:
                    cols = [np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    def ranked(found: DataFrame) -> DataFrame:
        placed = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int"))
        return placed.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def turn_of(turn: int) -> DataFrame:
        # as large as a turn, whatever Spark makes of the files' sizes
        meetings = dealt.join(F.broadcast(blocks.where(F.col("part") % turns == turn)), "dims")
        return ranked(meetings.select("dims", "q_ids", "q_matrix", "ids", "matrix").mapInArrow(run, "query_id long, vec_id long, score long"))

    turns = max(1, -(-size // TURN))
    if turns == 1:
        return turn_of(0)
    found = [saved(turn_of(turn), "turn-results") for turn in range(turns)]  # one after the other, so that one turn is held at a time
    return ranked(reduce(DataFrame.unionByName, found))
