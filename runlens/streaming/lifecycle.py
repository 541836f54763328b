"""Structured Streaming forms of the lifecycle operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import text_key
from ..operators.changes import replace_rows
from ..operators.joins import new_rows
from ..operators.lifecycle import RUN_KEY, begin_rows
from ..session import cut


def read_events(spark: SparkSession, directory: str, schema: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Event files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


begin_stream = begin_rows


def start_available(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", state_partitions: int | None = None
) -> StreamingQuery:
    """Process everything that is available and stop.

    The state of a new stream lies in ``state_partitions``, by default two for each core, but no more than the session's
    shuffle partitions: every micro-batch opens and commits the store of each of them, about a second for one
    whose state is kept by Python, with rows or without. The checkpoint keeps the number."""
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    usual = conf.get(name)
    conf.set(name, str(state_partitions or min(int(usual), 2 * df.sparkSession.sparkContext.defaultParallelism)))
    try:
        return (
            df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )  # the stream has its own copy of the session from here on
    finally:
        conf.set(name, usual)


def at_once(spark: SparkSession, writes: Sequence[Callable[[], None]]) -> None:
    """Run writes of a micro-batch that don't depend on each other; small ones wait for planning and files more than for cores."""
    with ThreadPoolExecutor(max(len(writes), 1)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in writes]:
            done.result()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writer that puts each micro-batch into its own partition ``batch_id=N``.

    A batch that runs again after a failure replaces its partition, so rows never double.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        )

    return write


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows written so far, also before the first batch; only a missing folder counts as that."""
    return read_table(spark, path, spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("bigint")))


def upsert_writer(
    path: str, keys: Sequence[str] = tuple(RUN_KEY), buckets: int | None = None, day: str | None = None, stable: bool = False
) -> Callable[[DataFrame, int], None]:
    """Writer that keeps a table of one row per key: the rows of a micro-batch replace those of their keys.

    The table lies in ``bucket=N`` partitions by a hash of the key (64, or 8 a day), below those of ``day`` if the rows
    of a key never change their day. A batch reads and rewrites only the partitions it touches, from a
    checkpoint, and no older version stays behind. A batch that runs again puts the same rows in the
    same place. ``stable``: the batch is stored already, and needs no checkpoint of its own."""
    count = buckets or (8 if day else 64)
    parts = [day, "bucket"] if day else ["bucket"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*[text_key(batch, c) for c in keys]), F.lit(count)).cast("int"))
        new = new if stable else cut(new)
        touched = [tuple(r) for r in new.select(*parts).distinct().collect()]  # as many as the batch has partitions
        if not touched:
            return
        held, named = read_table(spark, path, new), 1
        for i, part in enumerate(parts):  # literals, so that the scan is pruned
            found = sorted({t[i] for t in touched})
            held, named = held.where(F.col(part).isin(found)), named * len(found)
        if named > len(touched):  # the literals name others, too
            held = held.join(F.broadcast(new.select(*parts).distinct()), parts, "left_semi").select(*new.columns)
        merged = cut(replace_rows(held, new, list(keys)))
        merged.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    return write


def absent_writer(path: str, keys: Sequence[str], first_by: str = "ts", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Writer that adds only rows whose key the table doesn't hold yet, of any age; of several rows with
    one key in a micro-batch the first by ``first_by``. The table lies in partitions by a hash of the key and
    by batch; a batch reads those of its own hashes only. A batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*[text_key(batch, c) for c in keys]), F.lit(buckets)).cast("int"))
        rows = cut(placed.withColumn("batch_id", F.lit(batch_id).cast("bigint")))
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets
        held = read_table(batch.sparkSession, path, rows).where(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id))
        fresh = new_rows(rows, held, list(keys), first_by)
        fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(path)

    return write


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table in the columns of ``like``; empty as long as its folder is missing."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def current_rows(written: DataFrame, keys: Sequence[str] = tuple(RUN_KEY)) -> DataFrame:
    """Latest version of every key in an update log."""
    row = F.max_by(F.struct(*[c for c in written.columns if c != "batch_id"]), F.col("batch_id")).alias("r")
    return written.groupBy(*keys).agg(row).select("r.*")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str] = tuple(RUN_KEY)) -> None:
    """Write the current rows of an update log as the first batch of a new log."""
    current_rows(spark.read.parquet(path), keys).withColumn("batch_id", F.lit(-1).cast("bigint")).write.partitionBy(
        "batch_id"
    ).parquet(target)


def day_counts_writer(path: str, by: Sequence[str] = ("kind",), ts: str = "ts", delay: str = "2 days") -> Callable[[DataFrame, int], None]:
    """Writer of events per day and ``by``, for a stream without watermark: each batch adds its own counts, so a
    row counts whenever it comes. ``late`` tells rows that came more than ``delay`` behind the latest event of
    all earlier batches. A batch that runs again replaces its counts."""
    own = batch_writer(path)
    schema = "day date, late boolean, amount bigint, latest timestamp"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = read_batches(spark, path, spark.createDataFrame([], schema).schema).where(F.col("batch_id") < batch_id)
        latest = earlier.agg(F.max("latest")).first()[0]  # one value
        mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts) < mark, F.lit(False)).alias("late")
        own(batch.groupBy(F.to_date(ts).alias("day"), *by, late).agg(F.count(F.lit(1)).alias("amount"), F.max(F.col(ts).cast("timestamp")).alias("latest")), batch_id)

    return write


def day_counts(spark: SparkSession, path: str, by: Sequence[str] = ("kind",)) -> DataFrame:
    """Events per day and ``by``, and how many of them came late."""
    return spark.read.parquet(path).groupBy("day", *by).agg(F.sum("amount").alias("amount"), F.sum(F.when(F.col("late"), F.col("amount")).otherwise(0)).alias("late"))


def insert_if_absent_stream(events: DataFrame, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """First row of every key; repeats within ``delay`` are dropped with bounded state. Later ones, and
    keys that the table held before, are left to ``absent_writer``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
