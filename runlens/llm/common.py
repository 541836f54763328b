"""What the corpus operators share: tables in the shared folder, ordered buckets, bounded batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import work_dir

ROOT = str(Path(__file__).resolve().parents[2])
BATCH_BYTES = 4 << 20  # bound of one Arrow batch, whatever the number of rows


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too: 10,000 very long texts don't fit into one. Workers on this
    machine find the package wherever the driver was started; a cluster gets it with ``--py-files``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, compression: str = "snappy", partition_by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends here, and a lost executor
    costs only its running tasks."""
    path = work_dir(df.sparkSession, name)
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``saved``, dealt into buckets by ``key``: a later grouping by it moves only its other side."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    table_name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.option("path", path).bucketBy(shuffle_partitions(spark), key).sortBy(key).saveAsTable(table_name)
    return spark.table(table_name)


def unused(taken: list[str], *names: str) -> list[str]:
    """Helper names that no column has, without regard to case."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while f"_{name}".lower() in held:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that cut ``col`` into ranges of about equal row counts.
    One number a range reaches the driver; nulls count as smallest and need no bound."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(col, shares, F.lit(max(10_000, 20 * parts))).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(col: str, bounds: list[int]) -> Column:
    """Number of the range that holds the value: the count of bounds <= value; 0 for null."""
    if not bounds:
        return F.lit(0)
    cuts = np.array(bounds, dtype="int64")

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, values.to_numpy(), side="right").astype("int32"))

    return bucket(F.coalesce(F.col(col).cast("long"), F.lit(-(2**63))))


def trim() -> None:
    """Give freed memory back to the system: workers live on after a task, and several share a machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with a ``trim`` now and then and at the end of the task."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, out in enumerate(run(batches)):
            yield out
            if i % 8 == 7:
                trim()
        trim()

    return wrapped


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``limit`` bytes of a binary or text column each; a longer
    single value has a slice of its own."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype="int64")
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)
