"""Tables as files: scan, append, rewrite, catalogue look-ups and parameterised SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import with_day, with_keys


def scan(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rewrite_partitions(df: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """Replace only the partitions that occur in ``df``; all others stay as they are."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols).parquet(path)
    )


def store_runs(runs: DataFrame, path: str) -> None:
    """Append runs to a log prepared for the run filter: key columns, one partition per start day.

    A start day never changes, so later updates of a run stay in its partition. The range shuffle by
    start time gives tasks of equal size that each write few days, also when one day is very large.
    """
    rows = with_day(with_keys(runs)).repartitionByRange("start_time")
    rows.write.mode("append").partitionBy("start_day").parquet(path)


def touched_partitions(table: DataFrame, changes: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    """Rows of the partitions that a table of changes names. Partition pruning at run time keeps
    the other partitions from being read, so an update costs what it touches."""
    return table.join(changes.select(*partition_cols).distinct(), list(partition_cols), "left_semi")


def describe(df: DataFrame) -> DataFrame:
    """Column names, types and positions of a table."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def describe_all(**tables: DataFrame) -> DataFrame:
    """``describe`` of several tables, with ``table_name``."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n, df in tables.items() for i, f in enumerate(df.schema)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, position int, name string, type string, nullable boolean")


def table_names(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def row_counts(**tables: DataFrame) -> DataFrame:
    """Number of rows of several tables, one row each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("amount")).select(F.lit(name).alias("table_name"), "amount")
        out = one if out is None else out.unionByName(one)
    return out


def query(spark: SparkSession, text: str, args: Sequence[object] = (), **tables: DataFrame) -> DataFrame:
    """SQL text with ``?`` markers. A list stands for a bracketed list of markers, as after IN.

    ``tables`` are offered to the text as temporary views of their keyword names.
    """
    if text.count("?") != len(args):
        raise ValueError("the number of markers and arguments differs")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    pieces, flat = text.split("?"), []
    out = pieces[0]
    for value, piece in zip(args, pieces[1:]):
        many = isinstance(value, (list, tuple))
        out += ("(" + ", ".join("?" * len(value)) + ")" if many else "?") + piece
        flat.extend(value if many else [value])
    return spark.sql(out, args=flat)
