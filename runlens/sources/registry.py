"""Sources and sinks named in registry tables: databases, input files and output files."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_on_unique
from ..streaming.lifecycle import batch_writer
from .workbooks import read_workbooks

# Component name part → file type, for inputs and outputs.
FILE_TYPES = {"Excel": ".xlsx", "Delimited": ".csv", "JSON": ".json", "XML": ".xml"}
NO_TYPE = "None"

READERS = {".csv": "csv", ".json": "json", ".xml": "xml"}


def _format(component: Column, direction: str) -> Column:
    chain = F
    for part, suffix in FILE_TYPES.items():
        chain = chain.when(component.contains(f"tFile{direction}{part}"), F.lit(suffix))
    return chain.otherwise(F.lit(NO_TYPE))


def input_format(component: Column) -> Column:
    return _format(component, "Input")


def output_format(component: Column) -> Column:
    return _format(component, "Output")


def input_path(base: str, file_path: Column, file_name: Column, component: Column, file: Column) -> Column:
    """Path of an input file; only entries with ``file`` = 1 carry a type suffix."""
    suffix = F.when(file == 1, input_format(component)).otherwise(F.lit(""))
    return F.concat(F.lit(base.rstrip("/") + "/"), file_path, F.lit("/"), file_name, suffix)


def output_path(base: str, file_path: Column, file_name: Column, component: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), file_path, F.lit("/"), file_name, output_format(component))


def _reader_name(component_type: str) -> str:
    if component_type not in READERS:
        raise ValueError(f"no built-in reader or writer for files of type {component_type!r}")
    return READERS[component_type]


def read_input(spark: SparkSession, entry: Mapping[str, str], schema: str | None = None, **options: str) -> DataFrame:
    """Read the file(s) of one registry entry. Of a workbook, ``schema`` types the columns; option ``sheet`` takes one sheet."""
    if entry["component_type"] == ".xlsx":
        return read_workbooks(spark, entry["path"], schema, options.get("sheet"))
    kind = _reader_name(entry["component_type"])
    defaults = {"csv": {"header": "true"}, "json": {}, "xml": {"rowTag": "row"}}[kind]
    reader = spark.read.format(kind).options(**{**defaults, **options})
    return (reader.schema(schema) if schema else reader).load(entry["path"])


def write_output(df: DataFrame, entry: Mapping[str, str], **options: str) -> None:
    kind = _reader_name(entry["component_type"])
    defaults = {"csv": {"header": "true"}, "json": {}, "xml": {"rowTag": "row", "rootTag": "rows"}}[kind]
    df.write.mode("overwrite").format(kind).options(**{**defaults, **options}).save(entry["path"])


# Database types of the registry; a general one needs the driver's name as well.
GENERAL, ORACLE_SID, ORACLE_SERVICE = "general", "oracle_sid", "oracle_ServiceName"


def jdbc_options(entry: Mapping[str, str], driver: str = "mariadb") -> dict[str, str]:
    """Reader options of one registered database: general, Oracle by SID or by service name."""
    kind, address = entry["db_type"], f"{entry['address']}:{entry['port']}"
    if kind == GENERAL:
        url = f"jdbc:{driver}://{address}/{entry['schema']}"
    elif kind == ORACLE_SID:
        url = f"jdbc:oracle:thin:@{address}:{entry['oracle_sid']}"
    elif kind == ORACLE_SERVICE:
        url = f"jdbc:oracle:thin:@//{address}/{entry['oracle_ServiceName']}"
    else:
        raise ValueError(f"unknown database type {kind!r}")
    extra = entry.get("additional_parameters")
    if extra:
        url += "?" + extra.lstrip("?")
    return {"url": url, "user": entry["login"], "password": entry["password"]}


def read_registered(
    spark: SparkSession, entry: Mapping[str, str], table: str, partition_column: str | None = None,
    lower: object = None, upper: object = None, num_partitions: int = 64, driver: str = "mariadb",
) -> DataFrame:
    """A table of a registered database, read in parallel ranges of ``partition_column``.

    Without a column one task reads the whole table, which only suits small ones. ``driver`` names
    the kind of a general database in its address."""
    options = {**jdbc_options(entry, driver), "dbtable": table}
    if partition_column:
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(num_partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def landing_counts(files: DataFrame) -> DataFrame:
    """Delivered files per name, from a listing with a ``path`` column."""
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    return files.groupBy(name).agg(F.count(F.lit(1)).alias("file_uploaded"))


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of the files in a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.select("path", "length", "modificationTime")


LISTED = 100  # files of a micro-batch that are listed without a Spark job
LOG_BATCHES = 200  # micro-batches until the log of all files seen, which grows with the stream, is written anew


def file_stream(spark: SparkSession, directory: str, pattern: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder and its subfolders as a stream, each one once: path, length, modificationTime. Their content is not read.
    With ``files_per_batch`` the stream has a copy of the session, in which a small micro-batch needs no job to list its files and
    the log of files is written anew less often."""
    if files_per_batch:
        spark = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        least = {"spark.sql.sources.parallelPartitionDiscovery.threshold": min(files_per_batch, LISTED), "spark.sql.streaming.fileSource.log.compactInterval": LOG_BATCHES}
        for name, value in least.items():
            spark.conf.set(name, str(max(int(spark.conf.get(name)), value)))
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(directory).select("path", "length", "modificationTime")


def landing_writer(path: str, name: Column | None = None, few: bool = False) -> Callable[[DataFrame, int], None]:
    """Writer of delivered files per name and micro-batch; a batch that runs again replaces its counts. ``name``
    is made from ``path``, the last part of it by default. ``few``: the stream has a small ``files_per_batch``, so one
    task counts a batch and nothing is shuffled."""
    own = batch_writer(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.select((F.element_at(F.split("path", "/"), -1) if name is None else name).alias("file_name"))
        named = named.coalesce(1) if few else named
        own(named.groupBy("file_name").agg(F.count(F.lit(1)).alias("file_uploaded")), batch_id)

    return write


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Delivered files per name over all batches."""
    return spark.read.parquet(path).groupBy("file_name").agg(F.sum("file_uploaded").alias("file_uploaded"))


def registry_with_landed(registry: DataFrame, counts: DataFrame, key: str = "job_name") -> DataFrame:
    """The registry with its ``file_uploaded`` raised by what has landed under its key. It starts from the stored
    registry each time, so nothing is counted twice."""
    found = counts.select(F.col("file_name").alias(key), F.col("file_uploaded").alias("_n"))
    raised = join_on_unique(registry, found, [key], "left")
    return raised.withColumn("file_uploaded", F.col("file_uploaded") + F.coalesce("_n", F.lit(0))).select(*registry.columns)
