"""Where items come from: Python collections, DataFrames and files; and the order they carry."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rillflow.sources.files import local, plain, read_apart
from rillflow.sources.folders import literal, written

SEQ = "_seq"
#: Up to so many files their first numbers are broadcast.
MOST_BROADCAST_FILES = 100_000


def from_items(spark: SparkSession, items: Iterable, schema: str | StructType | None = None) -> DataFrame:
    """A collection of the driver as rows with _seq; scalars become a column `value`. Needs schema if it is empty."""
    rows = list(items)
    told = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if rows and not isinstance(rows[0], (list, tuple, dict)):
        rows = [(x,) for x in rows]
    if told is None:
        told = spark.createDataFrame(rows, None if isinstance(rows[0], dict) or len(rows[0]) > 1 else ["value"]).schema
    rows = [(k, *(map(row.get, told.names) if isinstance(row, dict) else row)) for k, row in enumerate(rows)]
    return spark.createDataFrame(rows, StructType([StructField(SEQ, LongType(), False), *told.fields]))


def from_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files under a folder as rows path, length, content; for stages that compress, encrypt or parse them.

    A folder that is opened by name is listed and read by tasks, however many files it has. Others, and patterns with more than
    * and ?, are Spark's binaryFile, of which the driver lists all files and a task takes a few, and which passes over empty ones.
    """
    if (folder := local(path)) is not None and plain(glob):
        return read_apart(spark, folder, glob)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(literal(path))
    return files.select("path", "length", "content")


def found_or_fails(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(what)).cast("bigint"))


def from_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table with dense _seq, by name of file and row in it.

    Each file knows its row numbers, so nothing is stored or sorted: one pass over no column counts the rows of each file.
    """
    rows = spark.read.parquet(path)
    file, place = rows.metadataColumn("_metadata")["file_path"], rows.metadataColumn("_metadata")["row_index"]
    sizes = rows.select(file.alias("_file")).groupBy("_file").count()
    ahead = F.coalesce(F.sum("count").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", ahead.alias("_start"))  # one row for each file
    if len(rows.inputFiles()) <= MOST_BROADCAST_FILES:
        starts = F.broadcast(starts)
    out = rows.select(*(columns or rows.columns), file.alias("_file"), place.alias("_place")).join(starts, "_file", "left")
    return out.withColumn(SEQ, found_or_fails(F.col("_start"), "a file without a start") + F.col("_place")).drop("_file", "_place", "_start")


def sequenced(df: DataFrame, key: str | None = None) -> DataFrame:
    """df with _seq: a unique integer column of its own, or dense numbers in the order of partitions and rows.

    Dense numbers need rows that stay where they are while those before them are counted: df is stored in the shared folder
    when this is called, each row with its partition and its place in it. Rows are then counted by partition, and one row
    for each partition is joined. Nothing is sorted or gathered, and df is evaluated once. A key, or from_parquet for
    a whole table, spares the copy.
    """
    if key is not None:
        return df.withColumn(SEQ, F.col(key).cast("bigint"))
    rows = written(df.withColumn("_id", F.monotonically_increasing_id()), "sequenced")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = rows.select(part.alias("_part")).groupBy("_part").count()
    ahead = F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", ahead.alias("_start"))  # one row for each partition
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part", "left")
    return out.withColumn(SEQ, found_or_fails(F.col("_start"), "a partition without a start") + place).drop("_part", "_start", "_id")
