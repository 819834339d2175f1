"""Results that are stored before they are handed over: task by task, in order, or in growing waves of the input."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from rillflow.sources.folders import deleted, exists, fresh_folder, literal, named_files, written
from rillflow.streaming.cancel import CancellationToken

#: Rows of a stored file, which is what the driver holds of an ordered result at a time.
ROWS_EACH = 100_000
NUMBERS, PARTS_AHEAD = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType), 6
#: Least rows of a part of the input, parts for each core, bytes of one part, and how waves of parts grow.
LEAST_ROWS, PARTS_EACH, PART_BYTES, GROWTH = 5000, 16, 128 << 20, 4


def read(spark: SparkSession, schema: StructType, *paths: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*map(literal, paths))


def committed(df: DataFrame, token: CancellationToken) -> tuple[DataFrame | None, bool]:
    """What the tasks of one job had committed when it ended or was cancelled, None if none had; and whether it ended.

    A task moves its one file into place when it ends, under a name that all its attempts share, so that a task
    that is tried again replaces its file and one that is killed leaves none. The file system's rename must be atomic.
    """
    spark, folder = df.sparkSession, fresh_folder(df.sparkSession, "committed")
    options = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "maxRecordsPerFile": "0", "compression": "zstd"}
    ended = token.unless_cancelled(spark, lambda: df.write.options(**options).parquet(folder) or True) is not None
    return (read(spark, df.schema, folder) if exists(spark, folder) else None), ended


def part_of(name: str) -> tuple[int, int]:
    """Number of the task that wrote a file and of the file among those of the task."""
    found = re.match(r"part-(\d+)-.*-c(\d+)\.", name)
    return int(found[1]), int(found[2])


def parts_in_order(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files of a stored table in the order of its partitions and of the rows in them."""
    return [f"{folder}/{name}" for name in sorted(named_files(spark, folder, "part-"), key=part_of)]


def sorted_parts(rows: DataFrame, by: tuple[str, ...], folder: str, parts: int | None = None, rows_each: int = 0) -> list[str]:
    """Store rows by ranges of `by`, sorted in each; the files in order."""
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.option("maxRecordsPerFile", rows_each).option("compression", "zstd").parquet(folder)
    return parts_in_order(rows.sparkSession, folder)


def plain(schema: StructType, names: list[str], *types: type) -> bool:
    """Whether columns are of types that Arrow gives as the same Python objects that rows hold."""
    return all(isinstance(schema[n].dataType, (*NUMBERS, *types)) for n in names)


def part_read(rows: DataFrame, names: list[str] | None) -> Iterator:
    """What in_order gives of one part: rows, or items of columns, which then come as Arrow where their types allow it."""
    if names is None:
        return iter(rows.collect())
    if plain(rows.schema, names, StringType):
        return items_of(rows.select(*(f"`{n}`" for n in names)).toArrow())
    return (r["value"] if names == ["value"] else tuple(r[n] for n in names) for r in rows.collect())


def items_of(part: pa.Table) -> Iterator:
    columns = [c.to_pylist() for c in part.columns]
    return iter(columns[0]) if part.column_names == ["value"] else zip(*columns)


def ahead(spark: SparkSession, schema: StructType, files: list[str], names: list[str]) -> Iterator:
    """Items of numbers, file by file; the next PARTS_AHEAD files are fetched meanwhile, as Arrow, which is less than one as objects."""
    fetched = inheritable_thread_target(spark)(lambda file: read(spark, schema, file).coalesce(1).select(*(f"`{n}`" for n in names)).toArrow())
    with ThreadPoolExecutor(PARTS_AHEAD) as pool:
        try:
            held = deque(pool.submit(fetched, file) for file in files[:PARTS_AHEAD])
            for file in [*files[PARTS_AHEAD:], *[None] * len(held)]:
                part = held.popleft().result()
                if file is not None:
                    held.append(pool.submit(fetched, file))
                yield from items_of(part)
        finally:
            pool.shutdown(cancel_futures=True)


def in_order(df: DataFrame, by: tuple[str, ...], rows_each: int = ROWS_EACH, names: list[str] | None = None) -> Iterator:
    """The rows of df in the order of `by`, or in any if there is none; the driver holds rows_each at a time.

    With names, the items of these columns instead: values where there is the one column `value`, else tuples.
    df is stored once, so that its stages run once, then by ranges; each file is a job of its own. What is stored goes at the end.
    """
    spark, schema = df.sparkSession, df.schema
    whole, ranged = fresh_folder(spark, "iterated"), fresh_folder(spark, "iterated")
    try:
        df.write.option("maxRecordsPerFile", rows_each).option("compression", "zstd").parquet(whole)
        rows = read(spark, schema, whole)
        if by and rows.count() <= rows_each:
            yield from part_read(rows.coalesce(1).sortWithinPartitions(*by), names)
            return
        files = sorted_parts(rows, by, ranged, rows_each=rows_each) if by else parts_in_order(spark, whole)
        if names and plain(schema, names):
            yield from ahead(spark, schema, files, names)
            return
        for file in files:
            yield from part_read(read(spark, schema, file).coalesce(1), names)
    finally:
        deleted(spark, [whole, ranged])


def waves(source: DataFrame, seq: str) -> Iterator[DataFrame]:
    """source in growing waves of ranges of seq: whoever stops asking leaves the rest unread.

    source is stored once and, if it is not small, once more by ranges; no stage of the pipeline has run by then.
    """
    spark, schema = source.sparkSession, source.schema
    rows = written(source, "waves")
    n = rows.count()
    if n <= LEAST_ROWS:
        yield rows
        return
    bytes_stored = sum(named_files(spark, rows_folder(rows), "part-").values())
    parts = max(min(PARTS_EACH * spark.sparkContext.defaultParallelism, n // LEAST_ROWS), bytes_stored // PART_BYTES, 2)
    files = sorted_parts(rows, (seq,), fresh_folder(spark, "waves"), parts)
    at, wide = 0, max(1, len(files) // PARTS_EACH)
    while at < len(files):
        yield read(spark, schema, *files[at : at + wide])
        at, wide = at + wide, wide * GROWTH


def rows_folder(stored: DataFrame) -> str:
    """The folder of a table that has just been written."""
    from urllib.parse import unquote

    return unquote(stored.inputFiles()[0].rpartition("/")[0])


def tried(source: DataFrame, seq: str, error: str, stages: Callable[[DataFrame], DataFrame]) -> tuple[Row | None, list[DataFrame]]:
    """Run fallible stages wave by wave: (the row of the first error, []) or (None, the stored results in input order).

    A wave's results are stored where they are; of an error only its row reaches the driver, and no later wave is run.
    """
    from pyspark.sql import functions as F

    done = []
    for rows in waves(source, seq):
        done.append(written(stages(rows), "tried"))
        first = done[-1].filter(F.col(error).isNotNull()).agg(F.min_by(F.struct(F.col(seq).alias("seq"), f"{error}.kind", f"{error}.msg"), seq).alias("e")).first()["e"]
        if first is not None:
            return first, []
    return None, done
