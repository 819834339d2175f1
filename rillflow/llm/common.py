"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.sources.folders import fresh_folder, scratch, written

__all__ = ["WORD", "columns_of", "fresh_folder", "map_rows", "parts", "scratch", "table", "word_count", "written"]

#: Java and Python spelling of a run that holds no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def parts(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows, so that few whole texts are Python strings at a time.

    What a batch itself holds is bounded by the session (spark.sql.execution.arrow.maxBytesPerBatch), which is left alone.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, schema: str, per_batch: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Apply per_batch to Arrow batches; it returns one list of values for each column of schema."""
    fields = [part.split() for part in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = per_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
