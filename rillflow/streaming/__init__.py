"""Bounded inputs as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rillflow.sources.folders import literal


def run_available(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    stages: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    files_per_batch: int = 64,
    file_format: str = "parquet",
) -> DataFrame:
    """Run stages over the files of a folder in micro-batches and return the table written to `out`.

    What a batch has written is committed with its offsets under `checkpoint`, so a restarted run goes on where the last one
    stopped. New files are what the next call takes.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(literal(folder))
    done = stages(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = done.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(literal(out))
