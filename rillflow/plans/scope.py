"""Scopes: read-only values and tables that several pipelines share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate

import pyarrow as pa
from pyspark import Broadcast, SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rillflow.plans import Pipe, pipe
from rillflow.plans.results import in_order

#: A lookup table is broadcast only if Spark estimates it below this size.
MOST_BROADCAST_BYTES = 64 << 20
#: A table for stages that read it by position is refused beyond this size.
MOST_SHARED_BYTES = 2 << 30


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class SharedTable:
    """A table that stages read by position: a file on each machine, mapped into memory, so that its workers share one copy."""

    def __init__(self, name: str, rows: int):
        self.name, self._rows, self._opened = name, rows, None

    def __getstate__(self) -> dict:
        return {"name": self.name, "_rows": self._rows, "_opened": None}

    def __len__(self) -> int:
        return self._rows

    def _batches(self) -> tuple[list, list[int]]:
        if self._opened is None:
            found = pa.ipc.open_file(pa.memory_map(SparkFiles.get(self.name)))
            batches = [found.get_batch(k) for k in range(found.num_record_batches)]
            self._opened = batches, list(accumulate((b.num_rows for b in batches), initial=0))
        return self._opened

    def row(self, at: int) -> dict:
        """The row at a position from 0; IndexError beyond the end."""
        if not 0 <= at < self._rows:
            raise IndexError(f"row {at} of {self._rows}")
        batches, begins = self._batches()
        k = bisect_right(begins, at) - 1
        return {n: batches[k].column(n)[at - begins[k]].as_py() for n in batches[k].schema.names}

    def value(self, at: int, column: str) -> object:
        if not 0 <= at < self._rows:
            raise IndexError(f"row {at} of {self._rows}")
        batches, begins = self._batches()
        k = bisect_right(begins, at) - 1
        return batches[k].column(column)[at - begins[k]].as_py()


class Scope:
    """Shares values with the pipelines made in it; they are released when the scope ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._shared: list[Broadcast] = []
        self._folders: list[str] = []

    def share(self, value: object) -> Broadcast:
        """A Python value for opaque stages, which read its `.value`."""
        self._shared.append(self.spark.sparkContext.broadcast(value))
        return self._shared[-1]

    def table(self, df: DataFrame, order: str, most_bytes: int = MOST_SHARED_BYTES) -> SharedTable:
        """df, in the order of a column, for opaque stages that read it by position; it goes once to each machine.

        It is sent a part at a time to a file of the driver, whose size is checked on the way: a table beyond most_bytes is
        an error, and a case for lookup, which then joins by shuffle.
        """
        folder = tempfile.mkdtemp(prefix="rillflow-shared-")
        path, rows, out = f"{folder}/{uuid.uuid4().hex}.arrow", 0, None
        self._folders.append(folder)
        schema = to_arrow_schema(df.schema)
        with pa.OSFile(path, "wb") as file, pa.ipc.new_file(file, schema) as out:
            batch: list = []

            def sent() -> None:
                out.write_batch(pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in batch], schema=schema))
                batch.clear()
                if file.tell() > most_bytes:
                    raise ValueError(f"a table of more than {most_bytes} bytes; use lookup")

            for row in in_order(df, (order,)):
                batch.append(row)
                rows += 1
                if len(batch) == 10_000:
                    sent()
            if batch:
                sent()
        self.spark.sparkContext.addFile(path)
        return SharedTable(os.path.basename(path), rows)

    def pipe(self, items: DataFrame | Iterable, seq: str | None = None, schema: str | None = None) -> Pipe:
        return pipe(items, self.spark, seq, schema)

    def lookup(self, left: Pipe, table: DataFrame, on: Column, required: bool = True, most_bytes: int = MOST_BROADCAST_BYTES) -> Pipe:
        """left with the columns of the row of table that `on` picks.

        The table is broadcast if its estimated size is at most most_bytes and joined by shuffle otherwise. A miss fails the
        job when its row is read, as an index out of range would; required=False drops such items instead. No column of
        the table may have the name of a column of left.
        """
        if both := sorted({c.lower() for c in left.to_df(keep_seq=True).columns} & {c.lower() for c in table.columns}):
            raise ValueError(f"rename columns that both sides have: {', '.join(both)}")
        right = F.broadcast(table) if estimated_bytes(table) <= most_bytes else table
        if not required:
            return left.transform(lambda df: df.join(right, on))
        right = right.withColumn("_hit", F.lit(True))
        return left.transform(lambda df: df.join(right, on, "left").filter(F.when(F.col("_hit").isNull(), F.raise_error(F.lit("lookup out of range")).cast("boolean")).otherwise(True)).drop("_hit"))

    def close(self) -> None:
        for value in self._shared:
            value.destroy()
        for folder in self._folders:
            shutil.rmtree(folder, ignore_errors=True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    made = Scope(spark)
    try:
        yield made
    finally:
        made.close()
