"""Whole files as rows, found and read by tasks: the driver knows none of them, and a task reads as many as its share is."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tasks for each core that files are dealt to; rows and bytes of a batch of files.
TASKS_EACH, MOST_FILES, MOST_BYTES = 8, 512, 8 << 20


def hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def local(path: str) -> str | None:
    """The folder of a machine's own or mounted file system that path names, None if it is anything else."""
    place = path if path.startswith("/") else re.sub("^file:(//)?(?=/)", "", path) if path.startswith("file:/") else None
    return place if place is not None and os.path.isdir(place) else None


def plain(glob: str) -> bool:
    """Whether a pattern has no other signs than * and ?."""
    return not re.search(r"[\[\]{}\\]", glob)


def beneath(folder: str, glob: str, deep: bool) -> Iterator[tuple[str, bool]]:
    """Files of a folder, and either those of the folders in it or these folders; and whether it is a folder."""
    with os.scandir(folder) as found:
        for entry in found:
            if hidden(entry.name):
                continue
            if not entry.is_dir():
                if fnmatchcase(entry.name, glob):
                    yield entry.path, False
            elif deep:
                yield from beneath(entry.path, glob, True)
            else:
                yield entry.path, True


def read_apart(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """The files under a folder that all machines open by that name, as rows path, length, content.

    A task lists the folder itself, others what is in its folders; names are then dealt out and each task reads its own.
    """

    def listed(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
        names, folders = [], []
        for batch in batches:
            for place, is_folder in zip(batch.column("place").to_pylist(), batch.column("folder").to_pylist()):
                for name, more in beneath(place, glob, deep) if is_folder else [(place, False)]:
                    names.append(name)
                    folders.append(more)
                    if len(names) == 10_000:
                        yield pa.RecordBatch.from_pydict({"place": names, "folder": folders})
                        names, folders = [], []
        if names:
            yield pa.RecordBatch.from_pydict({"place": names, "folder": folders})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        made = lambda: pa.RecordBatch.from_pydict({"path": [f"file:{n}" for n in names], "length": list(map(len, contents)), "content": contents}, schema=schema)
        names, contents, size = [], [], 0
        for batch in batches:
            for name in batch.column("place").to_pylist():
                with open(name, "rb") as file:
                    contents.append(file.read())
                names.append(name)
                size += len(contents[-1])
                if len(names) == MOST_FILES or size >= MOST_BYTES:
                    yield made()
                    names, contents, size = [], [], 0
        if names:
            yield made()

    cores, found = spark.sparkContext.defaultParallelism, "place string, folder boolean"
    top = spark.createDataFrame([(folder.rstrip("/") or "/", True)], found).mapInArrow(lambda batches: listed(batches, False), found)
    names = top.repartition(cores, "place").mapInArrow(lambda batches: listed(batches, True), found).select("place")
    return names.repartition(TASKS_EACH * cores, "place").mapInArrow(opened, "path string, length long, content binary")
