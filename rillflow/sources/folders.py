"""The folder that driver and executors share, and the tables that are put there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders handed out inside the innermost `scratch`, if there is one.
_inside: ContextVar[list[str] | None] = ContextVar("_inside", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which also becomes the place of checkpoints; a folder of this machine in local sessions without it.

    On a cluster without that setting this is an error, since executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rillflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A name in the shared folder that nothing has yet."""
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if (held := _inside.get()) is not None:
        held.append(folder)
    return folder


def _opened(spark: SparkSession, folder: str) -> tuple:
    """A folder as Hadoop's path and the file system that it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _opened(spark, folder)
    return files.exists(path)


def deleted(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path, files = _opened(spark, folder)
        files.delete(path, True)


def named_files(spark: SparkSession, folder: str, begins: str = "") -> dict[str, int]:
    """Names and sizes of what is in a folder and whose name begins so."""
    path, files = _opened(spark, folder)
    return {s.getPath().getName(): s.getLen() for s in files.listStatus(path) if s.getPath().getName().startswith(begins)}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders handed out inside are deleted at the end, so results must be stored or collected before that.

    Without it they stay, for results are lazy and read them, until whoever owns the shared folder clears it.
    """
    held: list[str] = []
    mark = _inside.set(held)
    try:
        yield
    finally:
        _inside.reset(mark)
        deleted(spark, held)


def literal(path: str) -> str:
    """path as a reader takes it, which would else look for other files where it has the signs of a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    folder = fresh_folder(spark, what)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(literal(folder))
