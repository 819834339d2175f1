"""Where results go besides tables: files of their own."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Begins the names of files that are not yet in place; readers pass over such names.
ASIDE = "._aside-"


@dataclass
class Stored(WriterCommitMessage):
    files: int
    bytes: int


class NamedFilesWriter(DataSourceArrowWriter):
    """Rows `name` and `content`, each one file: written aside by whatever attempt of a task, then moved into place in one step."""

    def __init__(self, folder: str):
        self.folder = folder

    def _opened(self):
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
        files.create_dir(place, recursive=True)
        return files, place

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stored:
        files, place = self._opened()
        done, size, made = 0, 0, set()
        for batch in iterator:
            for at in range(batch.num_rows):
                name, content = batch.column("name")[at].as_py(), batch.column("content")[at].as_py()
                if not name or name.startswith("/") or any(part in ("", ".", "..") or part.startswith(ASIDE) for part in name.split("/")):
                    raise ValueError(f"not the name of a file: {name!r}")
                under, _, last = name.rpartition("/")
                into = f"{place}/{under}" if under else place
                if into not in made:
                    files.create_dir(into, recursive=True)
                    made.add(into)
                aside = f"{into}/{ASIDE}{uuid.uuid4().hex}"
                try:
                    with files.open_output_stream(aside) as out:
                        out.write(content or b"")
                    files.move(aside, f"{into}/{last}")
                except BaseException:
                    if files.get_file_info(aside).is_file:
                        files.delete_file(aside)
                    raise
                done, size = done + 1, size + len(content or b"")
        return Stored(done, size)

    def commit(self, messages: list[Stored | None]) -> None:
        files, place = self._opened()
        with files.open_output_stream(f"{place}/_SUCCESS") as out:
            out.write(b"")


class NamedFiles(DataSource):
    """`df.write.format("named_files").mode("append").save(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("files are only added or replaced one by one: mode append")
        if "path" not in self.options:
            raise ValueError("give the folder that files go to")
        return NamedFilesWriter(self.options["path"])


def to_files(df: DataFrame, folder: str) -> None:
    """Write each row (`name`, `content`) as one file of folder, which all machines must be able to open by that name.

    A file is there whole or not at all, and a task that is tried again replaces what it had written with the same. Names may
    have folders in them. _SUCCESS is written when all are in place. Of rows that share a name one is kept, whichever comes last.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning workers need not find this package
    df.sparkSession.dataSource.register(NamedFiles)
    rows = df.select(df["name"].cast("string").alias("name"), df["content"].cast("binary").alias("content"))
    rows.write.format("named_files").mode("append").save(folder)
