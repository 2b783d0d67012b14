"""A sink for one text file per row, named by the row, as a Spark data source with task commits.

A task writes every text to the staging folder and moves it to its name when it is whole, so a reader never sees
part of a file, and an attempt that is repeated puts the same texts in the same places. What lost attempts
leave behind lies in the staging folder, which goes when the job commits or aborts. Tasks don't make that folder,
so one that is still at work when its job has ended can't write any more.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "named_text"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a local path or of a URI such as ``file:/…``, ``hdfs://…`` or ``s3://…``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path.rstrip("/")))


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedTextFiles(DataSource):
    """Write-only format ``named_text``: columns ``name`` and ``text`` (null: empty) into a folder that is new or empty."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> NamedTextWriter:
        path = self.options["path"]
        system, folder = _open(path)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        if found and not overwrite:
            raise ValueError(f"{path} is not empty")
        if found:
            system.delete_dir_contents(folder)
        made = NamedTextWriter(path)
        system.create_dir(f"{folder}/{made.staging}", recursive=True)
        return made


class NamedTextWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.staging = f"_staging-{uuid.uuid4().hex}"  # hidden from Spark's readers

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open(self.path)
        files = 0
        for batch in iterator:
            if system.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.NotFound:
                raise OSError(f"the job that writes {self.path} has ended")
            for name, text in zip(batch.column("name"), batch.column("text")):
                part, whole = f"{folder}/{self.staging}/{uuid.uuid4().hex}", f"{folder}/{name.as_py()}"
                with system.open_output_stream(part) as out:
                    out.write((text.as_py() or "").encode())
                if system.get_file_info(whole).type != fs.FileType.NotFound:  # by an attempt before
                    system.delete_file(whole)
                system.move(part, whole)
                files += 1
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        system.delete_dir(f"{folder}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        """The folder was empty when the job began, so all that is in it comes from this job."""
        system, folder = _open(self.path)
        system.delete_dir_contents(folder, missing_dir_ok=True)
