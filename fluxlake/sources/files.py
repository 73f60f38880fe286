"""A sink for files with names of their own: one file per row, written by tasks.

``named_files`` is a Python data source for rows ``(path, content)``. Tasks write into a job folder beside the target, each
file under a temporary name first, so a task that runs twice leaves the same files; when the job has
succeeded that folder is renamed to the target, in one step. Nothing but counts reaches the driver. File systems are
those of pyarrow (local, HDFS, object stores).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_files"
TEMPORARY = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFileWriter(DataSourceWriter):
    def __init__(self, uri: str) -> None:
        self.uri = uri.rstrip("/")
        self.job = f"{self.uri}-{uuid.uuid4().hex}"

    @staticmethod
    def _at(uri: str) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = self._at(self.job)
        own = f"{root}/{TEMPORARY}/{TaskContext.get().taskAttemptId()}"
        system.create_dir(own, recursive=True)
        files, folders = 0, set()
        for row in iterator:
            parts = row["path"].split("/")
            if not all(parts) or ".." in parts or parts[0] == TEMPORARY:
                raise ValueError(f"not a path below the target: {row['path']}")
            folder = "/".join([root, *parts[:-1]])
            if folder not in folders:
                system.create_dir(folder, recursive=True)
                folders.add(folder)
            with system.open_output_stream(f"{own}/{files}") as out:
                out.write(bytes(row["content"] or b""))
            system.move(f"{own}/{files}", f"{folder}/{parts[-1]}")
            files += 1
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._at(self.job)
        _, target = self._at(self.uri)
        system.create_dir(root, recursive=True)
        if system.get_file_info(f"{root}/{TEMPORARY}").type.name == "Directory":
            system.delete_dir(f"{root}/{TEMPORARY}")
        if system.get_file_info(target).type.name != "NotFound":
            system.delete_dir(root)
            raise FileExistsError(f"{self.uri} exists")
        system.move(root, target)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self._at(self.job)
        if system.get_file_info(root).type.name == "Directory":
            system.delete_dir(root)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"])


def write_named_files(files: DataFrame, uri: str) -> None:
    """Write ``path`` (below ``uri``) and ``content`` of every row as a file. An existing target is an error."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("path", files["content"].cast("binary").alias("content")).write.format(FORMAT).mode("append").save(uri)
