"""One file for each row: a data source that writes ``name`` and ``content`` (text) into a folder, and reads them back.

Tasks write below a staging folder of the job; the commit moves the folders of the attempts that counted, one for each task, and drops the rest, so
neither a task that failed, nor one that ran twice, leaves a file. An abort drops all of it; what a task that still ran
then writes stays in the staging folder, whose name hides it from readers. Tasks that read list a folder each, so
the driver knows the folders, as many as tasks have written, but never the files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "lectern_files"
_UNSAFE = re.compile(r"[\x00-\x1f/\\:*?\"<>|]+")


def file_name(name: str | None) -> str:
    """A name that any store takes: separators and marks as ``_``, 200 bytes at most; a missing or empty one is ``unnamed``."""
    clean = _UNSAFE.sub("_", name or "").strip(". ")
    while len(clean.encode()) > 200:
        stem, dot, ending = clean.rpartition(".")
        clean = f"{stem[:-1]}{dot}{ending}" if stem else clean[:-1]
    return clean or "unnamed"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = _store(self.path)
        folder, used, n = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{self.job[:8]}", {}, 0
        for row in iterator:
            if not n:
                files.create_dir(f"{self._staging(root)}/{folder}", recursive=True)
            name, n = file_name(row.name), n + 1
            used[name] = again = used.get(name, 0) + 1
            if again > 1:  # a name that this task has written already
                stem, dot, ending = name.rpartition(".")
                name = f"{stem or ending} ({again}){dot if stem else ''}{ending if stem else ''}"
            with files.open_output_stream(f"{self._staging(root)}/{folder}/{name}", compression=None) as out:
                out.write((row.content or "").encode())
        return Written(folder if n else None, n)

    def commit(self, messages: list) -> None:
        files, root = _store(self.path)
        for m in messages:
            if m and m.folder:
                files.move(f"{self._staging(root)}/{m.folder}", f"{root}/{m.folder}")
        self._drop(files, root)

    def abort(self, messages: list) -> None:
        self._drop(*_store(self.path))

    def _drop(self, files, root: str) -> None:
        from pyarrow.fs import FileType

        if files.get_file_info(self._staging(root)).type == FileType.Directory:
            files.delete_dir(self._staging(root))


@dataclass
class Folder(InputPartition):
    """What one task reads: a folder with all below it, or the files that lie at the top."""

    path: str
    below: bool


class FileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[Folder]:
        from pyarrow.fs import FileSelector, FileType

        files, root = _store(self.path)
        found = [f for f in files.get_file_info(FileSelector(root)) if not f.base_name.startswith(("_", "."))]
        folders = [Folder(f.path, True) for f in found if f.type == FileType.Directory]
        return folders + [Folder(root, False)] * any(f.type == FileType.File for f in found)

    def read(self, folder: Folder) -> Iterator[tuple]:
        from pyarrow.fs import FileSelector, FileType

        files, _ = _store(self.path)
        for f in files.get_file_info(FileSelector(folder.path, recursive=folder.below)):
            if f.type == FileType.File and (folder.below or not f.base_name.startswith(("_", "."))):
                with files.open_input_stream(f.path, compression=None) as data:
                    yield f.base_name, data.read().decode("utf-8", "replace")


class FileExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content string"

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("rows to write are name, content")
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """A file for each row of ``name``, ``content`` in folders of ``path``, one for each task."""
    rows.sparkSession.dataSource.register(FileExport)
    rows.select(F.col("name").cast("string"), F.col("content").cast("string")).write.format(FORMAT).mode("append").save(path)


def read_files_back(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``content`` of each file written."""
    spark.dataSource.register(FileExport)
    return spark.read.format(FORMAT).load(path)
