"""Folders of small files as a source and a sink, which tasks list, read and write.

Sources and sinks go through Arrow's file systems, so a path is one that the executors reach: a mounted folder, or a store that
Arrow knows. Names and contents of files never pass through the driver; it sees the names of the first folders only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FILES = "path string, length bigint, modified timestamp, value string"
#: Bytes of files that a batch holds, about.
BATCH = 8 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Folders(InputPartition):
    """Some of the first folders below a path, each read with all that lies in it; "" is the path itself without its folders."""

    names: list[str]
    since: int = -1
    until: int = 1 << 62


class _FolderRows:
    def __init__(self, options: dict):
        self.path, self.suffix, self.tasks = options["path"].rstrip("/"), options.get("suffix", "").lower(), int(options.get("tasks", 64))

    def dealt(self, since: int = -1, until: int = 1 << 62) -> list[Folders]:
        own, root = _at(self.path)
        names = ["", *sorted(i.base_name for i in own.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", ".")))]
        n = max(1, min(self.tasks, len(names)))
        return [Folders(names[k::n], since, until) for k in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        own, root = _at(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        rows, size = [], 0
        for name in partition.names:
            for i in own.get_file_info(fs.FileSelector(f"{root}/{name}" if name else root, recursive=bool(name))):
                if i.type != fs.FileType.File or not i.base_name.lower().endswith(self.suffix) or i.base_name.startswith(("_", ".")) or not partition.since < i.mtime_ns // 1000 <= partition.until:
                    continue
                with own.open_input_stream(i.path) as f:
                    value = f.read().decode("utf-8", "replace")
                rows.append((prefix + i.path, i.size, i.mtime_ns // 1000, value))
                size += i.size + 100
                if size > BATCH:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        path, length, modified, value = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(length, pa.int64()), pa.array(modified, pa.timestamp("us", "UTC")), pa.array(value, pa.string())], ["path", "length", "modified", "value"])


class FolderReader(_FolderRows, DataSourceReader):
    def partitions(self) -> list[Folders]:
        return self.dealt()


class FolderStream(_FolderRows, DataSourceStreamReader):
    """Files as they arrive: an offset is a moment, and a batch has the files that were changed between two. ``settle`` seconds go by before a moment counts, for stores whose clocks differ."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.settle = float(options.get("settle", 2))

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": int((time.time() - self.settle) * 1e6)}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.dealt(start["until"], end["until"])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: int


class FolderWriter(DataSourceWriter):
    """One file for each row (name, content). A file is written under another name and then renamed, so none is ever half there, and a task that is run again writes the same files again.

    Before a task writes a file it notes its name in a journal of its own. A job that ends well leaves ``_SUCCESS`` with the number
    of files; of one that doesn't the journals tell what is to be removed.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite

    def write(self, rows: Iterator) -> Written:
        own, root = _at(self.path)
        journals, done, mine = f"{root}/_job-{self.job}", 0, uuid.uuid4().hex
        own.create_dir(journals)
        with own.open_output_stream(f"{journals}/{mine}") as journal:
            for row in rows:
                name = row["name"]
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is no name below a folder")
                journal.write((json.dumps(name) + "\n").encode())
                journal.flush()
                folder, _, last = f"{root}/{name}".rpartition("/")
                own.create_dir(folder)
                with own.open_output_stream(held := f"{folder}/.{last}.{mine}") as f:
                    f.write((row["content"] or "").encode())
                own.move(held, f"{folder}/{last}")
                done += 1
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        own, root = _at(self.path)
        own.create_dir(root)
        with own.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(json.dumps({"job": self.job, "files": sum(m.files for m in messages if m)}).encode())
        self._forget(own, root)

    def abort(self, messages: list[Written | None]) -> None:
        own, root = _at(self.path)
        for i in own.get_file_info(fs.FileSelector(f"{root}/_job-{self.job}", allow_not_found=True)):
            with own.open_input_stream(i.path) as f:
                for line in f.read().decode().splitlines():
                    at = f"{root}/{json.loads(line)}"
                    folder, _, last = at.rpartition("/")
                    for x in (at, f"{folder}/.{last}.{i.base_name}"):
                        if own.get_file_info(x).type == fs.FileType.File:
                            own.delete_file(x)
        self._forget(own, root)

    def _forget(self, own: fs.FileSystem, root: str) -> None:
        if own.get_file_info(f"{root}/_job-{self.job}").type == fs.FileType.Directory:
            own.delete_dir(f"{root}/_job-{self.job}")


class FolderSource(DataSource):
    """Options: path; suffix of the names to be read, without case; tasks, at most; settle, for streams. Names that begin with _ or . are left out."""

    @classmethod
    def name(cls) -> str:
        return "trackloom_folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FolderStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FolderWriter(self.options, overwrite)


def files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, length, modified, value) of the files below a folder, empty ones too; a name's case doesn't matter for its suffix."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(FolderSource.name()).option("suffix", suffix).load(path)


def file_stream(spark: SparkSession, path: str, suffix: str = "", settle: float = 2) -> DataFrame:
    """The same as a stream of files as they arrive or change."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format(FolderSource.name()).option("suffix", suffix).option("settle", settle).load(path)


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """Each row as a file of its own below path; a null content is an empty file. Of rows with one name the last one written stays, so names should differ."""
    rows.sparkSession.dataSource.register(FolderSource)
    rows.selectExpr(f"`{name}` as name", f"cast(`{content}` as string) as content").write.format(FolderSource.name()).mode("append").save(path)
