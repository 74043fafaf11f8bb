"""A sink that writes each row (name, text) as a file of its own, by tasks: all notes or none.

    spark.dataSource.register(Notes)
    notes.write.format("notes").mode("overwrite").save("file:///shared/vault")

Tasks write into a staging folder beside the target, each file in a passing folder of the task's own,
from which it is renamed when it is whole, so a task that runs twice leaves the same file once.  A commit
puts the folder in the target's place by a rename, however many notes there are; an abort
deletes it.  Folders are reached by URI through Arrow's file systems, so it can be any store that driver
and executors share.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names that are listed, and files and bytes of them that are read, at once.
NAMES, BYTES = 1000, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


@dataclass
class Written(WriterCommitMessage):
    notes: int


class NotesWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        if not {"name", "text"} <= set(columns):
            raise ValueError("notes have a name and a text")
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = opened(self.staging)
        folders, names = set(), set()
        own = f"{root}-passing/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        passing = f"{own}/note"  # tasks make files in folders of their own, as they would wait for each other in one
        for row in iterator:
            name = posixpath.normpath(row["name"] or "")
            if name.startswith(("/", "..")) or name in (".", ""):
                raise ValueError(f"not a name of a note: {row['name']!r}")
            if name in names:
                raise ValueError(f"two notes of one name: {name}")
            names.add(name)
            to = f"{root}/{name}"
            if (folder := posixpath.dirname(to)) not in folders:
                store.create_dir(folder, recursive=True)
                folders.add(folder)
            with store.open_output_stream(passing) as f:
                f.write((row["text"] or "").encode())
            store.move(passing, to)
        return Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staged = opened(self.staging)
        self._clear(store, f"{staged}-passing")
        _, target = opened(self.path)
        store.create_dir(staged, recursive=True)
        old = f"{staged}-before"
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            store.delete_dir(staged)
            raise ValueError(f"{self.path} is there already")
        if there:
            store.move(target, old)
        store.move(staged, target)
        if there:
            store.delete_dir(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staged = opened(self.staging)
        self._clear(store, f"{staged}-passing")
        self._clear(store, staged)

    @staticmethod
    def _clear(store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NotesWriter(self.options["path"], schema.fieldNames(), overwrite)


def write(notes: DataFrame, path: str, *, overwrite: bool = True) -> None:
    """Each note a file under ``path``; notes of one name meet in one task, which refuses the second."""
    notes.sparkSession.dataSource.register(Notes)
    notes.select("name", "text").repartition("name").write.format("notes").mode("overwrite" if overwrite else "append").save(path)


def files(path: str) -> Iterator[str]:
    """Names of all files under ``path``, hidden ones left out; a local folder is never a list as a whole."""
    store, root = opened(path)
    local = isinstance(store, fs.LocalFileSystem)
    folders = [""]
    while folders:
        folder = folders.pop()
        with os.scandir(f"{root}/{folder}") if local else nullcontext(store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/")))) as held:
            for x in held:
                name = x.name if local else x.base_name
                if name.startswith("."):
                    continue
                if x.is_dir() if local else x.type == fs.FileType.Directory:
                    folders.append(f"{folder}{name}/")
                else:
                    yield f"{folder}{name}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of all files under ``path`` that have a text; empty files are passed over.

    A task lists the names and others read the files, so the driver holds none of them, however many there are.
    """
    path = path.rstrip("/")
    store, root = opened(path)
    if store.get_file_info(root).type != fs.FileType.Directory:
        raise FileNotFoundError(path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for some in batched(files(path), NAMES):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["name"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        names, held, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], names=["name", "content"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as f:
                    content = f.read()
                if not content:
                    continue
                names.append(name)
                held.append(content)
                size += len(content)
                if size >= BYTES or len(names) >= NAMES:
                    yield out()
                    names, held, size = [], [], 0
        if names:
            yield out()

    tasks = 4 * spark.sparkContext.defaultParallelism
    found = spark.range(1, numPartitions=1).mapInArrow(listed, "name string").repartition(tasks, "name").mapInArrow(contents, "name string, content binary")
    return found.select("name", F.decode("content", "UTF-8").alias("text"))
