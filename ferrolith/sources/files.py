"""Folders of JSON files as a Spark data source, ``resource_files``: one row for a file, one file for a document.

Reading: ``spark.read.format("resource_files").load(folder)`` gives (path, scheme, length, value, error, name), a partition for files of up to ``PART_BYTES`` in
all. A file that cannot be read, is not UTF-8, no JSON or no object is a row with an error; so is a folder that is not there. Filters on ``path``, ``name`` and
``scheme`` are applied to the listing, where the session lets Python sources see them (``spark.sql.python.filterPushdown.enabled``), and by Spark otherwise.
The folder's own files are listed on the driver, those of its parts (sub-folders named ``key=value``) by the tasks that read them.
``readStream`` hands over files in order of their change times and names, those of a folder that come later with each trigger.

Writing: rows (name, value) become files of those names. Tasks write beside the folder, and the folder appears by one rename when all
of them are done; a task that runs again writes the same files again, and after a failure nothing is left. The folder must not exist, unless
it is overwritten; two documents of one name are an error. Many files belong in parts of the folder, dealt out by their names: the driver then holds the
parts' names alone, and when it commits counts files one after the other.

Any store that pyarrow's file systems reach can hold the folder.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched
from zlib import crc32

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import Row, StructType

from ferrolith.sources.resources import parsed
from ferrolith.sources.stores import files_in, is_part, store_of

NAME = "resource_files"
SCHEMA = "path string, scheme string, length bigint, value string, error string, name string"
#: Bytes and number of files in one partition.
PART_BYTES, PART_FILES = 32 << 20, 1_000
#: Files in one part of a folder, about, and parts in one partition.
FILES_A_PART, PARTS_AT_ONCE = 500, 2
#: How often the folder of an aborted write is looked for again.
ATTEMPTS = 10


def _listed(store: fs.FileSystem, folder: str, suffix: str) -> tuple[list[fs.FileInfo], list[str]]:
    """A folder's own files in order of their names, and its parts."""
    found = store.get_file_info(fs.FileSelector(folder))
    files = sorted((f for f in found if f.is_file and f.base_name.endswith(suffix)), key=lambda f: f.path)
    return files, sorted(f.path for f in found if f.type == fs.FileType.Directory and is_part(f.path))


@dataclass
class Files(InputPartition):
    """Some files of a folder, parts of it whose files the task lists, or what is wrong with the folder."""

    paths: list[str]
    error: str | None = None
    parts: tuple[str, ...] = ()

    def __init__(self, paths: list[str], error: str | None = None, parts: tuple[str, ...] = ()):
        super().__init__(None)
        self.paths, self.error, self.parts = paths, error, parts


def _grouped(files: Iterable[fs.FileInfo]) -> list[Files]:
    groups: list[Files] = []
    size = PART_BYTES
    for f in files:
        if size + f.size > PART_BYTES or len(groups[-1].paths) == PART_FILES:
            groups.append(Files([]))
            size = 0
        groups[-1].paths.append(f.path)
        size += f.size
    return groups


def _rows(folder: str, paths: Iterable[str]) -> Iterator[tuple]:
    store, _, scheme = store_of(folder)
    for path in paths:
        name = posixpath.basename(path)
        try:
            with store.open_input_stream(path) as stream:
                data = stream.read()
        except OSError as e:
            yield path, scheme, None, None, f"not readable: {type(e).__name__}", name
            continue
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            yield path, scheme, len(data), None, "not UTF-8", name
            continue
        value = parsed(text)
        yield path, scheme, len(data), text, "not JSON" if not value else None if isinstance(value[0], dict) else "not an object", name


class FolderReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.tests = folder, suffix, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.attribute in (("path",), ("scheme",), ("name",)) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, path: str, scheme: str) -> bool:
        for f in self.tests:
            own = {"path": path, "scheme": scheme, "name": posixpath.basename(path)}[f.attribute[0]]
            if isinstance(f, StringStartsWith):
                passed = own.startswith(f.value)
            else:
                passed = own in f.value if isinstance(f, In) else own == f.value
            if not passed:
                return False
        return True

    def partitions(self) -> list[Files]:
        store, inside, scheme = store_of(self.folder)
        if store.get_file_info(inside).type != fs.FileType.Directory:
            return [Files([], "not found")] if self._passes(self.folder, scheme) else [Files([])]
        files, parts = _listed(store, inside, self.suffix)
        found = _grouped(f for f in files if self._passes(f.path, scheme))
        return [*found, *(Files([], parts=some) for some in batched(parts, PARTS_AT_ONCE))] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _, scheme = store_of(self.folder)
        if partition.error:
            yield self.folder, scheme, None, None, partition.error, posixpath.basename(self.folder)
        yield from _rows(self.folder, partition.paths)
        for part in partition.parts:
            yield from _rows(self.folder, (p for p in files_in(store, part) if p.endswith(self.suffix) and self._passes(p, scheme)))


class FolderStream(DataSourceStreamReader):
    """An offset is the change time, in nanoseconds, and the path of the last file that was handed over."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def _marks(self) -> list[tuple[int, str, fs.FileInfo]]:
        store, inside, _ = store_of(self.folder)
        marks, todo = [], [inside] if store.get_file_info(inside).type == fs.FileType.Directory else []
        while todo:
            files, parts = _listed(store, todo.pop(), self.suffix)
            marks += [(f.mtime_ns or 0, f.path, f) for f in files]
            todo += parts
        return marks

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path, _ = max(self._marks(), default=(-1, "", None), key=lambda m: m[:2])
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _grouped(f for time, path, f in sorted(self._marks(), key=lambda m: m[:2]) if low < (time, path) <= high)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, partition.paths)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written."""

    files: int


class FolderWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, parts: int = 0):
        self.folder, self.overwrite, self.parts = folder, overwrite, parts
        store, inside, _ = store_of(folder)
        self.aside = f"{posixpath.dirname(inside)}/.{posixpath.basename(inside)}-{uuid.uuid4().hex}"
        # made here, on the driver, once: a task that outlives an aborted write finds no folder and leaves nothing
        store.create_dir(self.aside, recursive=True)
        for i in range(parts):
            store.create_dir(f"{self.aside}/part={i}", recursive=False)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, _, _ = store_of(self.folder)
        n = 0
        for row in iterator:
            if not row["name"] or "/" in row["name"]:
                raise ValueError(f"no name for a file: {row['name']!r}")
            # by the name alone: a task that runs again, and another document of this name, meet the same file
            place = f"{self.aside}/part={crc32(row['name'].encode('utf-8')) % self.parts}" if self.parts else self.aside
            unfinished = f"{place}/.{uuid.uuid4().hex}"
            with store.open_output_stream(unfinished) as stream:
                stream.write((row["value"] or "").encode("utf-8"))
            store.move(unfinished, f"{place}/{row['name']}")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        store, inside, _ = store_of(self.folder)
        there = sum(not posixpath.basename(f).startswith(".") for f in files_in(store, self.aside))
        if there != sum(m.files for m in messages if m):
            store.delete_dir(self.aside)
            raise ValueError("two documents have one name")
        if store.get_file_info(inside).type != fs.FileType.NotFound:
            if not self.overwrite:
                store.delete_dir(self.aside)
                raise FileExistsError(self.folder)
            store.delete_dir(inside)
        store.move(self.aside, inside)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, _ = store_of(self.folder)
        for _ in range(ATTEMPTS):  # tasks that are being stopped may still add a file
            try:
                if store.get_file_info(self.aside).type == fs.FileType.NotFound:
                    return
                store.delete_dir(self.aside)
            except OSError:
                time.sleep(0.2)


class ResourceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("suffix", ".json")

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(*self._folder())

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(*self._folder())

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self._folder()[0], overwrite, int(self.options.get("parts", "0")))


def register(spark: SparkSession) -> None:
    """Make ``resource_files`` known to the session, with filters on its listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResourceFiles)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).load(folder)


def parts_for(files: int) -> int:
    """Parts that hold about ``FILES_A_PART`` files each; none for fewer files."""
    return files // FILES_A_PART


def write_folder(documents: DataFrame, folder: str, overwrite: bool = False, parts: int = 0) -> None:
    """One file for each row (name, value) of ``documents``, in the folder itself or in so many parts of it."""
    register(documents.sparkSession)
    documents.select("name", "value").write.format(NAME).mode("overwrite" if overwrite else "append").option("parts", parts).save(folder)
