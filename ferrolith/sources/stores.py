"""Folders of a store: what they hold, one entry after the other, and their files as rows that are listed and read in tasks.

A folder's files are its own and those of its sub-folders named ``key=value``, as Spark reads partitions; other sub-folders are left alone. Listings of a local
folder are never held whole; pyarrow lists a folder of another store at once, so that many files belong in sub-folders there.
"""

from __future__ import annotations

import posixpath
import string
from collections.abc import Iterator
from itertools import batched
from os import scandir

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Paths, and bytes of content, that a task hands on at once.
PATHS_AT_ONCE, BYTES_AT_ONCE = 1_000, 1 << 20
_SHAPE = "path string, modificationTime timestamp, length bigint, content binary"
_TYPES = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
#: What Java leaves as it is in a URI's path.
_PLAIN = {*string.ascii_letters, *string.digits, *"_-!.~'()*:@&=+$,;/"}


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and scheme."""
    scheme, mark, _ = path.partition("://")
    if not mark or path.startswith("file:///"):
        return fs.LocalFileSystem(), posixpath.abspath(path.removeprefix("file://").removeprefix("file:")).rstrip("/"), "file"  # a name with % or a space is no URI
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside.rstrip("/"), scheme


def entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of the files and folders in a folder."""
    if isinstance(store, fs.LocalFileSystem):
        with scandir(folder) as found:
            for e in found:
                if e.is_dir() or e.is_file():
                    yield f"{folder}/{e.name}", e.is_dir()
    else:
        for f in store.get_file_info(fs.FileSelector(folder)):
            if f.type in (fs.FileType.Directory, fs.FileType.File):
                yield f.path, f.type == fs.FileType.Directory


def is_part(path: str) -> bool:
    """Whether a sub-folder is a part of its folder."""
    name = posixpath.basename(path)
    return "=" in name and not name.startswith(".")


def files_in(store: fs.FileSystem, folder: str) -> Iterator[str]:
    """Paths of a folder's files, those of its parts included."""
    for path, is_folder in entries(store, folder):
        if not is_folder:
            yield path
        elif is_part(path):
            yield from files_in(store, path)


def _hidden(path: str) -> bool:
    """Files that Spark's readers pass over."""
    name = posixpath.basename(path)
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether Spark would find a folder there that pyarrow reaches, too; a path without a scheme is one in Spark's default store."""
    bare = not path.startswith("file:") and "://" not in path
    if bare and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:"):
        return False
    try:
        store, inside, _ = store_of(path)
        return store.get_file_info(inside).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ImportError):
        return False


def _shown(scheme: str, path: str, as_uri: bool) -> str:
    """A path as Spark gives it: in ``binaryFile``, or as in ``_metadata.file_path``."""
    whole = f"{scheme}:{path}" if path.startswith("/") else f"{scheme}://{path}"
    return "".join(c if c in _PLAIN or ord(c) > 127 else f"%{ord(c):02X}" for c in whole) if as_uri else whole


def files_of(spark: SparkSession, folder: str, suffix: str = "", as_uris: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files, without hidden and empty ones: rows and paths as in Spark's ``binaryFile``.

    Tasks list and read; of the files the driver knows nothing. Parts are listed in as many tasks as a shuffle has, each in one of them.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def wanted(path: str) -> bool:
        return path.endswith(suffix) and not _hidden(path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside, _ = store_of(folder)
        for batch in batches:
            for _ in range(batch.num_rows):
                for some in batched((e for e in entries(store, inside) if (is_part if e[1] else wanted)(e[0])), PATHS_AT_ONCE):
                    yield pa.RecordBatch.from_pydict({"path": [p for p, _ in some], "part": [f for _, f in some]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, scheme = store_of(folder)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for file in filter(wanted, files_in(store, path)) if part else [path]:
                    changed = store.get_file_info(file).mtime_ns
                    with store.open_input_stream(file, compression=None) as stream:
                        data = stream.read()
                    if not data:
                        continue
                    held.append((_shown(scheme, file, as_uris), None if changed is None else changed // 1_000_000 * 1_000, len(data), data))
                    size += len(data)
                    if size >= BYTES_AT_ONCE or len(held) == PATHS_AT_ONCE:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    one = spark.range(0, 1, 1, 1)
    return one.mapInArrow(listed, "path string, part boolean").repartition(tasks, "path").mapInArrow(read, _SHAPE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)
