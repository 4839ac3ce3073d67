"""Folder scans: every file one row, and a bad file a row with a reason rather than a failed job.

A folder is a data source of its own (``folder_files``), because the engine's binary source leaves out empty files and
names that begin with a dot or an underscore, and lists on the driver. Here each of a number of shards reads the folder's
names as a stream, keeps those whose CRC is its own, and hashes them in blocks, so that the driver sees no name at all and
a task holds one block and a batch of rows, however many files there are. Executors have to see the folder.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions.text import file_type
from lodestrata.operators.diff import OK, UNREADABLE, UNSUPPORTED
from lodestrata.operators.order import placed
from lodestrata.settings import Settings

UNSUPPORTED_REASON = "files of this type are not read"
NAME_REASON = "the file's name is not UTF-8"
BATCH = 1024
_COLUMNS = pyarrow.schema([("file_name", pyarrow.string()), ("path", pyarrow.string()), ("listed_bytes", pyarrow.int64()), ("scan_state", pyarrow.string()), ("digest", pyarrow.string()), ("size_bytes", pyarrow.int64()), ("reason", pyarrow.string())])


class FolderNotFound(FileNotFoundError):
    """A folder that is missing is not a folder without files: nothing may be taken as removed."""


def open_stream(path: str):
    """A readable stream of a listed path, local or remote."""
    from pyarrow import fs

    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def entries(folder: str) -> Iterator[tuple[str, str, int | None]]:
    """(name, path, bytes) of the plain files of one folder, as a stream where the file system has one."""
    if folder.startswith("file:"):
        root = "/" + folder[5:].strip("/")
        with os.scandir(root) as found:
            for entry in found:
                try:
                    if entry.is_file():
                        yield entry.name, f"file:{root.rstrip('/')}/{entry.name}", entry.stat().st_size
                except OSError:
                    yield entry.name, f"file:{root.rstrip('/')}/{entry.name}", None
        return
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(folder)
    for info in system.get_file_info(fs.FileSelector(name)):
        if info.type == fs.FileType.File:
            yield info.base_name, f"{folder.rstrip('/')}/{info.base_name}", info.size


class _Shard(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class FolderFiles(DataSource):
    """Options: ``path``; ``shards``; ``types``, the endings of files to hash, comma-separated (without it none is opened);
    ``block``, the bytes hashed at once."""

    opener, entries = staticmethod(open_stream), staticmethod(entries)

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "file_name string, path string, listed_bytes bigint, scan_state string, digest string, size_bytes bigint, reason string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options), self.opener, self.entries)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str], opener, listed):
        self.path, self.shards, self.block = options["path"], int(options.get("shards", 8)), int(options.get("block", 1 << 20))
        self.types = {t for t in options.get("types", "").split(",") if t}
        self.opener, self.listed = opener, listed

    def partitions(self) -> list[_Shard]:
        return [_Shard(k) for k in range(self.shards)]

    def read(self, partition: _Shard) -> Iterator[pyarrow.RecordBatch]:
        rows: list[tuple] = []
        for name, path, size in self.listed(self.path):
            if zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.shards == partition.number:
                rows.append(self._row(name, path, size))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _row(self, name: str, path: str, size: int | None) -> tuple:
        try:
            name.encode()
        except UnicodeEncodeError:
            shown = name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            return shown, None, size, UNREADABLE, None, None, NAME_REASON
        stem, _, kind = name.rpartition(".")
        if not stem or kind.lower() not in self.types:
            return name, path, size, UNSUPPORTED, None, None, UNSUPPORTED_REASON
        digest, n = hashlib.sha256(), 0
        try:
            with self.opener(path) as f:
                while data := f.read(self.block):
                    digest.update(data)
                    n += len(data)
        except OSError as e:
            return name, path, size, UNREADABLE, None, None, e.strerror or str(e)
        return name, path, size, OK, digest.hexdigest(), n, None

    def _batch(self, rows: list[tuple]) -> pyarrow.RecordBatch:
        return pyarrow.RecordBatch.from_arrays([pyarrow.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], schema=_COLUMNS)


def folder_files(spark: SparkSession, folder: str, types: tuple[str, ...] = (), settings: Settings = Settings(), source: type[FolderFiles] = FolderFiles, shards: int | None = None) -> DataFrame:
    """The rows of the source for one folder; folders in it are not entered. A missing folder raises at once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        raise FolderNotFound(f"there is no folder {folder}")
    spark.dataSource.register(source)
    options = {"path": fs.makeQualified(at).toString(), "types": ",".join(types), "block": str(settings.hash_block_bytes), "shards": str(shards or 4 * spark.sparkContext.defaultParallelism)}
    return spark.read.format(source.name()).options(**options).load()


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, path, listed_bytes, ord of the plain files of one folder. ``ord`` is the place by name, from 0, for whoever
    wants the rows in order."""
    return placed(folder_files(spark, folder).select("file_name", "path", "listed_bytes"), ("file_name",))


def scan_folder(spark: SparkSession, folder: str, settings: Settings = Settings(), opener=open_stream) -> DataFrame:
    """file_name, path, file_type, scan_state (ok, unsupported, unreadable), digest, size_bytes, reason, ord.

    The size is counted from the bytes that were hashed. Only files of supported types are opened. The result is a stored
    table: what is done with it reads no file again."""
    source = FolderFiles if opener is open_stream else type("FolderFiles", (FolderFiles,), {"opener": staticmethod(opener)})
    rows = folder_files(spark, folder, settings.supported_types, settings, source).withColumn("file_type", file_type("file_name"))
    return placed(rows.select("file_name", "path", "file_type", "scan_state", "digest", "size_bytes", "reason"), ("file_name",))
