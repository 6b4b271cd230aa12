"""A folder of files as a data source: batch and stream, listed and read by tasks.

The driver lists folders only, level by level, until it has about as many as `partitions` asks for; a partition is one folder with its own
files, or, at the last level reached, with all that lies below. Tasks list the files, those with names that begin with _ or . too, in
the order of their names, and read them one by one. Files may lie wherever the driver and the executors both reach them.

As a stream, a batch holds the files that were modified between the time at which the last one ended and its own, which lies
`settle_seconds` before now, so that files that are being written are whole. A file that is moved in with an older time is not seen.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from paperloom.sources.shared import file_system

SCHEMA = "path string, directory string, name string, length long, modified timestamp, content binary"
COLUMNS = pa.schema([("path", pa.string()), ("directory", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("content", pa.binary())])
#: Folders that the driver looks for, and bytes of files that a task hands on at once; one larger file is handed on alone.
PARTITIONS, BATCH_BYTES = 64, 16 << 20


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool
    since: int = -1
    until: int = 1 << 62


def folders(root: str, wanted: int) -> list[Folder]:
    """Folders below root and root itself; the last level stands for all that is below it."""
    store, top = file_system(root)
    level, done = [top.rstrip("/") or "/"], []
    while level and len(level) + len(done) < wanted:
        below = []
        for at in level:
            below += [x.path for x in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda x: x.base_name) if x.type == fs.FileType.Directory]
        done += [Folder(x, False) for x in level]
        level = below
    return done + [Folder(x, True) for x in level]


def files(store: fs.FileSystem, folder: Folder) -> Iterator[fs.FileInfo]:
    """A folder's files by name, then those of the folders in it."""
    found = sorted(store.get_file_info(fs.FileSelector(folder.path)), key=lambda x: x.base_name)
    yield from (x for x in found if x.type == fs.FileType.File and folder.since < (x.mtime_ns or 0) <= folder.until)
    if folder.deep:
        for x in found:
            if x.type == fs.FileType.Directory:
                yield from files(store, Folder(x.path, True, folder.since, folder.until))


class Listed:
    """What both readers do."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("path: the folder to read")
        self.root, self.wanted = options["path"], int(options.get("partitions", PARTITIONS))
        self.kinds = tuple(x.strip().lower() for x in options.get("suffixes", "").split(",") if x.strip())
        self.settle = float(options.get("settle_seconds", 1.0))

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, held, size = file_system(self.root)[0], [], 0
        for x in files(store, partition):
            if self.kinds and not x.base_name.lower().endswith(self.kinds):
                continue
            with store.open_input_file(x.path) as f:
                content = f.read()
            if held and size + len(content) > BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
            held.append((x.path, x.path.rpartition("/")[0], x.base_name, len(content), (x.mtime_ns or 0) // 1000, content))
            size += len(content)
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COLUMNS.types, strict=True)], schema=COLUMNS)


class Reader(Listed, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return folders(self.root, self.wanted)


class StreamReader(Listed, DataSourceStreamReader):
    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(x.path, x.deep, start["until"], end["until"]) for x in folders(self.root, self.wanted)]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def commit(self, end: dict) -> None:
        """What was read is known by its time."""


class FolderSource(DataSource):
    """spark.read.format("paperloom_folder").load(path). Options: partitions, suffixes (comma-separated; any if none), settle_seconds."""

    @classmethod
    def name(cls) -> str:
        return "paperloom_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


