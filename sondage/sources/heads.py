"""A data source that lists files and reads the first bytes of each, whatever their size.

``spark.read.format("file_heads").load(root)`` gives ``path, length, head, shape`` of every file
below a folder, paths relative to it. The driver lists one level; each folder on it is listed
by a task of its own, and the files of that level are dealt in runs of ``FILES_PER_TASK``. A
task opens a file only to read its first bytes; option ``known`` (extensions, comma-separated)
leaves files of these extensions closed, and ``sniff`` false leaves all closed. With ``shapes``
true ``shape`` says how a table file is laid out: the schema in a Parquet file's footer, the
first line of a text file.

Paths are opened by pyarrow: local ones, and the schemes it knows (s3, gs, hdfs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_PER_TASK = 1000
HEAD_BYTES = 10
BATCH = 4096
LINE_BYTES = 1 << 16  # a first line is looked for in so many
SCHEMA = "path string, length bigint, head binary, shape string"


@dataclass
class Part(InputPartition):
    """A folder to list, or files that are already listed."""

    folder: str | None
    files: list[tuple[str, int]]


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if root.startswith("file:"):
        root = "/" + root[len("file:"):].lstrip("/")
    system, place = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return system, place.rstrip("/")


def shape(system: fs.FileSystem, path: str) -> str | None:
    """The schema or first line of a table file; null where it cannot be read."""
    kind = path.rpartition(".")[2].lower()
    try:
        with system.open_input_file(path) as file:
            if kind == "parquet":
                return ", ".join(f"{f.name} {f.type}" for f in pq.read_schema(file))
            if kind in ("csv", "tsv", "txt"):
                return file.read(LINE_BYTES).split(b"\n")[0].decode("utf-8", "replace").rstrip("\r")
            return kind
    except (OSError, pa.ArrowInvalid):
        return None


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        known = {e for e in self.options.get("known", "").split(",") if e}
        on = lambda name, default: str(self.options.get(name, default)).lower() == "true"
        return HeadsReader(self.options["path"], known, on("sniff", "true"), on("shapes", "false"))


class HeadsReader(DataSourceReader):
    def __init__(self, root: str, known: set[str], sniff: bool, shapes: bool):
        self.root, self.known, self.sniff, self.shapes = root, known, sniff, shapes

    def partitions(self) -> list[InputPartition]:
        system, place = opened(self.root)
        found = system.get_file_info(place)
        if found.type == fs.FileType.File:
            return [Part(None, [(place, found.size)])]
        top = system.get_file_info(fs.FileSelector(place))
        files = [(f.path, f.size) for f in top if f.type == fs.FileType.File]
        folders = [Part(f.path, []) for f in top if f.type == fs.FileType.Directory]
        return folders + [Part(None, files[i:i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)]

    def _files(self, system: fs.FileSystem, part: Part) -> Iterator[tuple[str, int]]:
        if part.folder is None:
            yield from part.files
        else:
            for info in system.get_file_info(fs.FileSelector(part.folder, recursive=True)):
                if info.type == fs.FileType.File:
                    yield info.path, info.size

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, place = opened(self.root)
        rows: list[tuple[str, int, bytes | None, str | None]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.string()))],
                                             ["path", "length", "head", "shape"])
            rows.clear()
            return out

        for path, size in self._files(system, partition):
            name = path.rsplit("/", 1)[-1]
            head = None
            if self.sniff and (name.rpartition(".")[2].lower() not in self.known or "." not in name[1:]):
                with system.open_input_file(path) as file:
                    head = file.read(HEAD_BYTES)
            relative = path[len(place) + 1:] if path.startswith(place + "/") else name
            rows.append((relative, size, head, shape(system, path) if self.shapes else None))
            if len(rows) == BATCH:
                yield batch()
        yield batch()


def register(spark: SparkSession) -> None:
    """Make the source known to a session; doing so again changes nothing."""
    spark.dataSource.register(FileHeads)
