"""Upload folders as a data source that opens file heads only, in batch and as a stream."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from docsheaf.session import ship

#: Bytes read at a time from a file's start, more only while all of them are white space.
HEAD_BYTES = 1024
WHITE = b" \t\n\x0b\x0c\r"
SCHEMA = "path string, size long, modified_ms long, head binary"
#: Files that are younger than this aren't given to a stream yet: another of the same time may still come.
SETTLED_MS = 2000


class FileGroup(InputPartition):
    """Files that one task reads: (path, size, modified in ms)."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def listed(path: str) -> list[tuple[str, int, int]]:
    """All files below a path, in order of time and name. Runs on the driver, as Spark's own listings do; sizes and times
    come with the listing, no file is opened."""
    system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    files = [(f.path, f.size or 0, f.mtime_ns // 1_000_000) for f in found if f.type == fs.FileType.File]
    return sorted(files, key=lambda f: (f[2], f[0]))


def head_of(stream, size: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file from the first that isn't white space on, at most `size` of them."""
    while part := stream.read(size):
        if bare := part.lstrip(WHITE):
            return bare
    return b""


def _groups(files: list[tuple[str, int, int]], per_task: int) -> list[FileGroup]:
    # One empty group where there are no files: Spark reads a source without partitions as one that can't be split.
    return [FileGroup(files[k : k + per_task]) for k in range(0, max(len(files), 1), per_task)]


class _Heads:
    def __init__(self, options: dict[str, str]):
        self.path, self.per_task = options["path"], int(options.get("filesPerTask", "1000"))

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        if not partition.files:
            return
        system, heads = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")[0], []
        for path, size, _ in partition.files:
            with system.open_input_file(path) as stream:
                heads.append(head_of(stream) if size else b"")
        columns = [pa.array(c, kind) for c, kind in zip(zip(*partition.files, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(heads, pa.binary())], names=["path", "size", "modified_ms", "head"])


class _BatchReader(_Heads, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return _groups(listed(self.path), self.per_task)


class _StreamReader(_Heads, DataSourceStreamReader):
    """Offsets are times: a batch has the files from one time up to, and without, another."""

    def initialOffset(self) -> dict:
        return {"before_ms": 0}

    def latestOffset(self) -> dict:
        limit = int(time.time() * 1000) - SETTLED_MS
        times = [modified for *_, modified in listed(self.path) if modified < limit]
        return {"before_ms": times[-1] + 1 if times else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _groups([f for f in listed(self.path) if start["before_ms"] <= f[2] < end["before_ms"]], self.per_task)

    def commit(self, end: dict) -> None: ...


class UploadHeads(DataSource):
    """Rows (path, size, modified_ms, head) of the files below `path`, empty ones too. Option filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "upload_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def upload_heads(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The files below path with their heads; as a stream, each file once, when it is SETTLED_MS old."""
    ship(spark).dataSource.register(UploadHeads)
    return (spark.readStream if stream else spark.read).format("upload_heads").load(path)
