"""Byte ranges of binary files as rows, so that many tasks read one file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a task and of a row.
TASK, ROW = 1 << 25, 1 << 18


def _at(path: str):
    """The file system of a path and the path in it; a bare path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ByteRangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, record = options["path"], int(options["record"])
        self.task, self.row = (max(record, int(options[k]) // record * record) for k in ("task", "row"))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _at(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        return [Range(x.path, at, min(x.size, at + self.task)) for x in files for at in range(0, x.size, self.task)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        with _at(self.path)[0].open_input_file(part.path) as f:
            for at in range(part.start, part.end, self.row):
                content = f.read_at(min(self.row, part.end - at), at)
                yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([at], pa.int64()), pa.array([content], pa.binary())], names=["file", "start", "content"])


class ByteRanges(DataSource):
    """Format byte_ranges: options path, record (bytes that stay together), task and row (bytes of each)."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "file string, start long, content binary"

    def reader(self, schema) -> ByteRangeReader:
        return ByteRangeReader(self.options)


def byte_ranges(spark: SparkSession, path: str, record: int = 1, task: int = TASK, row: int = ROW) -> DataFrame:
    """(file, start, content): pieces of a binary file, or of all files of a folder, each cut where a record of so many bytes begins.
    A task reads its own range only, so a file may be longer than a row can hold. File systems that Arrow does
    not know are read by Spark's own source, a file a row."""
    try:
        _at(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.lit(0).cast("bigint").alias("start"), "content")
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(record=record, task=task, row=row).load(path)
