"""A folder that is polled: files as a Spark data source, whose stream remembers each file's validator and reads what has changed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.sources.landing import place_of

NAME = "polled_files"
SCHEMA = "file string, validator string, line long, text string"
_ARROW = pa.schema([("file", pa.string()), ("validator", pa.string()), ("line", pa.int64()), ("text", pa.string())])
#: Lines in a batch that a reader hands over.
LINES = 10_000


@dataclass
class PolledFile(InputPartition):
    file: str
    validator: str


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(place_of(path))


def validators(path: str) -> dict[str, str]:
    """Each file under path with its validator, from its size and the time of its last change; hidden files do not count."""
    from pyarrow import fs

    system, root = _place(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = ((f, f.path.removeprefix(root).lstrip("/")) for f in found if f.type == fs.FileType.File)
    return {name: f"{f.size}-{f.mtime_ns}" for f, name in sorted(names, key=lambda x: x[1]) if not any(part[:1] in "._" for part in name.split("/"))}


def read_lines(path: str, file: PolledFile) -> Iterator[pa.RecordBatch]:
    """The lines of a file, numbered from 1; a file that has gone meanwhile has none. Bytes that are no UTF-8 are replaced."""
    import io

    system, root = _place(path)
    try:
        stream = system.open_input_stream(f"{root.rstrip('/')}/{file.file}")
    except FileNotFoundError:
        return
    with stream, io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline=None) as text:
        rows: list[str] = []
        done = 0
        for line in text:
            rows.append(line.rstrip("\n"))
            if len(rows) == LINES:
                yield _batch(file, rows, done)
                done, rows = done + len(rows), []
        if rows:
            yield _batch(file, rows, done)


def _batch(file: PolledFile, rows: list[str], done: int) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([file.file] * n), pa.array([file.validator] * n), pa.array(range(done + 1, done + n + 1), pa.int64()), pa.array(rows, pa.string())], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[PolledFile]:
        return [PolledFile(f, v) for f, v in validators(self.path).items()] or [PolledFile("", "")]

    def read(self, partition: PolledFile) -> Iterator[pa.RecordBatch]:
        return read_lines(self.path, partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are the validators of all files, as one JSON text; a batch reads the files whose validator is another than at its start."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(validators(self.path), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[PolledFile]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [PolledFile(f, v) for f, v in now.items() if before.get(f) != v]

    def read(self, partition: PolledFile) -> Iterator[pa.RecordBatch]:
        return read_lines(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class PolledFiles(DataSource):
    """Lines of the files under the option path. Files are partitions, read where the tasks run, on any file system that Arrow knows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def poll(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of new and changed files under path."""
    spark.dataSource.register(PolledFiles)
    return spark.readStream.format(NAME).option("path", path).load()


def read_all(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PolledFiles)
    return spark.read.format(NAME).option("path", path).load()
