"""The data source ``level_archives``: text members of level archives, as a batch and as a stream.

One row per member that is asked for. Filters on ``map_id`` (the archive's name) decide which
archives are opened at all, filters on ``member`` which of their members are unpacked. Files
are dealt into partitions by size. Paths may be anything pyarrow's file systems read.

    register(spark)
    spark.read.format("level_archives").load("s3://bucket/maps").where("map_id = '3f2a'")
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from levelloom.sources.documents import MEMBER_SCHEMA

#: bytes of archives that one partition reads
PARTITION_BYTES = 64 << 20


@dataclass
class Archives(InputPartition):
    """Paths of archives that one task opens."""

    paths: list[str]


def _map_id(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".zip")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    if ":" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


class _Files:
    def __init__(self, path: str):
        self.system, self.base = file_system(path)

    def list(self) -> list[fs.FileInfo]:
        found = self.system.get_file_info(fs.FileSelector(self.base, recursive=True))
        return sorted((f for f in found if f.is_file and f.path.endswith(".zip")), key=lambda f: f.path)

    def members(self, path: str, wanted: set[str] | None) -> Iterator[tuple]:
        """A broken archive gives one null row, like ``archive_members``; audio is never unpacked."""
        map_id = _map_id(path)
        try:
            with self.system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                rows = [(map_id, name, pos, z.read(name).decode("utf-8", "replace")) for pos, name in enumerate(z.namelist())
                        if name.lower().endswith(".dat") and (wanted is None or name in wanted)]
        except (zipfile.BadZipFile, KeyError, OSError, ValueError):
            rows = [(map_id, None, None, None)]
        yield from rows


def _deal(files: list[fs.FileInfo], size: int) -> list[Archives]:
    """Partitions of about ``size`` bytes; one without files if there are none."""
    parts, held = [], 0
    for f in files:
        if not parts or held + f.size > size:
            parts, held = [*parts, Archives([])], 0
        parts[-1].paths.append(f.path)
        held += f.size
    return parts or [Archives([])]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.maps: set[str] | None = None
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and IN on both names are used here; every filter is also left to Spark, which costs nothing."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("map_id",):
                self.maps = values if self.maps is None else self.maps & values
            elif values is not None and f.attribute == ("member",):
                self.names = values if self.names is None else self.names & values
            yield f

    def partitions(self) -> list[Archives]:
        return _deal([f for f in _Files(self.path).list() if self.maps is None or _map_id(f.path) in self.maps], self.size)

    def read(self, partition: Archives) -> Iterator[tuple]:
        files = _Files(self.path)
        for p in partition.paths:
            yield from files.members(p, self.names)


class ArchiveStream(DataSourceStreamReader):
    """New archives in the order of their names; the offset is the last name seen.

    Archives are expected to arrive under growing names (a time stamp or a counter in front).
    """

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((f.path for f in _Files(self.path).list()), default="")}

    def partitions(self, start: dict, end: dict) -> list[Archives]:
        return _deal([f for f in _Files(self.path).list() if start["after"] < f.path <= end["after"]], self.size)

    def read(self, partition: Archives) -> Iterator[tuple]:
        files = _Files(self.path)
        for p in partition.paths:
            yield from files.members(p, None)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "level_archives"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self._size())

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(self.options["path"], self._size())

    def _size(self) -> int:
        return int(self.options.get("partitionBytes", PARTITION_BYTES))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters handed to it: they decide what is opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
