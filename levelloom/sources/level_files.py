"""The data sink ``level_files``: one document file per level, written part by part.

A finished document is one file by format, but it need not be one value anywhere: parts of a
fixed number of events arrive in order and are appended to an open file, so the memory of a
task is that of one part, however long the level is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from levelloom.functions.scalars import lookup
from levelloom.operators.parity import K_COLS
from levelloom.sources.archive_source import file_system
from levelloom.sources.documents import V3_ARRAYS
from levelloom.sources.writers import DOCUMENT_HEAD, DOCUMENT_TAIL, PART_ROWS, level_fragments

_NAMES = [name for name, _ in V3_ARRAYS.values()]


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Document:
    """An open document: arrays in their order, each in as many parts as it comes in."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.system, self.path, self.temporary = system, path, f"{path}.{uuid.uuid4().hex}.tmp"
        system.create_dir(path.rsplit("/", 1)[0])
        self.out = system.open_output_stream(self.temporary)
        self.array, self.part = -1, -1
        self._put(DOCUMENT_HEAD)

    def _put(self, text: str) -> None:
        self.out.write(text.encode())

    def _to(self, array: int) -> None:
        """Close the open array and write those passed over as empty ones."""
        while self.array < array:
            self._put(("]," if self.array >= 0 else "") + (f'"{_NAMES[self.array + 1]}":[' if self.array + 1 < len(_NAMES) else ""))
            self.array, self.part = self.array + 1, -1

    def add(self, array: int, part: int, text: str) -> None:
        if (array, part) <= (self.array, self.part):
            raise ValueError(f"parts of {self.path} are out of order")
        self._to(array)
        self._put(text if self.part < 0 else "," + text)
        self.part = part

    def close(self) -> None:
        """The file takes its name once it is whole; written again, it is replaced by the same content."""
        self._to(len(_NAMES))
        self._put(DOCUMENT_TAIL)
        self.out.close()
        self.system.move(self.temporary, self.path)

    def drop(self) -> None:
        self.out.close()
        self.system.delete_file(self.temporary)


class LevelWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        system, base = file_system(self.path)
        now, document, files = None, None, 0
        try:
            for map_id, difficulty, array, part, text in rows:
                if (map_id, difficulty) != now:
                    if document is not None:
                        document.close()
                    now, files = (map_id, difficulty), files + 1
                    document = _Document(system, f"{base}/{map_id}/{difficulty}Standard.dat")
                document.add(array, part, text)
            if document is not None:
                document.close()
        except BaseException:
            if document is not None:
                document.drop()
            raise
        return Written(files)


class LevelFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "level_files"

    def schema(self) -> str:
        return "map_id string, difficulty string, array int, part bigint, text string"

    def writer(self, schema: StructType, overwrite: bool) -> LevelWriter:
        return LevelWriter(self.options["path"])


def write_level_files(events: DataFrame, path: str, rows: int = PART_ROWS) -> None:
    """Write every level as ``<path>/<map_id>/<difficulty>Standard.dat``.

    Parts of a level meet in one task, sorted by Spark (which spills), and stream to its file.
    """
    events.sparkSession.dataSource.register(LevelFiles)
    number = lookup({k: i for i, k in enumerate(V3_ARRAYS)}, F.col("kind"), 0).cast("int")
    parts = level_fragments(events, rows).select(F.col("map_id").cast("string").alias("map_id"), "difficulty", number.alias("array"), F.col("part").cast("bigint").alias("part"), "text")
    parts.repartition(*K_COLS).sortWithinPartitions(*K_COLS, "array", "part").write.format("level_files").mode("append").save(path)
