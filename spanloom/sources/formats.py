"""Formats for spark.read and spark.readStream: standoff annotation files and the mappings of workbooks.

A read plans its partitions from the list of files, about PARTITION_BYTES of them each; the files of a partition are opened by the task that reads it. A stream's
offset is the time and path of the last file it took, so each batch is the files after it, dealt out the same way. Files must come with a later time than those taken.
Paths are those that pyarrow opens: local ones, HDFS, and the object stores it knows; qualified() of the session gives their full form.
"""

from __future__ import annotations

import fnmatch
import io
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from spanloom.sources.standoff import LINE
from spanloom.sources.tables import sheet_rows

PARTITION_BYTES = 32 << 20


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + re.sub(r"^file:/*", "/", path))


def listed(path: str, pattern: str) -> list[tuple[int, str, int]]:
    """(time in nanoseconds, path, bytes) of the files of a folder that match a pattern, or of one file, in that order."""
    store, root = _located(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


class Files(InputPartition):
    """Some files that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def packed(files: list[tuple[int, str, int]], limit: int) -> list[Files]:
    """Partitions of files of about limit bytes together, in order of their paths."""
    out, held, size = [], [], 0
    for _, path, n in sorted(files, key=lambda f: f[1]):
        if held and size + n > limit:
            out.append(Files(held))
            held, size = [], 0
        held, size = [*held, path], size + n
    return [*out, Files(held)] if held else out


class _Reader(DataSourceReader):
    pattern = "*"

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        return packed(listed(self.path, self.pattern), self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _located(self.path)
        for path in partition.paths:
            yield from self.rows(store, path)

    def rows(self, store: fs.FileSystem, path: str) -> Iterator[tuple]:
        raise NotImplementedError


def annotation_rows(store: fs.FileSystem, path: str) -> Iterator[tuple]:
    """The text-bound lines of one file, as annotations() of the standoff module gives them."""
    name = path.rsplit("/", 1)[-1]
    doc = re.search(r"text(\d+)\.ann$", name)
    prefix = re.match(r"(.*?)text\d+\.ann$", name)
    with store.open_input_stream(path) as stream, io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None) as lines:
        for line in lines:
            if found := re.match(LINE, line.rstrip("\n"), re.ASCII):
                ann_id, label, spans, surface = found.groups()
                fragments = [tuple(map(int, s.split(" "))) for s in spans.split(";")]
                yield doc[1] if doc else "", prefix[1] if prefix else "", ann_id, label, fragments, surface


class StandoffReader(_Reader):
    pattern = "*.ann"

    def rows(self, store: fs.FileSystem, path: str) -> Iterator[tuple]:
        return annotation_rows(store, path)


class StandoffStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path, StandoffReader.pattern)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return packed([f for f in listed(self.path, StandoffReader.pattern) if after < f[:2] <= upto], self.limit)

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _located(self.path)
        for path in partition.paths:
            yield from annotation_rows(store, path)

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done."""


class StandoffSource(DataSource):
    """spark.read.format('standoff').load(folder), and readStream: the text-bound lines of its *.ann files."""

    @classmethod
    def name(cls) -> str:
        return "standoff"

    def schema(self) -> str:
        return "doc_id string, prefix string, ann_id string, label string, fragments array<struct<start:int,end:int>>, surface string"

    def reader(self, schema) -> StandoffReader:
        return StandoffReader(self.options)

    def streamReader(self, schema) -> StandoffStream:
        return StandoffStream(self.options)


class MappingReader(_Reader):
    pattern = "*.xlsx"

    def rows(self, store: fs.FileSystem, path: str) -> Iterator[tuple]:
        with store.open_input_file(path) as book:  # a workbook is parsed whole: a zip's list of contents stands at its end
            for i, cells in enumerate(sheet_rows(book.read())):
                if i and len(cells) >= 2 and cells[0].strip():
                    yield path.rsplit("/", 1)[-1], i, cells[0].strip(), cells[1].strip()


class MappingSource(DataSource):
    """spark.read.format('mapping-workbook').load(file or folder): the first two columns of the first sheet of each workbook, without its head and rows with an empty first cell."""

    @classmethod
    def name(cls) -> str:
        return "mapping-workbook"

    def schema(self) -> str:
        return "file string, row_no int, source_type string, target_label string"

    def reader(self, schema) -> MappingReader:
        return MappingReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (StandoffSource, MappingSource):
        spark.dataSource.register(source)
