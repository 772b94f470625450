"""Standoff annotation files: discovery, parsing, layouts, run settings."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import doc_id_from_name
from spanloom.session import qualified

#: A text-bound line: id, label, fragments, surface.
LINE = r"^(T\d+)\t(\S+) (\d+ \d+(?:;\d+ \d+)*)\t(.*)$"


def files(spark: SparkSession, path: str, pattern: str = "*text*.txt", recursive: bool = False) -> DataFrame:
    """path, name and doc_id of the files of a folder that match a pattern."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select("path", name.alias("name"), doc_id_from_name(F.col("path")).alias("doc_id"))


#: Bytes of a file that are held at once for its digest.
BLOCK = 1 << 20


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and sha256 of the files below a folder, empty ones too; names that begin with a dot or an underscore are left out, as Spark's readers do.

    One task lists the folder (names and lengths alone), and the files are dealt out; each is read as a stream, a block at a time, so a file may be larger than the memory of
    its task. A digest needs the bytes in order, so a file is one task's work. Streams are those of pyarrow: local and HDFS paths, and the object stores it knows.
    """
    root_uri = qualified(spark, path)
    scheme = re.sub(r"^file://$", "file:", re.match(r"[a-z0-9+.-]+://[^/]*", root_uri)[0])  # as Spark writes paths

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                store, root = fs.FileSystem.from_uri(root_uri)
                found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatch(f.base_name, pattern)]
                yield pa.RecordBatch.from_arrays([pa.array([scheme + f.path for f in found], pa.string()), pa.array([f.size for f in found], pa.int64())], names=["path", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root_uri)
        for batch in batches:
            digests = []
            for own in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with store.open_input_stream(own.removeprefix(scheme)) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "length", "sha256"])

    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "path string, length long")
    return names.repartition(F.col("path")).mapInArrow(run, "path string, length long, sha256 string")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, prefix, ann_id, label, fragments (in the order of the file), surface of the text-bound lines of *.ann files."""
    lines = spark.read.option("pathGlobFilter", "*.ann").text(path).select(F.col("_metadata.file_name").alias("name"), "value")
    part = lambda i: F.regexp_extract("value", LINE, i)
    pairs = F.transform(F.split(part(3), ";"), lambda s: F.struct(F.element_at(F.split(s, " "), 1).cast("int").alias("start"), F.element_at(F.split(s, " "), 2).cast("int").alias("end")))
    rows = lines.filter(F.rlike("value", F.lit(LINE)))
    return rows.select(
        F.regexp_extract("name", r"text(\d+)\.ann$", 1).alias("doc_id"), F.regexp_extract("name", r"^(.*?)text\d+\.ann$", 1).alias("prefix"), part(1).alias("ann_id"), part(2).alias("label"), pairs.alias("fragments"), part(4).alias("surface")
    )


def unparsed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of *.ann files that are neither blank nor text-bound."""
    lines = spark.read.option("pathGlobFilter", "*.ann").text(path).select(F.col("_metadata.file_name").alias("name"), "value")
    return lines.filter((F.trim("value") != "") & ~F.rlike("value", F.lit(LINE)))


def siblings(texts: DataFrame, annotation_files: DataFrame) -> DataFrame:
    """Text files with their annotation file of the same stem, if any; a stem is the path without its ending."""
    stem = lambda c: F.regexp_replace(c, r"\.(txt|ann)$", "")
    right = annotation_files.select(stem("path").alias("stem"), F.col("path").alias("ann_path"))
    return texts.withColumn("stem", stem("path")).join(right, "stem", "left")


def detect_layout(spark: SparkSession, root: str, layouts: Mapping[str, Sequence[str]]) -> str:
    """Name of the first layout all of whose paths exist below root."""
    for name, paths in layouts.items():
        found = True
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
            found = found and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if found:
            return name
    raise FileNotFoundError(f"no known layout below {root}")


def settings(spark: SparkSession, path: str | None, given: Mapping[str, Any], defaults: Mapping[str, Any]) -> dict[str, Any]:
    """Defaults, under the JSON object of a file, under the given values that are not None."""
    read = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) if path else {}
    return {**defaults, **read, **{k: v for k, v in given.items() if v is not None}}
