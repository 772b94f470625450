"""Readers and writers of tab- and comma-separated tables, of spreadsheets, and of small reports."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.release import COLUMNS
from spanloom.session import kept, qualified


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; an empty field is an empty string."""
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')
    return df.na.fill("")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; bytes that are not UTF-8 become replacement characters."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True).na.fill("")


def write_reconstruction_sources(df: DataFrame, path: str) -> None:
    df.select(*COLUMNS).write.csv(path, sep="\t", header=True, lineSep="\n", emptyValue="", quote='"', escape='"')


def write_label_metrics(df: DataFrame, path: str) -> None:
    """Scores of labels, the label first."""
    df.select("label", *[c for c in df.columns if c != "label"]).write.csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Records with their nulls; characters outside ASCII stay as they are."""
    df.write.option("ignoreNullFields", False).json(path)


def write_sweep(df: DataFrame, path: str) -> None:
    """A sweep as CSV and as JSON lines, worked out once."""
    df = kept(df, "sweep")
    df.write.csv(f"{path}/csv", header=True)
    df.write.option("ignoreNullFields", False).json(f"{path}/json")


def write_by_split(df: DataFrame, path: str) -> None:
    """A folder of Parquet for each split."""
    df.write.partitionBy("split").parquet(path)


def error_report(errors: DataFrame, shown: int = 200) -> tuple[list[str], int]:
    """The first lines of a report (shown at most, then a line on the rest) and how many errors there are. Errors are worked out once, and their lines written and read for both."""
    made = kept(errors.select(F.concat_ws(": ", *[F.col(c).cast("string") for c in errors.columns]).alias("line")), "errors")
    total = made.count()
    lines = [r[0] for r in made.orderBy("line").limit(shown).collect()]
    return lines + ([f"... {total - shown} additional errors"] if total > shown else []), total


# --- spreadsheets -------------------------------------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """The cells of each row of the first sheet in their order of appearance; an omitted cell leaves no gap."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for row in ElementTree.fromstring(book.read(sheets[0])).iter(f"{_MAIN}row"):
            cells = []
            for cell in row.iter(f"{_MAIN}c"):
                value = cell.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if value is None else value.text or ""
                cells.append(shared[int(text)] if cell.get("t") == "s" and text else text)
            yield cells


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """row_no, source_type, target_label: the first two columns of a workbook's first sheet, without its head and rows with an empty first cell.

    The file comes through Spark's own reader, so it may lie in any store. A workbook is one small file and is parsed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [(i, c[0].strip(), c[1].strip()) for i, c in enumerate(sheet_rows(content.as_py())) if i and len(c) >= 2 and c[0].strip()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row_no", "source_type", "target_label"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_no int, source_type string, target_label string")


# --- single files ----------------------------------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def write_in_order(lines: DataFrame, folder: str, order: list[str], ends: Mapping[str, tuple[str, str]]) -> None:
    """For each name of ends one text file in folder: its lines (columns file and value) in order, between a first and a last line ('' for none). Other files are left out.

    Tasks write ranges of the order as parts, in one job for all files, through Spark's own committer: a task that fails leaves no part, and a job that fails no
    file. Then the parts of a file are joined, as streams through a fixed buffer (a file in one piece has one writer), and it gets its name last, when it is whole.
    """
    spark, names = lines.sparkSession, list(ends)
    number = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)]), F.col("file"))
    parts = f"{folder}/.parts-{uuid.uuid4().hex}"
    store, whole = _path(spark, parts)
    try:
        own = lines.withColumn("file", number).filter("file is not null").repartitionByRange("file", *order).sortWithinPartitions("file", *order)
        own.select("file", "value").write.partitionBy("file").text(parts)
        for i, name in enumerate(names):
            _join_parts(spark, f"{parts}/file={i}", f"{parts}/whole-{i}", f"{folder}/{name}", ends[name])
    finally:
        store.delete(whole, True)


def _join_parts(spark: SparkSession, folder: str, staging: str, path: str, ends: tuple[str, str]) -> None:
    store, target = _path(spark, path)
    unnamed, own = _path(spark, staging)[1], _path(spark, folder)[1]
    parts = sorted((s.getPath() for s in store.listStatus(own)), key=lambda p: p.getName()) if store.exists(own) else []
    out = store.create(unnamed, True)
    try:
        for piece in (ends[0], *parts, ends[1]):
            if not isinstance(piece, str):
                part = store.open(piece)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
            elif piece:
                out.write(bytearray((piece + "\n").encode()))
    finally:
        out.close()
    store.mkdirs(target.getParent())
    store.delete(target, False)
    store.rename(unnamed, target)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    store, target = _path(spark, path)
    out = store.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_files(files: DataFrame, folder: str) -> int:
    """Writes files (path below folder, content string), each by the task that holds it, and returns how many. A file gets its name when it is whole; a task that runs again writes the same again."""
    root_uri = qualified(files.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(root_uri)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{root}/{path}"
                parent, name = target.rsplit("/", 1)
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                unnamed = f"{parent}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(unnamed) as out:
                    out.write((content or "").encode())
                store.move(unnamed, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_split_arrays(records: DataFrame, order: str, path: str, splits: tuple[str, ...] = ("train", "eval", "test")) -> None:
    """One JSON array for each split, <split>.json, in the order of a column of distinct values, and summary.json with the number of records of each. All arrays come from one job."""
    rest = [c for c in records.columns if c != "split"]
    found = {r["split"]: r for r in records.groupBy("split").agg(F.count("*").alias("n"), F.max(order).alias("last")).collect()}  # a row for each split
    is_last = reduce(Column.__or__, [(F.col("split") == s) & (F.col(order) == found[s]["last"]) for s in splits if s in found], F.lit(False))
    line = F.concat(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), F.when(is_last, "").otherwise(","))
    lines = records.select(F.concat("split", F.lit(".json")).alias("file"), F.col(order).alias("at"), line.alias("value"))
    write_in_order(lines, path, ["at"], {f"{s}.json": ("[", "]") for s in splits})
    write_bytes(records.sparkSession, f"{path}/summary.json", json.dumps({s: found[s]["n"] if s in found else 0 for s in splits}).encode())


def write_manifest(digests: DataFrame, path: str) -> None:
    """Digests (path, sha256) as lines of the digest, two blanks and the path."""
    digests.select(F.concat("sha256", F.lit("  "), "path").alias("value")).write.text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of the lines of a manifest; a path may be marked as binary by an asterisk. Other lines are an error."""
    pattern = r"^([0-9a-fA-F]{64}) [ *](.+)$"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    checked = F.when(F.rlike("value", F.lit(pattern)), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no line of a manifest: "), "value")).cast("string"))
    return lines.select(checked.alias("value")).select(F.regexp_extract("value", pattern, 2).alias("path"), F.lower(F.regexp_extract("value", pattern, 1)).alias("sha256"))


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """The settings of a run as one JSON object."""
    write_bytes(spark, path, json.dumps(settings, ensure_ascii=False, indent=2).encode())


def write_label_balance(weights: DataFrame, path: str) -> None:
    """tag, positives and weight of each label (rows of positive_weights(): an inventory) as one JSON object by tag."""
    rows = {r["tag"]: {"positives": r["positives"], "weight": r["weight"]} for r in weights.orderBy("label_id").collect()}
    write_settings(weights.sparkSession, rows, path)


def write_metrics(row: DataFrame, path: str) -> None:
    """A table of one row as one JSON object."""
    write_settings(row.sparkSession, row.first().asDict(recursive=True), path)
