"""Readers of JSON lines, of JSON with line numbers, of split id files, and of label lists."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits whose line counts are broadcast to the lines; beyond that they are joined.
BROADCAST_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """path, line_num (from 1, in its file), record_no (from 0, through all files in order of their paths) and line of every physical line.

    Files are read split by split. Rows of a split come in order, so a line's number is that within its split, by its row id, and the lines of the
    splits before: a sum over one row a split within each file, and over one row a file across them. No line is moved.
    """
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.option("recursiveFileLookup", recursive).text(path).select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("path").agg(F.sum("n").alias("lines")).select("path", before(Window.orderBy("path"), "lines").alias("earlier"))
    based = splits.select("path", "block", "first", before(Window.partitionBy("path").orderBy("block"), "n").alias("base")).join(files, "path")
    small = splits.count() <= BROADCAST_SPLITS
    joined = rows.join(F.broadcast(based) if small else based, ["path", "block"])
    in_file = F.col("base") + F.col("at") - F.col("first")
    return joined.select("path", (in_file + 1).cast("int").alias("line_num"), (F.col("earlier") + in_file).alias("record_no"), "line")


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    bad = F.concat(F.lit("not JSON: "), "path", F.lit(":"), F.col("line_num").cast("string"))
    parsed = F.from_json("line", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("record", parsed)
    ok = F.when((F.trim("line") == "") | F.col("record").isNull() | F.col("record._corrupt").isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)
    return rows.filter(ok)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """record_no (from 0, through all files of a folder in order of their paths) and the columns of schema. Every line must hold JSON: a blank line is an error."""
    rows = _parsed(numbered_lines(spark, path), schema)
    return rows.select("record_no", "record.*").drop("_corrupt")


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines are left out."""
    return spark.read.schema(schema).json(path)


def array_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array whose records and brackets have a line each, as write_split_arrays() makes it. Files are read split by split; a line that is no such record is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter(~F.col("line").isin("", "[", "]"))
    bare = F.regexp_replace("line", ",$", "")
    parsed = F.from_json("line", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(bare.alias("line")).withColumn("record", parsed)
    bad = ~F.startswith("line", F.lit("{")) | F.col("record").isNull() | F.col("record._corrupt").isNotNull()
    ok = F.when(bad, F.raise_error(F.concat(F.lit("no record on a line of its own: "), F.substring("line", 1, 80))).cast("boolean")).otherwise(True)
    return rows.filter(ok).select("record.*").drop("_corrupt")


def json_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of JSON lines, with an inferred schema where none is given (one more pass over the input)."""
    return spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, line_num and record from a file, or from all *.jsonl and *Data.json below a folder; blank lines count but give no row."""
    lines = numbered_lines(spark, path, recursive=True)
    single = path.rstrip("/").rsplit("/", 1)[-1]
    named = F.rlike("path", F.lit(r"\.jsonl$|Data\.json$")) | F.endswith("path", F.lit("/" + single))
    return _parsed(lines.filter(named & (F.trim("line") != "")), schema).select("path", "line_num", F.col("record").dropFields("_corrupt").alias("record"))


def _loaded_id(line: str) -> str | None:
    try:
        found = json.loads(line)["id"]
    except (ValueError, KeyError, TypeError, IndexError):
        return None
    return found if isinstance(found, str) else None


def _odd_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [_loaded_id(odd) if odd is not None else found for found, odd in zip(batch.column("id").to_pylist(), batch.column("odd").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], names=["id"])


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id: the distinct document ids of records, which may stand together on a line; a missing file is empty.

    A record counts if its line is one whole JSON object with a string as id, and nothing after it; the document is what stands before the first underscore. All else is left out:
    half records, trailing text, numbers as ids, lists. Lines are parsed by Spark; those that its parser refuses, and Python's may not (repeated
    keys, of which the last counts, NaN and infinities), are looked at once more in Python, so nothing but them leaves the JVM.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "doc_id string")
    lines = spark.read.text(path).select(F.explode(F.split(F.replace("value", F.lit("}{"), F.lit("}\n{")), "\n")).alias("line")).filter(F.trim("line") != "")
    # The parser stops after a whole value. In a list whose last member is a digest of the line, which a line cannot hold, nothing can stand behind a record.
    whole = F.try_parse_json(F.concat(F.lit("["), "line", F.lit(',"'), F.md5("line"), F.lit('"]')))
    closed = F.try_variant_get(whole, "$[1]", "string").eqNullSafe(F.md5("line")) & F.try_variant_get(whole, "$[2]", "variant").isNull()
    is_text = F.schema_of_variant(F.try_variant_get(whole, "$[0].id", "variant")) == "STRING"
    parsed = lines.select("line", closed.alias("closed"), F.when(closed & is_text, F.try_variant_get(whole, "$[0].id", "string")).alias("id"))
    some = parsed.select("id", F.when(~F.col("closed"), F.col("line")).alias("odd")).filter("id is not null or odd is not null")
    ids = some.mapInArrow(_odd_ids, "id string").filter("id is not null")
    return ids.select(F.element_at(F.split("id", "_"), 1).alias("doc_id")).distinct()


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """label_id and label of each line that is not blank, in the order of the file."""
    kept = numbered_lines(spark, path).select("line_num", F.trim("line").alias("label")).filter("label <> ''")
    whole = kept.agg(F.array_sort(F.collect_list(F.struct("line_num", "label"))).alias("l"))  # an inventory: a file of a few lines
    return whole.select(F.posexplode("l").alias("label_id", "x")).select("label_id", "x.label")


def label_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("label")).filter("label <> ''").distinct()
