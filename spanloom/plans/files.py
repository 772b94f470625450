"""Queries of the readers and writers: each writes files made from the tables to the shared folder, and reads them back."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import integrity, matching, tokens
from spanloom.plans import fixtures as fx
from spanloom.plans import queries as q
from spanloom.session import qualified, shared_folder, table
from spanloom.sources import formats, jsonl, standoff, tables
from spanloom.streaming import validators

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and text of whole documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


def _lines(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.to_json(F.struct("item_id", "text")).alias("value"))


#: Bytes of rows in a file, about.
FILE = 64 << 20


def _several(rows: DataFrame, by: str, files: int) -> DataFrame:
    """rows in as many partitions, in order, so that a writer makes as many files in order of their names; in more where rows take over FILE bytes a file, so that no task has a fixed share of all rows."""
    size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(0)).cast("long"))).first()[0] or 0
    return rows.repartitionByRange(max(files, -(-size // FILE)), by).sortWithinPartitions(by)


ITEM = "item_id long, text string"


@query
def read_strict_jsonl(spark, sf_dir):
    """Numbers of records through a folder of four files, or of more at scale."""
    path = _folder(spark, "strict")
    tables.write_jsonl(_several(_items(spark, sf_dir), "item_id", 4), path)
    return jsonl.strict_jsonl(spark, path, ITEM).select("record_no", "item_id", F.sha2("text", 256).alias("text_sha256"))


@query
def aligned_files(spark, sf_dir):
    """Two folders of records, of four and of three files (or of more at scale), paired by their numbers; the longer one's rest is cut off."""
    path = _folder(spark, "paired")
    tables.write_jsonl(_several(_items(spark, sf_dir), "item_id", 4), f"{path}/gold")
    tables.write_jsonl(_several(table(spark, sf_dir, "labels"), "doc_id", 3), f"{path}/pred")
    gold, pred = jsonl.strict_jsonl(spark, f"{path}/gold", ITEM), jsonl.strict_jsonl(spark, f"{path}/pred", "doc_id long, quality int")
    return matching.aligned_records(gold, pred).select("record_no", "gold.item_id", "pred.doc_id", "pred.quality")


@query
def read_lenient_jsonl(spark, sf_dir):
    """With a blank line after every record."""
    path = _folder(spark, "lenient")
    _lines(_items(spark, sf_dir)).select(F.explode(F.array("value", F.lit(""))).alias("value")).write.text(path)
    return jsonl.lenient_jsonl(spark, path, ITEM).select("item_id", F.sha2("text", 256).alias("text_sha256"))


@query
def read_json_dataset(spark, sf_dir):
    path = _folder(spark, "dataset")
    tables.write_jsonl(_items(spark, sf_dir), path)
    return jsonl.json_dataset(spark, path).select("item_id", F.length("text").cast("long").alias("n"))


@query
def read_json_records(spark, sf_dir):
    """Two files that count and one that does not; blank lines have numbers of their own."""
    path, lines = _folder(spark, "records"), _lines(_items(spark, sf_dir))
    blank = lambda c: F.explode(F.when(F.col("file") == "deep/items.jsonl", F.array(F.lit(""), c)).otherwise(F.array(c)))
    named = lines.withColumn("file", F.explode(F.array(*[F.lit(x) for x in ("deep/items.jsonl", "devData.json", "other.json")])))
    tables.write_in_order(named.select("file", "item_id", blank(F.col("value")).alias("value")), path, ["item_id", "value"], dict.fromkeys(("deep/items.jsonl", "devData.json", "other.json"), ("", "")))
    found = jsonl.json_records(spark, path, ITEM)
    return found.select("line_num", F.element_at(F.split("path", "/"), -1).alias("file"), "record.item_id")


@query
def read_split_ids(spark, sf_dir):
    """By the id of a document: two records on one line; one with text behind it; a number as id; half a record; an id given twice; a number that is none."""
    path = _folder(spark, "ids")
    kinds = [
        '{"id": "#_0"}{"id": "#_1"}', '{"id": "#_0"} trailing', '{"id": #}', '{"id": "#_0"', '{"id": "x_0", "id": "#_1"}', '{"id": "#_0", "score": NaN}', '{"id": "#_0"}, {"id": "#_1"}', '{"id": "#_0"}] []', ' {"id": "#"} ', '[{"id": "#_0"}]',
    ]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.replace(kind, F.lit("#"), F.col("doc_id").cast("string")).alias("value"))
    _several(docs, "doc_id", 3).select("value").write.text(path)
    return jsonl.split_ids(spark, path)


@query
def read_labels(spark, sf_dir):
    path = _folder(spark, "labels")
    lines = table(spark, sf_dir, "region").select(F.lit("labels.txt").alias("file"), (-F.col("r_regionkey")).alias("at"), F.explode(F.array(F.concat(F.lit(" "), "r_name"), F.lit(""))).alias("value"))
    tables.write_in_order(lines, path, ["at", "value"], {"labels.txt": ("", "")})
    known = jsonl.label_set(spark, f"{path}/labels.txt")
    return jsonl.label_list(spark, f"{path}/labels.txt").join(known, "label", "left_semi").select("label_id", "label")


@query
def bio_tag_inventory(spark, sf_dir):
    """The tags of a label file that holds the types of parts."""
    path = _folder(spark, "tags")
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("value")).distinct().withColumn("file", F.lit("labels.txt"))
    tables.write_in_order(types, path, ["value"], {"labels.txt": ("", "")})
    return tokens.tag_inventory(jsonl.label_list(spark, f"{path}/labels.txt"))


@query
def read_reconstruction_tsv(spark, sf_dir):
    path = _folder(spark, "tsv")
    tables.write_reconstruction_sources(q.reconstruction_sources(spark, sf_dir), path)
    return tables.read_tsv(spark, path)


@query
def read_label_metrics_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    tables.write_label_metrics(q.score_overlap_per_label(spark, sf_dir), path)
    return tables.read_csv(spark, path).select("label", F.col("correct").cast("long").alias("correct"), F.round(F.col("f1").cast("double"), 9).alias("f1"))


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(rows: list[tuple[str, ...]]) -> bytes:
    """A workbook with the rows on its first sheet, all cells as text: an input for the readers."""
    cells = ["<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in row) + "</row>" for row in rows]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(cells)}</sheetData></worksheet>')
    return out.getvalue()


@query
def read_workbook(spark, sf_dir):
    path = _folder(spark, "book") + ".xlsx"
    rows = fx.mapping(spark, sf_dir).orderBy("row_no").select("source_type", "target_label").collect()  # a mapping: one row for each type
    tables.write_bytes(spark, path, workbook([("type", "label"), *map(tuple, rows), ("", "no type")]))
    return tables.read_mapping(spark, path)


@query
def workbooks_of_a_folder(spark, sf_dir):
    """A workbook for each region, with its nations, through the format of workbooks: a partition each."""
    formats.register(spark)
    path = _folder(spark, "books")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey")
    by_region: dict[str, list] = {}
    for r in nations.orderBy("n_nationkey").collect():  # 25 nations
        by_region.setdefault(r["r_name"], []).append((r["n_name"], f"L{r['n_nationkey']}"))
    for name, rows in by_region.items():
        tables.write_bytes(spark, f"{path}/{name}.xlsx", workbook([("type", "label"), *rows]))
    return spark.read.format("mapping-workbook").option("partitionBytes", 1).load(qualified(spark, path))


def _words(spark, sf_dir) -> DataFrame:
    """item_id, i (from 1), start, end and surface of what stands between blanks."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.translate("text", "\n\t\r", "   "), " ", -1)).alias("at", "surface"))
    end = F.sum(F.length("surface") + 1).over(Window.partitionBy("item_id").orderBy("at")).cast("int") - 1
    return words.select("item_id", (F.col("at") + 1).alias("i"), (end - F.length("surface")).alias("start"), end.alias("end"), "surface").filter("surface <> ''")


def _write_texts(spark, sf_dir, folder: str, annotated) -> None:
    """0text<id>.txt of every item, and .ann of those that are annotated."""
    name = lambda end: F.concat(F.lit("0text"), "item_id", F.lit(end))
    texts = table(spark, sf_dir, "benchmark").select(name(".txt").alias("path"), F.col("text").alias("content"))
    line = F.concat(F.lit("T"), "i", F.lit("\t"), F.lit("L"), F.col("i") % fx.N_LABELS, F.lit(" "), "start", F.lit(" "), "end", F.lit("\t"), "surface")
    held = _words(spark, sf_dir).filter(annotated).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("l"))
    anns = held.select(name(".ann").alias("path"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n").alias("content"))
    tables.write_files(texts.unionByName(anns), folder)


@query
def read_standoff(spark, sf_dir):
    path = _folder(spark, "standoff")
    _write_texts(spark, sf_dir, path, F.lit(True))
    found = standoff.annotations(spark, path)
    return found.select("doc_id", "prefix", "ann_id", "label", F.col("fragments")[0]["start"].alias("start"), F.col("fragments")[0]["end"].alias("end"), "surface")


@query
def standoff_format(spark, sf_dir):
    """The same files through a format of their own, in partitions of some files each."""
    formats.register(spark)
    path = _folder(spark, "format")
    _write_texts(spark, sf_dir, path, F.lit(True))
    found = spark.read.format("standoff").option("partitionBytes", 1 << 14).load(qualified(spark, path))
    return found.select("doc_id", "prefix", "ann_id", "label", F.col("fragments")[0]["start"].alias("start"), F.col("fragments")[0]["end"].alias("end"), "surface")


@query
def stream_standoff(spark, sf_dir):
    """Annotation files as a stream; how many lines of each label a document has."""
    formats.register(spark)
    path = _folder(spark, "arriving")
    _write_texts(spark, sf_dir, f"{path}/in", F.lit(True))
    stream = spark.readStream.format("standoff").option("partitionBytes", 1 << 14).load(qualified(spark, f"{path}/in"))
    validators.run_to_end(stream.select("doc_id", "label"), f"{path}/out", f"{path}/state")
    return spark.read.schema("doc_id string, label string").parquet(f"{path}/out").groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query
def checksum_errors(spark, sf_dir):
    """Files of whole documents against a manifest of digests: some are missing, some not listed, some differ."""
    path, d = _folder(spark, "sums"), table(spark, sf_dir, "documents")
    name = F.concat(F.lit("f"), "doc_id")
    tables.write_files(d.filter(F.col("doc_id") % 13 != 0).select(F.concat(name, F.lit(".txt")).alias("path"), F.col("text").alias("content")), f"{path}/files")
    listed = d.filter(F.col("doc_id") % 11 != 0).select(F.concat(name, F.lit(".txt")).alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    tables.write_manifest(listed, f"{path}/manifest")
    files = standoff.file_digests(spark, f"{path}/files", "*.txt").select(F.element_at(F.split("path", "/"), -1).alias("path"), "sha256")
    return integrity.checksum_errors(files, tables.read_manifest(spark, f"{path}/manifest"))


@query
def discovered_files(spark, sf_dir):
    """Text files, whether an annotation stands beside them, and their digests; items of even ids are annotated."""
    path = _folder(spark, "found")
    _write_texts(spark, sf_dir, path, F.col("item_id") % 2 == 0)
    both = standoff.siblings(standoff.files(spark, path), standoff.files(spark, path, "*.ann"))
    return both.join(standoff.file_digests(spark, path), "path").select("name", "doc_id", F.col("ann_path").isNotNull().alias("has_ann"), "sha256")


@query
def files_in_split_folders(spark, sf_dir):
    """Files copied into a folder for each split, and the same as a table partitioned by split."""
    path = _folder(spark, "folders")
    items = table(spark, sf_dir, "benchmark").withColumn("split", fx.split_of("item_id"))
    tables.write_files(items.select(F.concat("split", F.lit("/0text"), "item_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")), f"{path}/files")
    tables.write_by_split(items, f"{path}/table")
    files = standoff.files(spark, f"{path}/files", recursive=True).select(F.element_at(F.split("path", "/"), -2).alias("split"), F.col("doc_id").cast("long").alias("item_id"))
    kept = spark.read.parquet(f"{path}/table").select("item_id", "split", F.length("text").alias("n"))
    return kept.join(files, ["item_id", "split"]).groupBy("split").agg(F.count("*").alias("files"), F.sum("n").alias("characters"))


@query
def read_settings(spark, sf_dir):
    """Settings by name: regions as defaults, under nations from a file, under what is given for nations of the first region; and which layout of folders is there."""
    path = _folder(spark, "run")
    regions = {r["r_name"]: r["r_regionkey"] for r in table(spark, sf_dir, "region").collect()}  # five regions, 25 nations
    nations = {r["n_name"]: r["n_regionkey"] for r in table(spark, sf_dir, "nation").collect()}
    tables.write_settings(spark, nations, f"{path}/official/run_config.json")
    layout = standoff.detect_layout(spark, path, {"legacy": ["old/run_config.json"], "official": ["official/run_config.json"]})
    given = {n: -1 if k == 0 else None for n, k in nations.items()}
    read = standoff.settings(spark, f"{path}/{layout}/run_config.json", given, {n: k + 100 for n, k in regions.items()})
    return spark.createDataFrame([(k, str(v)) for k, v in {**read, "layout": layout}.items()], "key string, value string")


@query
def read_split_arrays(spark, sf_dir):
    """One JSON array a split and their summary."""
    path = _folder(spark, "arrays")
    tables.write_split_arrays(_items(spark, sf_dir).withColumn("split", fx.split_of("item_id")), "item_id", path)
    read = lambda name: jsonl.array_records(spark, f"{path}/{name}.json", ITEM).withColumn("split", F.lit(name))
    whole = read("train").unionByName(read("eval")).unionByName(read("test"))
    summary = spark.read.json(f"{path}/summary.json").select(F.explode(F.create_map(*[x for s in ("train", "eval", "test") for x in (F.lit(s), F.col(s))])).alias("split", "in_summary"))
    return whole.groupBy("split").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"), F.min("item_id").alias("first_id")).join(summary, "split")


@query
def read_sweep_files(spark, sf_dir):
    path = _folder(spark, "sweep")
    tables.write_sweep(q.flat_sweep(spark, sf_dir), path)
    both = {"csv": spark.read.csv(f"{path}/csv", header=True), "json": spark.read.json(f"{path}/json")}
    rows = [df.select(F.lit(kind).alias("kind"), F.col("cell").cast("int").alias("cell"), F.col("correct").cast("long").alias("correct"), F.round(F.col("f1").cast("double"), 9).alias("f1")) for kind, df in both.items()]
    return rows[0].unionByName(rows[1])


@query
def read_run_files(spark, sf_dir):
    """Label balance and metrics of a run, each one JSON object."""
    path = _folder(spark, "metrics")
    tables.write_label_balance(q.positive_weights(spark, sf_dir), f"{path}/label_balance.json")
    tables.write_metrics(q.score_exact(spark, sf_dir), f"{path}/metrics.json")
    whole = lambda name, schema: spark.read.text(f"{path}/{name}.json", wholetext=True).select(F.from_json("value", schema).alias("x"))
    balance = whole("label_balance", "map<string, struct<weight: double>>").select(F.explode("x").alias("tag", "v")).select(F.concat(F.lit("balance:"), "tag").alias("what"), F.round("v.weight", 9).alias("value"))
    return balance.unionByName(whole("metrics", "micro_f1 double").select(F.lit("metrics:micro_f1").alias("what"), F.round("x.micro_f1", 9).alias("value")))


@query
def error_report(spark, sf_dir):
    lines, n = tables.error_report(integrity.record_errors(fx.records(spark, sf_dir), ["id"]))
    return spark.createDataFrame([(x,) for x in [*lines, f"total {n}"]], "line string")


@query
def stream_record_errors(spark, sf_dir):
    """The record check over files that arrive as a stream."""
    path = _folder(spark, "stream")
    tables.write_jsonl(fx.records(spark, sf_dir), f"{path}/in")
    stream = validators.stream_record_errors(validators.record_stream(spark, f"{path}/in"))
    validators.run_to_end(stream, f"{path}/out", f"{path}/state")
    return spark.read.schema("id string, error string").parquet(f"{path}/out")


@query
def stream_leak_errors(spark, sf_dir):
    """The leak check of the same stream against the table of excluded documents."""
    path = _folder(spark, "leaks")
    tables.write_jsonl(fx.records(spark, sf_dir), f"{path}/in")
    stream = validators.stream_leak_errors(validators.record_stream(spark, f"{path}/in"), fx.excluded(spark, sf_dir))
    validators.run_to_end(stream, f"{path}/out", f"{path}/state")
    return spark.read.schema("id string, error string").parquet(f"{path}/out")
