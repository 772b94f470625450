"""Readers and writers on small files of our own."""

import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.operators import integrity, matching, release, structure
from spanloom.plans import files
from spanloom.session import qualified, shared_folder
from spanloom.sources import formats, jsonl, standoff, tables
from spanloom.streaming import validators


def test_jsonl_readers(spark, tmp_path):
    good, blank = tmp_path / "good.jsonl", tmp_path / "blank.jsonl"
    good.write_text('{"id": "1_0"}\n{"id": "1_1"}\n')
    blank.write_text('{"id": "1_0"}\n\n{"id": "2_1"}')
    assert [(r.record_no, r.id) for r in jsonl.strict_jsonl(spark, str(good), "id string").orderBy("record_no").collect()] == [(0, "1_0"), (1, "1_1")]
    with pytest.raises(Exception, match="not JSON"):
        jsonl.strict_jsonl(spark, str(blank), "id string").collect()
    assert jsonl.lenient_jsonl(spark, str(blank), "id string").count() == 2
    assert jsonl.json_dataset(spark, str(good)).columns == ["id"]


def test_json_records_below_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('\n{"id": "1_0"}\n')
    (tmp_path / "in/trainData.json").write_text('{"id": "2_0"}\n')
    (tmp_path / "in/other.json").write_text('{"id": "3_0"}\n')
    found = jsonl.json_records(spark, str(tmp_path), "id string").select("line_num", "record.id").collect()
    assert {(r.line_num, r.id) for r in found} == {(2, "1_0"), (1, "2_0")}


def test_split_ids(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": "5_0"}{"id": "5_1"}\nbroken\n{"id": "6_0"}\n')
    assert {r.doc_id for r in jsonl.split_ids(spark, str(tmp_path / "s.json")).collect()} == {"5", "6"}
    assert jsonl.split_ids(spark, str(tmp_path / "none.json")).count() == 0


def test_split_ids_are_those_that_a_strict_parser_reads(spark, tmp_path):
    lines = [
        '{"id": "1_0"} trailing', '{"id": 2}', '{"id": "3_0"', '{"id": null}', '"id"', '[{"id": "4_0"}]', ' \t{"id": "5_0"} ', '{"id": "x", "id": "6_1"}', '{"id": "7_0", "v": NaN}', "{'id': '8'}", '{"id": "9\\u0041_0"}', '{"id": "10_0",}',
        '{"id": "11_0"}{"id": "12_0"}', '{"id": "13_0"} {"id": "14_0"}', '{"id": "15"}, "end"', '{"id": "16"}, "end"] x', '{"id": "17"}] []', '{"a": {"id": "18"}}', '{"id": ""}', '{"id": "_19"}', '{"id": true}', '{"id": "20", "v": -Infinity}', '{"id": "21", "v": 01}', "", "  ", "{}", '{"id": ["22_0"]}', '{"id": "23_1_2"}',
    ]
    expected = set()
    for line in "\n".join(lines).replace("}{", "}\n{").split("\n"):
        try:
            expected.add(json.loads(line)["id"].split("_")[0])
        except (ValueError, KeyError, TypeError, AttributeError):
            pass
    (tmp_path / "s.json").write_text("\n".join(lines))
    assert {r.doc_id for r in jsonl.split_ids(spark, str(tmp_path / "s.json")).collect()} == expected == {"5", "6", "7", "9A", "11", "12", "", "20", "23"}


def test_record_numbers_over_files_of_several_splits(spark, tmp_path):
    """Numbers run on from file to file, each once; two such folders are paired by them."""
    sides = {"gold": [700, 0, 1, 900], "pred": [1200, 350]}
    for name, sizes in sides.items():
        (tmp_path / name).mkdir()
        at = 0
        for i, n in enumerate(sizes):
            (tmp_path / name / f"part-{i}.jsonl").write_text("".join(json.dumps({"id": f"{at + k}", "pad": "x" * ((at + k) % 53)}) + "\n" for k in range(n)))
            at += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        gold, pred = (jsonl.strict_jsonl(spark, str(tmp_path / name), "id string, pad string") for name in sides)
        assert sorted((r.record_no, r.id) for r in gold.collect()) == [(i, str(i)) for i in range(1601)]
        both = matching.aligned_records(gold, pred).select("record_no", "gold.id", F.col("pred.id").alias("other")).collect()
        assert sorted(map(tuple, both)) == [(i, str(i), str(i)) for i in range(1550)]
        assert [r.record_no for r in matching.unaligned_records(gold, pred).orderBy("record_no").collect()] == list(range(1550, 1601))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_labels(spark, tmp_path):
    (tmp_path / "labels.txt").write_text(" B \n\nA\n")
    assert [(r.label_id, r.label) for r in jsonl.label_list(spark, str(tmp_path / "labels.txt")).orderBy("label_id").collect()] == [(0, "B"), (1, "A")]
    assert jsonl.label_set(spark, str(tmp_path / "labels.txt")).count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("doc_id\tdoi\n1\t\n2\t10.1/x\n")
    assert [r.doi for r in tables.read_tsv(spark, str(tmp_path / "a.tsv")).orderBy("doc_id").collect()] == ["", "10.1/x"]
    (tmp_path / "c.csv").write_bytes(b"name,n\nCaf\xe9,1\n")
    assert tables.read_csv(spark, str(tmp_path / "c.csv")).first()["name"] == "Caf�"


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "m.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>type</t></si><si><t>Body</t></si><si><r><t>Or</t></r><r><t>gan</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c><v>x</v></c></row><row><c t="s"><v>1</v></c><c t="s"><v>2</v></c></row><row><c r="B3"><v>0.0</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in tables.read_mapping(spark, str(tmp_path / "m.xlsx")).collect()] == [(1, "Body", "Organ")]
    tables.write_bytes(spark, str(tmp_path / "n.xlsx"), files.workbook([("type", "label"), ("A <b>", "x"), ("", "y"), ("A <b>", "z")]))
    assert [tuple(r) for r in tables.read_mapping(spark, str(tmp_path / "n.xlsx")).collect()] == [(1, "A <b>", "x"), (3, "A <b>", "z")]
    tied = spark.createDataFrame([(1, "b", "Z"), (2, "a", "A"), (3, "c", "A"), (4, "d", "Z"), (5, "e", "M")], "row_no int, source_type string, target_label string")
    assert [r.target_label for r in integrity.top_targets(tied, "row_no").collect()] == ["Z", "A", "M"]  # of equal counts the first to appear


def test_line_numbers_over_splits(spark, tmp_path):
    """Files of several splits, with blank lines, and lines that cross the ends of splits."""
    (tmp_path / "in").mkdir()
    texts = {"a.txt": "\n".join("x" * (i % 97) for i in range(3000)), "b.txt": "\n\n1\n", "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for splits in (jsonl.BROADCAST_SPLITS, 0):
            jsonl.BROADCAST_SPLITS, kept = splits, jsonl.BROADCAST_SPLITS
            found = sorted((r.path.rsplit("/", 1)[1], r.line_num, r.line) for r in jsonl.numbered_lines(spark, str(tmp_path / "in")).collect())
            jsonl.BROADCAST_SPLITS = kept
            assert found == sorted((name, i + 1, line) for name, text in texts.items() for i, line in enumerate(text.split("\n")[: -1 if text.endswith("\n") or not text else None]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_arrays_and_run_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "é" if i else None, "train" if i % 3 else "test") for i in range(7)], "id int, text string, split string")
    tables.write_split_arrays(df, "id", str(tmp_path / "arrays"))
    read = lambda name: json.loads((tmp_path / f"arrays/{name}.json").read_text())
    assert [r["id"] for r in read("train")] == [1, 2, 4, 5] and read("test")[0] == {"id": 0, "text": None} and read("eval") == []
    assert read("summary") == {"train": 4, "eval": 0, "test": 3}
    tables.write_metrics(spark.createDataFrame([(0.5, 2)], "f1 double, n int"), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"f1": 0.5, "n": 2}


def test_files_in_order_from_many_tasks(spark, tmp_path):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") % 3).cast("string").alias("file"), (F.col("id") * 7919 % 5003).alias("at")).withColumn("value", F.concat(F.lit("é"), "at"))
    tables.write_in_order(df, str(tmp_path / "out"), ["at"], {"0": ("<", ">"), "2": ("", ""), "none": ("a", "b")})
    read = lambda name: (tmp_path / "out" / name).read_text().splitlines()
    rows = lambda k: ["é" + str(x) for x in sorted(i * 7919 % 5003 for i in range(k, 5000, 3))]
    assert read("0") == ["<", *rows(0), ">"] and read("2") == rows(2) and read("none") == ["a", "b"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["0", "2", "none"]
    plan = df.repartitionByRange("file", "at")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    broken = F.when(F.col("id") == 4321, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("id").cast("string"))
    df = spark.range(0, 5000, 1, 8).select(F.lit("a").alias("file"), F.col("id").alias("at"), broken.alias("value"))
    with pytest.raises(Exception, match="killed"):
        tables.write_in_order(df, str(tmp_path / "out"), ["at"], {"a": ("[", "]")})
    assert list(tmp_path.glob("out/*")) == list(tmp_path.glob("out/.parts*")) == []
    with pytest.raises(Exception, match="killed"):
        tables.write_split_arrays(df.select("at", "value", F.lit("train").alias("split")), "at", str(tmp_path / "arrays"))
    assert list(tmp_path.glob("arrays/*")) == list(tmp_path.glob("arrays/.parts*")) == []


def test_digests_of_files_against_a_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(standoff, "BLOCK", 1000)
    (tmp_path / "in/deep").mkdir(parents=True)
    contents = {"a.bin": bytes(range(256)) * 50, "deep/b b.bin": b"", "c.bin": b"x"}
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = standoff.file_digests(spark, str(tmp_path / "in"))
    relative = found.select(F.element_at(F.split("path", "/in/"), 2).alias("path"), "length", "sha256")
    assert {(r.path, r.length, r.sha256) for r in relative.collect()} == {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    (tmp_path / "sums").write_text("\n".join([f"{hashlib.sha256(contents['a.bin']).hexdigest().upper()} *a.bin", f"{'0' * 64}  deep/b b.bin", f"{'1' * 64}  gone", ""]))
    manifest = tables.read_manifest(spark, str(tmp_path / "sums"))
    assert {tuple(r) for r in integrity.checksum_errors(relative, manifest).collect()} == {("deep/b b.bin", "mismatch"), ("gone", "missing"), ("c.bin", "not listed")}
    (tmp_path / "bad").write_text("no digest\n")
    with pytest.raises(Exception, match="no line of a manifest"):
        tables.read_manifest(spark, str(tmp_path / "bad")).collect()


def test_formats(spark, tmp_path):
    """Annotation files and workbooks through formats of their own, over several partitions, and files that arrive one after another."""
    formats.register(spark)
    files_in = tmp_path / "in"
    files_in.mkdir()
    for i in range(6):
        (files_in / f"0text{i}.ann").write_bytes(f"T1\tGene {i} 5\tab\r\nT4\tCell 116 138;93 98\tx y\r\n\r\nR1\tother".encode())
    (files_in / "0text7.txt").write_text("T1\tGene 1 5\tab")
    read = lambda: spark.read.format("standoff").option("partitionBytes", 100).load(qualified(spark, str(files_in)))
    assert read().rdd.getNumPartitions() > 1
    assert sorted(map(str, read().collect())) == sorted(map(str, standoff.annotations(spark, str(files_in)).collect()))
    assert spark.read.format("standoff").load(str(tmp_path / "nowhere")).count() == 0
    run = lambda: validators.run_to_end(spark.readStream.format("standoff").option("partitionBytes", 100).load(str(files_in)).select("doc_id", "ann_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    out = lambda: sorted(tuple(r) for r in spark.read.schema("doc_id string, ann_id string").parquet(str(tmp_path / "out")).collect())
    assert out() == [(str(i), a) for i in range(6) for a in ("T1", "T4")]
    (files_in / "5text8.ann").write_text("T9\tGene 1 5\tab")
    run()
    assert out() == sorted([(str(i), a) for i in range(6) for a in ("T1", "T4")] + [("8", "T9")])
    for i in range(3):
        tables.write_bytes(spark, str(tmp_path / f"books/{i}.xlsx"), files.workbook([("type", "label"), (f"A{i}", "x"), ("", "y")]))
    books = spark.read.format("mapping-workbook").option("partitionBytes", 1).load(str(tmp_path / "books"))
    assert books.rdd.getNumPartitions() == 3 and sorted(map(tuple, books.collect())) == [(f"{i}.xlsx", 1, f"A{i}", "x") for i in range(3)]


def test_mentions_of_documents_in_their_sentences(spark, monkeypatch):
    """Both directions, over the edges of sentences and buckets, empty mentions and empty sentences."""
    monkeypatch.setattr(structure, "BUCKET", 8)
    rng = random.Random(4)
    sentences, mentions, expected = [], [], []
    for doc in range(30):
        at, own = 0, []
        for i in range(rng.randint(1, 8)):
            n = rng.choice([0, 1, 5, 30])
            own.append((doc, i, at, at + n))
            at += n + 1
        sentences += own
        for k in range(20):
            a = rng.randint(0, at)
            b = min(at, a + rng.choice([0, 1, 4, 40]))
            mentions.append((doc, a, b, k))
            expected += [(doc, a, b, k, i, max(a, s) - s, min(b, e) - s, s <= a and b <= e) for _, i, s, e in own if (s <= a <= e if a == b else a < e and s < b)]
    m = spark.createDataFrame(mentions, "doc_id int, start int, end int, k int")
    s = spark.createDataFrame(sentences, "doc_id int, sent_idx int, document_start int, document_end int")
    found = structure.to_sentence_offsets(m, s, ["doc_id"])
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    back = structure.to_document_offsets(found.filter("whole").select("doc_id", "sent_idx", "k", F.col("sentence_from").alias("start"), F.col("sentence_to").alias("end")), s, ["doc_id", "sent_idx"])
    assert {(r.doc_id, r.k, r.document_from, r.document_to) for r in back.collect()} == {(d, k, a, b) for d, a, b, k, _, _, _, whole in expected if whole}


def test_one_shared_folder_for_an_application(spark):
    from types import SimpleNamespace as Plain

    local = Plain(conf=Plain(get=lambda key, default: default), sparkContext=Plain(master="local[2]", applicationId="some-application"))
    assert shared_folder(local) == shared_folder(local)
    local.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(local)


def test_logger_and_seeds(spark, tmp_path):
    from spanloom import session

    for _ in range(2):
        log = session.logger("spanloom-test", str(tmp_path / "log.txt"))
    log.info("once")
    assert len(log.handlers) == 2 and (tmp_path / "log.txt").read_text().count("once") == 1
    drawn = lambda n, seed: {r[0]: r[1] for r in spark.range(0, 50, 1, n).select("id", session.seeded("id", seed)).collect()}
    assert drawn(1, 3) == drawn(5, 3) != drawn(5, 4) and all(0 <= x < 1 for x in drawn(2, 1).values())


def test_standoff(spark, tmp_path):
    (tmp_path / "0text7.ann").write_bytes(b"T1\tGene 3 5\tab\r\nT4\tCell 116 138;93 98\tx y\r\n\r\nR1\tother")
    (tmp_path / "0text7.txt").write_text("hello")
    rows = standoff.annotations(spark, str(tmp_path)).orderBy("ann_id").collect()
    assert [(r.doc_id, r.prefix, r.label, [tuple(f) for f in r.fragments], r.surface) for r in rows] == [("7", "0", "Gene", [(3, 5)], "ab"), ("7", "0", "Cell", [(116, 138), (93, 98)], "x y")]
    assert standoff.unparsed_lines(spark, str(tmp_path)).count() == 1
    texts, anns = standoff.files(spark, str(tmp_path)), standoff.files(spark, str(tmp_path), "*.ann")
    assert standoff.siblings(texts, anns).first()["ann_path"].endswith("0text7.ann")
    assert standoff.detect_layout(spark, str(tmp_path), {"no": ["x"], "yes": ["0text7.ann"]}) == "yes"
    with pytest.raises(FileNotFoundError):
        standoff.detect_layout(spark, str(tmp_path), {"no": ["x"]})
    assert integrity.checksum_errors(standoff.file_digests(spark, str(tmp_path)), standoff.file_digests(spark, str(tmp_path))).count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1, "b": 2}')
    assert standoff.settings(spark, str(tmp_path / "c.json"), {"b": 3, "c": None}, {"c": 9}) == {"a": 1, "b": 3, "c": 9}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "text string, gone string")
    tables.write_jsonl(df, str(tmp_path / "j"))
    line = "".join(part.read_text() for part in (tmp_path / "j").glob("part-*"))  # some parts are empty
    assert json.loads(line) == {"text": "é", "gone": None} and "é" in line
    tables.write_by_split(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert (tmp_path / "s/split=train").exists()
    tables.write_sweep(df.select("text"), str(tmp_path / "w"))
    tables.write_label_metrics(spark.createDataFrame([(0.5, "A")], "f1 double, label string"), str(tmp_path / "m"))
    assert "".join(part.read_text() for part in (tmp_path / "m").glob("part-*")).startswith("label,f1")
    row = spark.createDataFrame([tuple("x" * 1 for _ in release.COLUMNS)], ", ".join(f"{c} string" for c in release.COLUMNS))
    tables.write_reconstruction_sources(row.withColumn("doi", F.lit("")), str(tmp_path / "r"))
    assert tables.read_tsv(spark, str(tmp_path / "r")).first()["doi"] == ""
    lines, n = tables.error_report(spark.range(5).selectExpr("'f' as path", "cast(id as string) as error"), 3)
    assert n == 5 and len(lines) == 4 and lines[-1] == "... 2 additional errors"


RECORDS = [
    {"id": "1_0", "text": "abc", "text_sha256": "", "text_length": 3, "entities": [{"start": 3, "end": 3, "label": "A", "text": ""}, {"start": 2, "end": 9, "label": "A"}], "meta": {"doc_id": "1", "source_text_decision": "exclude_text"}},
    {"id": "2_0", "text": None, "entities": [], "meta": {}},
    {"id": "3_0", "text": "ab cd", "text_sha256": "00", "text_length": 4, "entities": [{"start": 0, "end": 5, "label": "A", "text": "cd ab", "spans": [[3, 5], [0, 2]]}], "meta": {}},
    {"id": "4_0", "text": "xy", "tags": [{"start": 1, "end": 0, "tag": "B"}], "meta": {"doc_id": ""}},
]


def test_checks_in_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.json").write_text("\n".join(map(json.dumps, RECORDS)))
    batch = spark.read.schema(integrity.RECORD).json(str(tmp_path / "in"))
    expected = {("1_0", "invalid entity offsets"), ("2_0", "text is not reconstructed"), ("3_0", "text_sha256 mismatch"), ("3_0", "text_length mismatch"), ("4_0", "invalid entity offsets")}
    assert {tuple(r) for r in integrity.record_errors(batch, ["id"]).collect()} == expected
    validators.run_to_end(validators.stream_record_errors(validators.record_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected
    excluded = spark.createDataFrame([("1",), ("2",), ("4",)], "doc_id string")
    leaks = {(r.id, r.error) for r in integrity.leak_errors(batch, excluded, ["id"]).collect()}
    assert leaks == {("1_0", "contains sentence text"), ("1_0", "contains entity text"), ("2_0", "missing excluded status"), ("4_0", "missing excluded status"), ("4_0", "contains sentence text")}
    validators.run_to_end(validators.stream_leak_errors(validators.record_stream(spark, str(tmp_path / "in")), excluded), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == len(leaks)
