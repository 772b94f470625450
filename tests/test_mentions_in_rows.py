"""Work that grows no faster than its input: mentions matched beside their record, sweeps and reports worked out once, files read and written in parts."""

import os
import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import mentions as beside
from spanloom.functions import tiling
from spanloom.operators import matching, splits, structure
from spanloom.plans import files, fixtures, queries
from spanloom.sources import jsonl, tables


def plan(df):
    """The final plan."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, tmp_path, n=40):
    words = "ab c def, g hi\njk l. mno p"
    spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit(words + " "), (F.col("id") % 9).cast("int")).alias("text"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_exact_matches_shuffle_sums_only(spark, tmp_path):
    found = plan(queries.QUERIES["exact_matches"](spark, documents(spark, tmp_path)))
    assert "hashpartitioning(doc_id" not in found and "Window" not in found


def test_outcomes_are_made_without_a_shuffle(spark, tmp_path):
    assert "Exchange" not in plan(queries.QUERIES["match_outcomes"](spark, documents(spark, tmp_path)))


def test_scores_per_label_shuffle_sums_only(spark, tmp_path):
    assert "hashpartitioning(doc_id" not in plan(queries.QUERIES["score_overlap_per_label"](spark, documents(spark, tmp_path)))


def test_exact_scores_shuffle_sums_only(spark, tmp_path):
    assert "hashpartitioning(doc_id" not in plan(queries.QUERIES["score_exact"](spark, documents(spark, tmp_path)))


def test_recovery_shuffles_sums_only(spark, tmp_path):
    found = plan(queries.QUERIES["structural_recovery"](spark, documents(spark, tmp_path)))
    assert "hashpartitioning(doc_id" not in found and "Window" not in found


def test_seeds_shuffle_sums_only(spark, tmp_path):
    found = plan(queries.QUERIES["scores_over_seeds"](spark, documents(spark, tmp_path)))
    assert "doc_id" not in "".join(x for x in found.splitlines() if "Exchange" in x) and "Window" not in found


def random_mentions(rng, n):
    out = []
    for i in range(n):
        start = rng.randint(0, 6)
        out.append((start, start + rng.randint(0, 4), rng.choice(["A", "B", "é", None]), i, rng.choice("gp")))
    return out


def test_rows_and_arrays_of_mentions_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    records = [(r, random_mentions(rng, rng.randint(0, 9))) for r in range(300)]
    arrays = spark.createDataFrame(records, "rec int, mentions array<struct<start:int,end:int,label:string,ordinal:int,side:string>>")
    rows = arrays.select("rec", F.inline("mentions"))
    key = lambda rs: sorted(map(repr, map(tuple, rs)))
    assert key(matching.outcomes(rows, ["rec"]).collect()) == key(matching.outcomes_in_row(arrays, ["rec"]).collect())
    flags = structure.structure(rows, ["rec"]).collect()
    assert key(flags) == key(beside.with_structure(arrays).select("rec", F.inline("mentions")).collect())
    for r in flags:
        same = [m for m in records[r.rec][1] if m[:2] == (r.start, r.end)]
        inside = any(m[:2] != (r.start, r.end) and m[0] <= r.start and m[1] >= r.end for m in records[r.rec][1])
        assert (r.same_span, r.nested) == (len({m[2] for m in same} - {None}) > 1, inside)


def test_null_offsets_match_nothing_by_overlap(spark):
    arrays = spark.createDataFrame([(1, [(None, None, "A", 0, "g"), (0, 5, "A", 1, "p"), (None, None, "B", 2, "p"), (2, None, "A", 3, "g")])], "rec int, mentions array<struct<start:int,end:int,label:string,ordinal:int,side:string>>")
    found = {r.label: tuple(r[c] for c in matching.COUNTS) for r in matching.outcomes_in_row(arrays, ["rec"]).collect()}
    assert found == {"A": (0, 0, 1, 1, 1), "B": (0, 0, 0, 0, 0)}


def counted(df, folder):
    """df, with an empty file in folder for each time that a partition of it is worked out."""

    def run(batches):
        with open(f"{folder}/{uuid.uuid4().hex}", "w"):
            yield from batches

    return df.coalesce(1).mapInArrow(run, df.schema)


def test_report_works_errors_out_once(spark, tmp_path):
    errors = counted(spark.range(7).selectExpr("'f' as path", "cast(id as string) as error"), tmp_path)
    assert tables.error_report(errors, 2) == (["f: 0", "f: 1", "... 5 additional errors"], 7)
    assert len(os.listdir(tmp_path)) == 1


def test_sweep_files_come_from_one_run(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    tables.write_sweep(counted(spark.range(3).selectExpr("cast(id as int) as cell", "0.5D as f1"), tmp_path / "runs"), f"{tmp_path}/sweep")
    assert len(os.listdir(tmp_path / "runs")) == 1
    assert spark.read.json(f"{tmp_path}/sweep/json").count() == spark.read.csv(f"{tmp_path}/sweep/csv", header=True).count() == 3


def test_flat_sweep_shuffles_mentions_once_for_all_cells(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    found = plan(queries.QUERIES["flat_sweep"](spark, str(tmp_path)))
    assert "hashpartitioning(cell#" in found and not [x for x in found.splitlines() if "Exchange hashpartitioning(cell" in x and "doc_id" in x]


def test_best_flat_threshold_is_made_of_records(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    assert "Window" not in plan(queries.QUERIES["best_flat_threshold"](spark, str(tmp_path)))


def test_arrays_are_read_in_splits(spark, tmp_path):
    records = spark.range(400).select("id", F.concat(F.lit('é,]\n"['), F.repeat(F.lit("x"), 200)).alias("text"), F.lit("train").alias("split"))
    tables.write_split_arrays(records, "id", f"{tmp_path}/arrays")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        read = jsonl.array_records(spark, f"{tmp_path}/arrays/train.json", "id long, text string")
        assert read.rdd.getNumPartitions() > 4
        assert read.orderBy("id").collect() == records.drop("split").orderBy("id").collect()
        assert jsonl.array_records(spark, f"{tmp_path}/arrays/eval.json", "id long, text string").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "other.json").write_text('[\n{"id": 1,\n"text": "a"}\n]\n')
    with pytest.raises(Exception, match="no record on a line of its own"):
        jsonl.array_records(spark, f"{tmp_path}/other.json", "id long, text string").collect()


def test_folders_of_records_have_files_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE", 2000)
    rows = spark.range(100).select(F.col("id").alias("item_id"), F.repeat(F.lit("y"), 100).alias("text"))
    dealt = files._several(rows, "item_id", 4)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) >= 5 and max(sizes) < 40 and files._several(rows.limit(8), "item_id", 4).rdd.getNumPartitions() == 4


def test_paired_folders_of_numbers_have_files_by_size(spark, monkeypatch):
    monkeypatch.setattr(files, "FILE", 100)
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert files._several(rows, "doc_id", 3).rdd.getNumPartitions() > 3


def test_split_search_ranks_records_without_a_shuffle_of_mentions(spark, tmp_path):
    assert "Window" not in plan(queries._structured(spark, documents(spark, tmp_path)))
    assert "Exchange" not in plan(queries._structured(spark, documents(spark, tmp_path / "again")))


def test_weights_of_run_files_cut_texts_in_batches(spark, tmp_path):
    found = plan(queries.QUERIES["positive_weights"](spark, documents(spark, tmp_path)))
    assert "transform(" not in found and "doc_id" not in "".join(x for x in found.splitlines() if "Exchange" in x)


def passes(found):
    """How many times a plan hands rows to Python."""
    return sum("MapInArrow" in x for x in found.split("+- == Initial Plan ==")[0].splitlines())


def test_seeds_are_matched_in_the_pass_that_cuts_texts(spark, tmp_path):
    found = plan(queries.QUERIES["scores_over_seeds"](spark, documents(spark, tmp_path)))
    assert passes(found) == 1 and "Generate" not in found


@pytest.mark.parametrize("name", ["match_outcomes", "score_overlap_per_label", "score_exact", "exact_matches"])
def test_mentions_stay_in_the_pass_that_cuts_texts(spark, tmp_path, name):
    found = plan(queries.QUERIES[name](spark, documents(spark, tmp_path)))
    assert passes(found) == 1 and "Generate" not in found


def test_sums_of_steps_are_those_of_rows(spark):
    rng = random.Random(5)
    records = [(r, random_mentions(rng, rng.randint(0, 9))) for r in range(300)]
    arrays = spark.createDataFrame(records, "rec int, mentions array<struct<start:int,end:int,label:string,ordinal:int,side:string>>")
    (part,) = arrays.coalesce(1).toArrow().combine_chunks().to_batches()
    rows = lambda batch: sorted(map(repr, (tuple(r.values()) for r in batch.to_pylist())))
    listed = lambda df: sorted(map(repr, map(tuple, df.collect())))
    sums = [F.sum(c) for c in matching.COUNTS]
    assert rows(beside.outcome_sums_in(part)) == listed(matching.outcomes_in_row(arrays, ["rec"]).groupBy("label").agg(*sums))
    marked = beside.with_exact(arrays).select(F.inline("mentions"))
    assert rows(beside.exact_sums_in(part)) == listed(marked.groupBy("label", "side").agg(F.count_if("exact"), F.count("*")))
    found = [tuple(r.values()) for r in beside.run_sums_in(part, [lambda ordinal, n=n: ordinal % n != 0 for n in (2, 3)]).to_pylist()]
    for run, n in enumerate((2, 3)):
        own = arrays.withColumn("mentions", F.filter("mentions", lambda m: (m["side"] == "g") | (m["ordinal"] % n != 0)))
        assert found[run] == (run, *matching.outcomes_in_row(own, ["rec"]).agg(*sums).first())
    n = lambda c: F.size(F.filter("mentions", lambda m: m[c]))
    flags = beside.with_structure(arrays).select("rec", F.size("mentions"), n("same_span"), n("nested"), n("flat"), F.array_sort(F.array_distinct(F.transform("mentions", lambda m: m["label"]))))
    assert rows(beside.structure_counts_in(part, ["rec"])) == listed(flags)
    empty = part.slice(0, 0)
    assert beside.outcome_sums_in(empty).num_rows == beside.exact_sums_in(empty).num_rows == beside.structure_counts_in(empty, ["rec"]).num_rows == beside.outcomes_in(empty, ["rec"]).num_rows == 0


def test_split_search_deals_documents_out_by_their_number(spark, tmp_path, monkeypatch):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), *[F.lit(n).cast("long").alias(c) for n, c in ((3, "sentences"), (2, "nested"), (1, "same_span"))], F.array(F.lit("A")).alias("labels")).coalesce(1)
    targets = {"train": 0.7, "eval": 0.1, "test": 0.2}
    few = splits.split_search(docs, targets, 20)
    monkeypatch.setattr(splits, "RANKED", 200)
    many = splits.split_search(docs, targets, 20)
    assert "RoundRobinPartitioning(4)" in plan(few) and "RoundRobinPartitioning(10)" in plan(many)
    assert sorted(few.collect()) == sorted(many.collect())


def test_split_search_leaves_mentions_in_the_pass_that_cuts_texts(spark, tmp_path):
    found = plan(queries._structure_counts(spark, documents(spark, tmp_path)))
    assert passes(found) == 1 and "same_span:boolean" not in found and "array<struct" not in queries._structure_counts(spark, str(tmp_path)).schema.simpleString()


def test_report_makes_entities_in_the_pass_that_cuts_texts(spark, tmp_path):
    at = documents(spark, tmp_path)
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), (F.col("id") % 5 == 0).cast("int").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    made = fixtures.records(spark, at)
    assert "tokens" not in plan(made)
    texts = {f"{r.doc_id}_0": r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    for r in made.collect():
        doc_id, whole = int(r.meta.doc_id), texts[r.id]
        shift, mark, hidden = 100000 * (doc_id % 19 == 0), "?" * (doc_id % 29 == 0), doc_id % 5 == 0 and doc_id % 17 != 0
        cut = [m for i, m in enumerate(re.finditer(r"\w+|[^\w\s]", whole)) if i % 3 == 0]
        expected = [(m.start(), m.end() + shift, f"L{3 * i % 5}", None if hidden else m.group() + mark, None) for i, m in enumerate(cut)]
        assert [tuple(e) for e in r.entities] == expected


MENTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("side", pa.string())]))


def a_slice(records):
    named = [[dict(zip(("start", "end", "label", "ordinal", "side"), m, strict=True)) for m in record] for record in records]
    return pa.RecordBatch.from_arrays([pa.array(range(len(named)), pa.int64()), pa.array(named, MENTION)], names=["doc_id", "mentions"])


def sorts_of(monkeypatch, work):
    """How often work sorts."""
    found = []
    with monkeypatch.context() as patch:
        for name in ("lexsort", "argsort"):
            patch.setattr(np, name, lambda *a, f=getattr(np, name), **k: found.append(1) or f(*a, **k))
        work()
    return len(found)


def test_more_runs_need_no_more_sorts(monkeypatch):
    rng = random.Random(7)
    part = a_slice([random_mentions(rng, rng.randint(0, 9)) for _ in range(200)])
    runs = [lambda ordinal, n=n: ordinal % n != 0 for n in range(2, 8)]
    assert 0 < sorts_of(monkeypatch, lambda: beside.run_sums_in(part, runs[:1])) == sorts_of(monkeypatch, lambda: beside.run_sums_in(part, runs))


@pytest.mark.parametrize("wide", [0, 1, 1 << 20, 1 << 33, 1 << 62])
def test_packed_columns_are_in_the_order_of_a_sort_for_each(wide):
    rng = np.random.default_rng(2)
    columns = [rng.integers(-wide, wide + 1, 500) // max(1, wide // 3) * max(1, wide // 3) for _ in range(2)] + [rng.integers(0, 3, 500) for _ in range(3)]
    assert beside._order(*columns).tolist() == np.lexsort(columns[::-1]).tolist()
    assert beside._order(*(c[:0] for c in columns)).tolist() == []


def test_exact_sums_are_counted_without_marking_mentions(monkeypatch):
    copies = [(0, 2, "A", 0, "g"), (0, 2, "A", 1, "g"), (0, 2, "A", 2, "p"), (0, 2, None, 3, "p"), (0, 2, None, 4, "g"), (1, 2, "B", 5, "p")]
    monkeypatch.setattr(beside, "_paired", None)
    found = beside.exact_sums_in(a_slice([copies, [(1, 2, "B", 0, "g")], []])).to_pylist()
    assert sorted(map(repr, (tuple(r.values()) for r in found))) == sorted(map(repr, [("A", "g", 1, 2), ("A", "p", 1, 1), ("B", "g", 0, 1), ("B", "p", 0, 1), (None, "g", 1, 1), (None, "p", 1, 1)]))


def test_recovery_is_counted_in_the_pass_that_cuts_texts(spark, tmp_path):
    found = plan(queries.QUERIES["structural_recovery"](spark, documents(spark, tmp_path)))
    assert passes(found) == 1 and "Generate" not in found and "array<struct" not in found


def test_recovery_counts_reference_mentions_by_their_structure(spark):
    rng = random.Random(11)
    records = [(r, random_mentions(rng, rng.randint(0, 30))) for r in range(300)]
    expected = {kind: [0, 0] for kind in ("flat", "nested", "same_span")}
    for _, mentions in records:
        golds, left = [m for m in mentions if m[4] == "g"], [m[:3] for m in mentions if m[4] == "p"]
        for m in golds:
            same = len({x[2] for x in golds if x[:2] == m[:2]} - {None}) > 1
            inside = any(x[:2] != m[:2] and x[0] <= m[0] and x[1] >= m[1] for x in golds)
            exact = m[:3] in left
            if exact:
                left.remove(m[:3])
            for kind, holds in (("flat", not same and not inside), ("nested", inside), ("same_span", same)):
                expected[kind][0] += holds
                expected[kind][1] += holds and exact
    arrays = spark.createDataFrame(records, "rec int, mentions array<struct<start:int,end:int,label:string,ordinal:int,side:string>>").repartition(3)
    assert all(0 < matched < n for n, matched in expected.values())
    assert {tuple(r) for r in structure.recovery(arrays).collect()} == {(kind, n, matched, matched / n) for kind, (n, matched) in expected.items()}
    assert structure.recovery(arrays.filter("rec < 0")).collect() == [] == structure.recovery(arrays.withColumn("mentions", F.filter("mentions", lambda m: m["side"] == "p"))).collect()


class Given:
    """Stands for a table of texts: the step that is handed to it runs here."""

    def __init__(self, texts):
        self.part = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.part])))


def test_mentions_are_made_with_searches_by_text_and_not_by_token(monkeypatch):
    texts, searched = ["ab, c " * 1000, None, "", " \n", "x"], []
    monkeypatch.setattr(tiling, "_schema", lambda *a, **k: None)
    monkeypatch.setattr(fixtures, "table", lambda *a: Given(texts))
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *b, f=np.searchsorted, **k: searched.append(np.size(v)) or f(a, v, *b, **k))
    (made,) = fixtures.mention_records(None, "")
    assert sum(searched) < 200 and made.num_rows == 48 and made.column("doc_id").to_pylist() == [0] * 47 + [4]
    assert made.column("mentions").to_pylist()[-1] == [{"start": 0, "end": 1, "label": label, "ordinal": kind, "side": "g"} for kind, label in enumerate(("L1", "L3"))]
