"""Inputs for the span operators made from the documents table: integer rules only, so that SQL can follow them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.tiling import TOKEN, _field, _nested, _rows_of, _slices, exploded, with_lines, with_tokens
from spanloom.session import table

KEYS = ["doc_id", "rec"]
TOKENS_PER_RECORD = 64
N_LABELS = 5


def doc_tokens(spark: SparkSession, sf_dir: str, words: bool = False) -> DataFrame:
    """doc_id, rec, pos, start, end, n (length), ne (end of the next token), and token with words."""
    found = exploded(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), words=words), ["doc_id"], "tokens")
    made = [F.expr(f"pos div {TOKENS_PER_RECORD}").cast("int").alias("rec"), (F.col("end") - F.col("start")).alias("n"), F.col("next_end").alias("ne")]
    return found.select("doc_id", "pos", "start", "end", *made, *(["token"] if words else []))


#: What is added to the number of a mention's label, by its kind: 0 a token's own, 1 a second label on the span, 2 over the next token too, 3 a spurious prediction.
SHIFTS = (0, 2, 1, 0)


def _mentions(pos: np.ndarray, start: np.ndarray, own_end: np.ndarray, next_end: np.ndarray, pred: bool) -> dict[str, np.ndarray]:
    """The mentions of tokens by columns, in order of tokens. Predictions (side 1) are gold with some left out, relabelled or shortened, and spurious ones."""
    third = np.flatnonzero(pos % 3 == 0)
    golds = [(third, own_end), (third[pos[third] % 5 == 0], own_end), (third[(pos[third] % 2 == 0) & (next_end[third] >= 0)], next_end)]
    parts = []
    for kind, (at, ends) in enumerate(golds):
        n, end, number = pos[at], ends[at], own_end[at] - start[at] + pos[at]
        parts.append((at, end, number + SHIFTS[kind], kind, 0))
        if pred:
            kept, cut = n % 7 != 0, (n % 5 == 0) & (end - start[at] > 1)
            parts.append(tuple(x[kept] for x in (at, end - cut, number + np.where(n % 11 == 0, kind + 3, SHIFTS[kind]))) + (kind, 1))
    if pred:
        at = np.flatnonzero(pos % 13 == 1)
        parts.append((at, own_end[at], own_end[at] - start[at] + pos[at] + SHIFTS[3], 3, 1))
    tokens, ends, numbers, kinds, sides = zip(*parts, strict=True)
    token = np.concatenate(tokens)
    by = np.argsort(token, kind="stable")
    joined = lambda of: np.concatenate(of)[by]
    each = lambda of: joined([np.full(len(at), x) for at, x in zip(tokens, of, strict=True)])
    token = token[by]
    return {"token": token, "start": start[token], "end": joined(ends), "label": joined(numbers) % N_LABELS, "ordinal": pos[token] * 4 + each(kinds), "side": each(sides)}


MENTIONS = "doc_id bigint, rec int, mentions array<struct<start:int,end:int,label:string,ordinal:int,side:string>>"


def mention_records(spark: SparkSession, sf_dir: str, pred: bool = True, then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """doc_id, rec and mentions (start, end, label, ordinal, side; both sides with pred) of each record, a run of tokens of a document. A record without mentions has an empty array.

    The rules are worked out for all tokens of a slice together; as lambdas over the array of a row they cost more than cutting and matching do.
    then: what is made of each slice of these records in the same pass (a step of functions/mentions.py), and the columns that come out; mentions then never leave the worker.
    """
    labels, sides = [f"L{i}" for i in range(N_LABELS)], ["g", "p"]

    def records(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = part.column("tokens")
        owner, pos = _rows_of(tokens)[1], _field(tokens, "pos")
        made = _mentions(pos, *(_field(tokens, name) for name in ("start", "end", "next_end")), pred)
        opening = pos % TOKENS_PER_RECORD == 0
        record = (np.cumsum(opening) - 1)[made["token"]]
        named = {"label": pa.array(labels).take(pa.array(made["label"])), "side": pa.array(sides).take(pa.array(made["side"]))}
        fields = {name: pa.array(made[name].astype(np.int32)) for name in ("start", "end", "ordinal")} | named
        lists = _nested(record, int(opening.sum()), **{name: fields[name] for name in ("start", "end", "label", "ordinal", "side")})
        doc_id = part.column("doc_id").take(pa.array(owner[opening]))
        out = pa.RecordBatch.from_arrays([doc_id, pa.array((pos[opening] // TOKENS_PER_RECORD).astype(np.int32)), lists], names=["doc_id", "rec", "mentions"])
        yield from map(then[0], _slices(out, "mentions")) if then else [out]

    return with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), words=False, then=(records, then[1] if then else MENTIONS))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference mentions, a row each."""
    return mention_records(spark, sf_dir, pred=False).select(*KEYS, F.inline("mentions")).drop("side")


def with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens and spans (start, end, label): the mentions of gold() beside the tokens of their document, in one row."""
    labels = [f"L{i}" for i in range(N_LABELS)]

    def spans(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = part.column("tokens")
        made = _mentions(*(_field(tokens, name) for name in ("pos", "start", "end", "next_end")), pred=False)
        fields = {name: pa.array(made[name].astype(np.int32)) for name in ("start", "end")} | {"label": pa.array(labels).take(pa.array(made["label"]))}
        lists = _nested(_rows_of(tokens)[1][made["token"]], part.num_rows, **fields)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), tokens, lists], names=["doc_id", "tokens", "spans"])

    kind = f"doc_id bigint, tokens array<{TOKEN}>>, spans array<struct<start:int,end:int,label:string>>"
    return with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), words=False, then=(spans, kind))


def split_of(doc_id: str = "doc_id") -> F.Column:
    m = F.pmod(F.col(doc_id) * 7, F.lit(10))
    return F.when(m <= 6, "train").when(m == 7, "eval").otherwise("test")


def sentences(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """doc_id, sent_idx, id, text (with texts), document_start, document_end, split: the lines of each document."""
    lines = exploded(with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), words=texts), ["doc_id"], "lines")
    own = [F.col("start").alias("document_start"), F.col("end").alias("document_end"), split_of().alias("split")]
    return lines.select("doc_id", F.col("line").alias("sent_idx"), F.concat_ws("_", "doc_id", "line").alias("id"), *(["text"] if texts else []), *own)


def tagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with tags (start, end, tag) in the row, anywhere in a line by integer rules; they cut words and begin or end with blanks as it comes."""
    s = sentences(spark, sf_dir)
    at = F.pmod(F.col("doc_id") * 7 + F.col("sent_idx") * 5, F.greatest(F.length("text") - 3, F.lit(1))).cast("int")
    span = lambda a, b, tag: F.struct((at + a).alias("start"), (at + b).alias("end"), F.lit(tag).alias("tag"))
    made = F.array(span(0, 2, "L0"), span(0, 2, "L1"), span(1, 3, "L2"))
    few = F.when(F.col("sent_idx") % 2 == 0, made).otherwise(F.slice(made, 1, 1))
    return s.withColumn("tags", F.when(F.length("text") >= 4, few))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records, one for each document: every third token as an entity, with planted errors and leaks."""
    flag = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("out"))
    own = table(spark, sf_dir, "documents").select("doc_id", "text").join(flag, "doc_id", "left").select("doc_id", "text", F.coalesce("out", F.lit(False)).alias("out"))

    def entities(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens, doc_id = part.column("tokens"), part.column("doc_id").to_numpy(zero_copy_only=False)
        pos = _field(tokens, "pos")
        at = np.flatnonzero(pos % 3 == 0)
        owner, kept = _rows_of(tokens)[1][at], tokens.flatten().take(pa.array(at))
        shift, mark = np.where(doc_id % 19 == 0, 100000, 0), pa.array(np.where(doc_id % 29 == 0, "?", ""), pa.string())
        fields = {
            "start": kept.field("start"), "end": pa.array((kept.field("end").to_numpy(zero_copy_only=False) + shift[owner]).astype(np.int32)),
            "label": pa.array([f"L{i}" for i in range(N_LABELS)]).take(pa.array(pos[at] % N_LABELS)), "text": pc.binary_join_element_wise(kept.field("token"), mark.take(pa.array(owner)), ""),
            "spans": pa.nulls(len(at), pa.list_(pa.list_(pa.int32()))),
        }
        lists = _nested(owner, part.num_rows, **fields)
        yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["doc_id", "text", "out", "entities"])

    joined = with_tokens(own, then=(entities, "doc_id bigint, text string, out boolean, entities array<struct<start:int,end:int,label:string,text:string,spans:array<array<int>>>>"))
    leak = F.col("doc_id") % 17 == 0
    hidden = F.col("out") & ~leak
    bare = F.transform("entities", lambda e: e.withField("text", F.lit(None).cast("string")))
    null = F.lit(None).cast("string")
    meta = F.struct(
        F.col("doc_id").cast("string").alias("doc_id"), split_of().alias("split"), F.when(F.col("out") & ~(F.col("doc_id") % 3 == 0), "excluded").otherwise("").alias("text_redistribution_status"),
        F.when(F.col("out"), F.when(F.col("doc_id") % 34 == 0, "include_text").otherwise("exclude_text")).otherwise("include_text").alias("source_text_decision"), null.alias("sentence_sha256"), null.alias("sentence_char_length"),
        F.when(~hidden, F.concat(F.lit("0text"), "doc_id", F.lit(".txt"))).alias("brat_txt_path"), F.when(~hidden, F.concat(F.lit("0text"), "doc_id", F.lit(".ann"))).alias("brat_ann_path"),
    )
    tags = F.lit(None).cast("array<struct<start:int,end:int,tag:string,text:string>>")
    return joined.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("id"), F.when(~hidden, F.col("text")).alias("text"), F.sha2(F.when(F.col("doc_id") % 23 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("text_sha256"),
        (F.length("text") + F.when(F.col("doc_id") % 31 == 0, 1).otherwise(0)).alias("text_length"), F.when(hidden, bare).otherwise(F.col("entities")).alias("entities"), tags.alias("tags"), meta.alias("meta"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows, one for each document, with identifiers and licences left empty by rule."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    blank = lambda k, text: F.when(d % k == 0, "").otherwise(text)
    flag = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("out"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(flag, "doc_id", "left")
    return docs.select(
        s.alias("doc_id"), split_of().alias("split"), F.concat(F.lit("0text"), s, F.lit(".txt")).alias("source_file"), F.when(F.col("out"), "exclude_text").otherwise("include_text").alias("source_text_decision"),
        F.concat(F.lit("Title "), s).alias("source_title"), blank(7, F.concat(F.lit("10.1000/"), s)).alias("doi"), blank(3, s).alias("pmid"), blank(5, F.concat(F.lit("PMC"), s)).alias("pmcid"),
        (1990 + d % 35).cast("string").alias("publication_year"), F.col("source").alias("journal"), F.lit("").alias("publisher"),
        blank(2, F.lit("cc by")).alias("epmc_license"), F.when(d % 4 == 0, "").otherwise(F.lit("cc-by-nc")).alias("openalex_licenses"), F.when(d % 8 == 0, "").otherwise(F.lit("bronze")).alias("unpaywall_licenses"),
        F.when(d % 16 == 0, "").otherwise(F.lit("https://creativecommons.org/licenses/by/4.0/")).alias("crossref_license_urls"),
        F.when(d % 4 == 1, "high").otherwise("low").alias("match_confidence"), F.concat(F.lit("rule "), (d % 6).cast("string")).alias("match_reason"), F.sha2("text", 256).alias("sha256_txt"),
    )


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rows from part types and targets, numbered by where a type first stands, after inline rows for awkward names."""
    own = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_size").alias("m"), F.min("p_partkey").alias("row_no"))
    rows = own.select("row_no", F.col("p_type").alias("source_type"), F.when(F.col("m") % 10 == 9, "0.0").otherwise(F.concat(F.lit("L"), (F.col("m") % 5).cast("string"))).alias("target_label"))
    fixed = spark.createDataFrame([(-3, "Acid, Nucleic-Type", "L1"), (-2, "Body_Part", "L9"), (-1, "Cell Line", "0.0")], "row_no long, source_type string, target_label string")
    return rows.unionByName(fixed)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of an 8 by 8 grid of 3 channels for each document, in hundredths."""
    cells = spark.range(8 * 8 * 3).select(
        F.expr("cast(id div 24 as int)").alias("row"), F.expr("cast((id div 3) % 8 as int)").alias("col"), F.expr("cast(id % 3 + 1 as int)").alias("channel")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id")
    score = (F.col("doc_id") * 31 + F.col("row") * 17 + F.col("col") * 13 + F.col("channel") * 7) % 100
    return docs.join(F.broadcast(cells)).select("doc_id", "row", "col", "channel", (score / 100).alias("score"))


def grid_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reference entities for each document."""
    one = F.pmod(F.col("doc_id"), F.lit(6)).cast("int")
    made = F.array(F.struct(F.array(one, one + 1).alias("index"), F.lit(2).alias("type")), F.struct(F.array(one).alias("index"), F.lit(3).alias("type")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(made))


def flat_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference mentions, and predicted ones with a logit and a probability in hundredths: eight places for each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ordinal"))
    label = lambda shift: F.concat(F.lit("L"), ((F.col("doc_id") + F.col("ordinal") + shift) % 3).cast("string"))
    start = F.col("ordinal") * 4
    gold = d.filter((F.col("doc_id") + F.col("ordinal")) % 4 != 0).select("doc_id", "ordinal", start.alias("start"), (start + 3).alias("end"), label(0).alias("label"))
    odd = F.when((F.col("doc_id") * 3 + F.col("ordinal")) % 5 == 0, 1).otherwise(0)
    score = lambda a, b: ((F.col("doc_id") * a + F.col("ordinal") * b) % 100 / 100)
    pred = d.select("doc_id", "ordinal", start.alias("start"), (start + 3 - (F.col("doc_id") + F.col("ordinal")) % 2).cast("int").alias("end"), label(odd).alias("label"), score(29, 41).alias("logit"), score(17, 23).alias("prob"))
    return gold, pred
