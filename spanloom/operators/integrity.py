"""Checks of records: reconstruction, leaks of excluded text, label mappings, splits and checksums. Each gives one row for each error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import block_piece, first_filled, plain_name, text_blocks

#: The shape of a record that these checks read.
RECORD = (
    "id string, text string, text_sha256 string, text_length int, "
    "entities array<struct<start:int,end:int,label:string,text:string,spans:array<array<int>>>>, "
    "tags array<struct<start:int,end:int,tag:string,text:string>>, "
    "meta struct<doc_id:string,split:string,text_redistribution_status:string,source_text_decision:string,sentence_sha256:string,sentence_char_length:string,"
    "brat_txt_path:string,brat_ann_path:string>"
)


def _errors(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]), lambda x: x.isNotNull())


def entity_view(entities: Column, tags: Column) -> Column:
    """Entities, or else tags in their shape."""
    blank = F.lit(None).cast("array<array<int>>")
    shaped = F.transform(tags, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["tag"].alias("label"), t["text"].alias("text"), blank.alias("spans")))
    return F.coalesce(entities, shaped, F.filter(shaped, lambda _: F.lit(False)))


def record_errors(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and error. A record without text has that one error; else digest, length and every entity are checked.

    An entity errs if its offsets are outside of the text or reversed (an empty span is fine), or if its own text is neither the
    slice nor, for several spans, the slices joined by a space in their given order.
    """
    text, meta = F.col("text"), F.col("meta")
    digest = F.coalesce(F.when(F.col("text_sha256") != "", F.col("text_sha256")), F.when(meta["sentence_sha256"] != "", meta["sentence_sha256"]))
    length = F.coalesce(F.when(F.col("text_length") != 0, F.col("text_length")), F.when(meta["sentence_char_length"] != "", meta["sentence_char_length"]).cast("int"))
    outer = _errors((digest != F.sha2(text, 256), "text_sha256 mismatch"), (length != F.length(text), "text_length mismatch"))

    outer = F.when(text.isNull(), F.array(F.lit("text is not reconstructed"))).otherwise(outer)

    def of(e: Column) -> Column:
        cut = lambda a, b: block_piece(F.col("blocks"), a, b)
        bad = (e["start"] < 0) | (e["end"] > F.col("size")) | (e["start"] > e["end"])
        fragments = F.when(e["spans"].isNull(), False).otherwise(e["text"] == F.array_join(F.transform(e["spans"], lambda s: cut(s[0], s[1])), " "))
        return F.when(bad, "invalid entity offsets").when(e["text"] != cut(e["start"], e["end"]), F.when(~fragments, "entity text mismatch"))

    # The length and the blocks are taken once for a text: for each entity they would cost its whole length again.
    viewed = records.select(*keys, outer.alias("outer"), F.length(text).alias("size"), text_blocks(text).alias("blocks"), entity_view(F.col("entities"), F.col("tags")).alias("viewed"))
    inner = F.filter(F.transform("viewed", of), lambda x: x.isNotNull())
    return viewed.select(*keys, F.explode(F.when(F.col("size").isNull(), F.col("outer")).otherwise(F.concat("outer", inner))).alias("error"))


def leak_errors(records: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, doc_id and error for records of excluded documents that still carry text, paths, or no excluded status."""
    meta = F.col("meta")
    doc_id = F.coalesce(F.when(meta["doc_id"] != "", meta["doc_id"]), F.element_at(F.split("id", "_"), 1))
    status = first_filled(meta["text_redistribution_status"], meta["source_text_decision"])
    own = records.withColumn("doc_id", doc_id).join(excluded.select("doc_id").distinct(), "doc_id", "left_semi")
    outer = _errors(
        (~status.isin("excluded", "exclude_text"), "missing excluded status"),
        (F.col("text").isNotNull(), "contains sentence text"),
        (first_filled(meta["brat_txt_path"]) != "", "retains brat_txt_path"),
        (first_filled(meta["brat_ann_path"]) != "", "retains brat_ann_path"),
    )
    inner = F.transform(F.filter(F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,label:string,text:string,spans:array<array<int>>>>")), lambda e: e["text"].isNotNull()), lambda _: F.lit("contains entity text"))
    return own.select(*keys, "doc_id", F.explode(F.concat(outer, inner)).alias("error"))


def excluded_files(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """path and error of annotation or text files (path, doc_id) of excluded documents."""
    hit = files.filter(F.rlike("path", F.lit(r"\.(txt|ann)$"))).join(excluded.select("doc_id").distinct(), "doc_id", "left_semi")
    return hit.select("path", "doc_id", F.lit("file of a text-excluded document").alias("error"))


def redacted(records: DataFrame, excluded: DataFrame, keep: Column | None = None) -> DataFrame:
    """Records with the text and the entity texts of excluded documents nulled; offsets and labels stay. keep: rows left as they are."""
    flag = excluded.select("doc_id").distinct().withColumn("gone", F.lit(True))
    out = records.join(flag, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)) & ~(F.lit(False) if keep is None else keep))
    bare = F.transform("entities", lambda e: e.withField("text", F.lit(None).cast("string")))
    return out.withColumns({"text": F.when(~F.col("gone"), F.col("text")), "entities": F.when(F.col("gone"), bare).otherwise(F.col("entities"))}).drop("gone")


def mapping_report(mapping: DataFrame, allowed: DataFrame, known_types: DataFrame, drop: str = "0.0") -> DataFrame:
    """kind and name: targets that are not allowed, allowed labels without use, and source types unknown to the type list."""
    targets = mapping.filter(F.col("target_label") != drop).select(F.col("target_label").alias("label")).distinct()
    labels = allowed.select("label").distinct()
    plain = known_types.select(F.regexp_replace(F.trim("name"), " ", "").alias("plain")).distinct()
    types = mapping.select("source_type").distinct().withColumn("plain", plain_name(F.col("source_type")))
    parts = (
        ("invalid_target", targets.join(labels, "label", "left_anti")),
        ("unused_label", labels.join(targets, "label", "left_anti")),
        ("unmatched_type", types.join(plain, "plain", "left_anti").select(F.col("source_type").alias("label"))),
    )
    rows = [df.select(F.lit(kind).alias("kind"), F.col("label").alias("name")) for kind, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def mapping_totals(mapping: DataFrame, drop: str = "0.0") -> DataFrame:
    kept = F.when(F.col("target_label") != drop, F.col("target_label"))
    return mapping.agg(F.count("*").alias("mapping_rows"), F.count_distinct("source_type").alias("source_types"), F.count_if(F.col("target_label") == drop).alias("drop_rows"), F.count_distinct(kept).alias("kept_labels"))


def top_targets(mapping: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The n most frequent targets; of equal counts the one seen first."""
    return mapping.groupBy("target_label").agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def split_overlaps(records: DataFrame) -> DataFrame:
    """doc_id and n_splits of documents in several splits; none for a document-disjoint split."""
    return records.groupBy("doc_id").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def missing_labels(mentions: DataFrame, inventory: DataFrame, splits: DataFrame) -> DataFrame:
    """split and label pairs that no mention has. Inventory and splits are small lists."""
    return F.broadcast(splits).join(F.broadcast(inventory)).join(mentions.select("split", "label").distinct(), ["split", "label"], "left_anti")


def checksum_errors(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and error for files (path, sha256) against a manifest (path, sha256)."""
    both = files.select("path", F.col("sha256").alias("is")).join(manifest.select("path", F.col("sha256").alias("should")), "path", "full_outer")
    error = F.when(F.col("is").isNull(), "missing").when(F.col("should").isNull(), "not listed").when(F.col("is") != F.col("should"), "mismatch")
    return both.select("path", error.alias("error")).filter(F.col("error").isNotNull())
