"""Structure of mentions: same-span, nested and flat; links from sentences to documents; label inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.mentions import gathered, recovery_sums, with_structure


def structure(mentions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mentions with same_span (another label on the same span), nested (strictly inside another) and flat (neither), after one shuffle by the record keys."""
    return with_structure(gathered(mentions, keys)).select(*keys, F.inline("mentions"))


def recovery(records: DataFrame) -> DataFrame:
    """kind, mentions, matched and share of reference mentions that an exact match recovers, for each kind of structure; records: with their mentions of both sides in the row."""
    return recovery_of_sums(recovery_sums(records))


def recovery_of_sums(sums: DataFrame) -> DataFrame:
    """The same from kind, mentions and matched, in any number of parts that add up."""
    counts = sums.groupBy("kind").agg(F.sum("mentions").alias("mentions"), F.sum("matched").alias("matched"))
    return counts.filter("mentions > 0").select("*", (F.col("matched") / F.col("mentions")).alias("share"))


def to_document_offsets(mentions: DataFrame, sentences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mentions of sentences with offsets in the document: the sentence's own start is added."""
    shifted = mentions.join(sentences.select(*keys, "document_start"), list(keys))
    return shifted.withColumns({"document_from": F.col("start") + F.col("document_start"), "document_to": F.col("end") + F.col("document_start")})


#: Characters of a bucket in the join of mentions to the sentences they touch.
BUCKET = 1024


def to_sentence_offsets(mentions: DataFrame, sentences: DataFrame, keys: Sequence[str], sentence: str = "sent_idx") -> DataFrame:
    """The columns of mentions, the number of each sentence that a mention touches, and sentence_from, sentence_to and whole: its part there, and whether that is all of it.

    mentions have offsets in the document (keys, start, end), sentences their own range (keys, document_start, document_end). A mention over the edge of sentences has a
    row in each; one that touches none, such as a line break alone, has none; an empty one lies where its place is, in both sentences where it stands at the edge of two that touch.
    Both sides meet in buckets of offsets, and a pair in several buckets counts in the first of them, so a document is no product of its mentions and sentences,
    and a long one is spread over its buckets.
    """
    keys = list(keys)
    low = lambda c: F.floor(F.col(c) / BUCKET)
    spread = lambda df, a, b: df.withColumn("_first", low(a)).withColumn("_bucket", F.explode(F.sequence("_first", F.greatest("_first", low(b)))))
    here = spread(mentions, "start", "end")
    there = spread(sentences.select(*keys, sentence, "document_start", "document_end"), "document_start", "document_end").withColumnRenamed("_first", "_first_of_sentence")
    met = here.join(there, [*keys, "_bucket"]).filter(F.col("_bucket") == F.greatest("_first", "_first_of_sentence"))
    empty = F.col("start") == F.col("end")
    touching = (F.col("start") < F.col("document_end")) & (F.col("document_start") < F.col("end"))
    inside = met.filter(F.when(empty, F.col("start").between(F.col("document_start"), F.col("document_end"))).otherwise(touching))
    begin, end = (F.greatest("start", "document_start") - F.col("document_start")).cast("int"), (F.least("end", "document_end") - F.col("document_start")).cast("int")
    whole = (F.col("start") >= F.col("document_start")) & (F.col("end") <= F.col("document_end"))
    return inside.select(*[c for c in mentions.columns], sentence, begin.alias("sentence_from"), end.alias("sentence_to"), whole.alias("whole"))


def mapped_labels(mentions: DataFrame, mapping: DataFrame, drop: str = "0.0") -> DataFrame:
    """Mentions with source_type replaced by its target label; those mapped to drop, or not mapped, go."""
    return mentions.join(mapping, "source_type").filter(F.col("target_label") != drop).withColumnRenamed("target_label", "label")
