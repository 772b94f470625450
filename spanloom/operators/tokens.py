"""Tokenisation with character offsets, span alignment, BIO labels, class weights and length summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import begin_id, inside_id
from spanloom.functions.tiling import exploded, with_label_bits, with_labels, with_pieces, with_tokens


def tokens(records: DataFrame, keys: Sequence[str], text: str = "text", words: bool = True) -> DataFrame:
    """keys, pos (from 0), start, end, token: runs of word characters and other single characters, without white space. words: whether with their texts."""
    cut = with_tokens(records.select(*keys, text), text, words=words)
    return exploded(cut, list(keys), "tokens").drop("next_end")


def cut_at_spans(records: DataFrame, spans: str = "spans", text: str = "text", words: bool = True) -> DataFrame:
    """records with tokens as with_tokens() makes them, cut at the edges of the spans of their row too. Chunks of white space alone are left out.

    The spans (array<struct<start, end, ...>>) come out with the tokens inside them (first, last, n_tokens) and aligned, whether those tokens' edges are the span's.
    """
    return with_tokens(records, text, words=words, spans=spans)


def _misfit(span: Column) -> Column:
    problem = F.when(span["n_tokens"] == 0, "no tokens aligned to span ").otherwise("span alignment failed for ")
    return F.concat(problem, span["start"].cast("string"), F.lit("-"), span["end"].cast("string"))


def require_aligned(records: DataFrame, spans: str = "spans") -> DataFrame:
    """The same records; the job fails at a span without tokens or with other edges."""
    checked = F.transform(spans, lambda s: s.withField("aligned", F.when(s["aligned"], True).otherwise(F.raise_error(_misfit(s)).cast("boolean"))))
    return records.withColumn(spans, checked)


def converted(records: DataFrame, keys: Sequence[str], spans: str = "spans", label: str = "tag") -> DataFrame:
    """keys, tokens array<string> and ner array<struct<index array<int>, type>>, in order of offsets, then type: the training record of each row of cut_at_spans().

    Spans that are not aligned fail the job; records without tokens are left out.
    """
    item = lambda s: F.struct(s["start"], s["end"], s[label].alias("type"), F.sequence(s["first"], s["last"]).alias("index"))
    mentions = F.array_sort(F.transform(spans, lambda s: F.when(s["aligned"], item(s)).otherwise(F.raise_error(_misfit(s)).cast("struct<start:int,end:int,type:string,index:array<int>>"))))
    ner = F.transform(F.coalesce(mentions, F.array()), lambda x: F.struct(x["index"].alias("index"), x["type"].alias("type")))
    return records.filter(F.size("tokens") > 0).select(*keys, F.transform("tokens", lambda t: t["token"]).alias("tokens"), ner.alias("ner"))


def conversion_stats(records: DataFrame, spans: str = "spans") -> DataFrame:
    """One row: sentences, entities, records with a repeated span, repeated spans, and rows beyond the first of each. Each record is looked at by itself."""
    place = F.array_sort(F.transform(F.coalesce(F.col(spans), F.array()), lambda s: F.struct(s["start"], s["end"])))
    per = records.select(place.alias("places")).select(
        F.size("places").alias("n"), (F.size("places") - F.size(F.array_distinct("places"))).alias("x"),
        F.size(F.filter("places", lambda p, i: (i > 0) & (p == F.get("places", i - 1)) & ((i < 2) | (p != F.get("places", i - 2))))).alias("g"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        F.count("*").alias("sentences"), total("n").alias("entities"), F.count_if(F.col("g") > 0).alias("sentences_with_same_span_multilabel"), total("g").alias("same_span_groups"), total("x").alias("same_span_extra_labels")
    )


def label_ids(labels: DataFrame) -> dict[str, int]:
    """An inventory (label_id, label: a few rows) as a dictionary."""
    return {r["label"]: r["label_id"] for r in labels.select("label", "label_id").collect()}


def bio_labels(records: DataFrame, labels: DataFrame, keys: Sequence[str], max_length: int, spans: str = "spans") -> DataFrame:
    """keys, pos, label_id: the B and I labels of each token among the first max_length; a token inside several spans has several. records hold tokens and spans in the row."""
    return exploded(with_labels(records, label_ids(labels), max_length, spans=spans), list(keys), "bio")


def padded_labels(records: DataFrame, labels: DataFrame, keys: Sequence[str], lengths: Sequence[int], spans: str = "spans") -> DataFrame:
    """keys, padded_to, loss_mask and label_bits of each record that has tokens: its multi-hot target in one row, padded to the first of lengths that holds it (the last cuts it)."""
    made = with_label_bits(records, label_ids(labels), lengths, spans=spans)
    return made.filter("padded_to > 0").select(*keys, "padded_to", "loss_mask", "label_bits")


def subword_tokens(records: DataFrame, keys: Sequence[str], encode: Callable[[Sequence[str]], Sequence[Sequence[tuple[int, int]]]], text: str = "text") -> DataFrame:
    """keys, pos, start, end, token by a tokenizer of the caller: encode gives the character offsets of the pieces of each text. It runs over Arrow batches."""
    return exploded(with_pieces(records.select(*keys, text), encode, text), list(keys), "tokens").drop("next_end")


def tag_inventory(labels: DataFrame) -> DataFrame:
    """label_id and tag: O, then B- and I- of each label in the order of the inventory."""
    pair = F.array(
        F.struct(begin_id(F.col("label_id")).alias("label_id"), F.concat(F.lit("B-"), "label").alias("tag")),
        F.struct(inside_id(F.col("label_id")).alias("label_id"), F.concat(F.lit("I-"), "label").alias("tag")),
    )
    outside = labels.limit(0).select(F.lit(0).cast("int").alias("label_id"), F.lit("O").alias("tag")).unionByName(labels.sparkSession.range(1).select(F.lit(0).cast("int").alias("label_id"), F.lit("O").alias("tag")))
    return outside.unionByName(labels.select(F.inline(pair)))


def positive_weights(bio: DataFrame, tags: DataFrame, n_tokens: DataFrame, cap: float = 50.0) -> DataFrame:
    """label_id, tag, positives, weight: max(1, min(cap, negatives / positives)); 1 without positives, and for O."""
    counts = bio.groupBy("label_id").agg(F.count("*").alias("positives"))
    joined = tags.join(counts, "label_id", "left").join(F.broadcast(n_tokens))
    p = F.coalesce("positives", F.lit(0))
    weight = F.when((F.col("label_id") > 0) & (p > 0), F.greatest(F.lit(1.0), F.least(F.lit(cap), (F.col("n_tokens") - p) / p))).otherwise(1.0)
    return joined.select("label_id", "tag", p.alias("positives"), weight.alias("weight"))


PERCENTILES = (50, 90, 95, 99)


def _lengths(length: Column) -> list[Column]:
    whole = [F.count(length).alias("count"), F.coalesce(F.min(length), F.lit(0)).alias("min"), F.coalesce(F.max(length), F.lit(0)).alias("max"), F.coalesce(F.avg(length), F.lit(0.0)).alias("mean")]
    return whole + [F.coalesce(F.percentile(length, F.lit(p / 100)).cast("int"), F.lit(0)).alias(f"p{p}") for p in PERCENTILES]


def length_summary(lengths: DataFrame, group: str, length: str = "length") -> DataFrame:
    """Counts, bounds, mean and exact percentiles (cut to whole numbers) for each group and for all (group null)."""
    return lengths.groupingSets([[F.col(group)], []], F.col(group)).agg(*_lengths(F.col(length)))


def length_coverage(lengths: DataFrame, group: str, thresholds: Sequence[int], length: str = "length") -> DataFrame:
    """Share of lengths up to each threshold, for each group and for all (group null)."""
    grid = lengths.select(group, length, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    share = F.avg((F.col(length) <= F.col("threshold")).cast("double")).alias("coverage")
    return grid.groupingSets([[F.col(group), F.col("threshold")], [F.col("threshold")]], F.col(group), F.col("threshold")).agg(share)
