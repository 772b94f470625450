"""Split statistics and the search for a document-disjoint split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import kept

SPLITS = ("train", "eval", "test")


def membership(ids: DataFrame) -> DataFrame:
    """doc_id and its combination of splits, as a+b in order of name."""
    return ids.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("split")), "+").alias("combination"))


def label_table(mentions: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """label and its number of mentions in each split, with the smallest of them."""
    table = mentions.groupBy("label").pivot("split", list(splits)).count().na.fill(0, list(splits))
    return table.withColumn("minimum", F.least(*splits))


def rare_labels(table: DataFrame, below: int | None = None, share: float = 1.0) -> DataFrame:
    """Labels whose smallest number of mentions is below a number, or, without one, below a share of the mean of all labels' smallest numbers. A row for each label: an inventory."""
    if below is not None:
        return table.filter(F.col("minimum") < below)
    mean = F.avg("minimum").over(Window.partitionBy())
    return table.withColumn("_mean", mean).filter(F.col("minimum") < share * F.col("_mean")).drop("_mean")


def median_of_minima(table: DataFrame) -> DataFrame:
    return table.agg(F.min("minimum").alias("lowest"), F.percentile("minimum", F.lit(0.5)).alias("median"))


def split_totals(records: DataFrame) -> DataFrame:
    """Per split: documents, sentences, entities, labels, and sentences with same-span or nested mentions (flags of with_structure()). records: split, doc_id and mentions, in the row."""
    some = lambda c: F.exists("mentions", lambda m: m[c])
    per = records.select("split", "doc_id", F.size("mentions").cast("long").alias("n"), F.array_distinct(F.transform("mentions", lambda m: m["label"])).alias("labels"), some("same_span").alias("s"), some("nested").alias("d"))
    once = F.struct(F.lit(None).cast("string").alias("label"), F.lit(1).alias("one"), F.col("n").alias("n"), F.col("s").alias("s"), F.col("d").alias("d"))
    each = F.transform("labels", lambda x: F.struct(x.alias("label"), F.lit(0).alias("one"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("s"), F.lit(False).alias("d")))
    rows = per.select("split", "doc_id", F.inline(F.concat(F.array(once), each)))
    return rows.groupBy("split").agg(
        F.count_distinct("doc_id").alias("documents"), F.sum("one").alias("sentences"), F.sum("n").alias("entities"), F.count_if("s").alias("same_span_sentences"), F.count_if("d").alias("nested_sentences"), F.count_distinct("label").alias("labels")
    )


#: Ranks of the hash that orders the documents of a candidate.
RANKS, RANGE = 1_000_003, 1024
#: Rows of a document and a candidate that a task ranks, about.
RANKED = 8_000_000
#: Labels in one whole number.
WORD = 63
#: Counts of a document that a split should share out.
TALLIES = ("sentences", "nested", "same_span")


def split_search(documents: DataFrame, targets: Mapping[str, float], candidates: int = 500) -> DataFrame:
    """The best of several deterministic document-level splits: candidate, doc_id, split, score.

    documents: doc_id, sentences, nested, same_span (sentence counts), labels array<string>. Each candidate ranks documents by a hash of
    candidate and id and fills the splits by running sentence totals. The score is the sum of the absolute deviations of the shares of
    sentences, nested and same-span sentences from the targets, plus 1 for each label that a split lacks; the lowest wins, the first of equals.
    The rule is our own; a published score cannot be reproduced from it.

    Documents are read once for all candidates: each sends its tallies to one range of ranks of each candidate, where they are summed before they
    are shuffled, so what moves is a row for each candidate and range. A document takes few bytes and as many steps as there are candidates, so documents are dealt
    out by their number and not by the size of their files. Only ranges in which a split ends are looked at document by document. Labels are an
    inventory (a list that the driver reads); those of rows are bits of whole numbers.
    """
    documents = kept(documents.select("doc_id", *TALLIES, "labels"), "documents")  # a few numbers a document, used for ranking and for the result
    inventory = sorted(r[0] for r in documents.select(F.explode("labels")).distinct().collect())
    words = [inventory[i : i + WORD] for i in range(0, len(inventory), WORD)]
    bits = {f"labels_{w}": reduce(Column.bitwiseOR, [F.when(F.array_contains("labels", x), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in enumerate(word)]) for w, word in enumerate(words)}
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, -(-documents.count() * candidates // RANKED))
    masked = documents.select("doc_id", *TALLIES, *[c.alias(n) for n, c in bits.items()]).repartition(tasks)
    sets = [F.bit_or(n).alias(n) for n in bits]
    # Integer arithmetic, so that any engine can follow it: a different permutation of ids for each candidate.
    order = (F.col("doc_id") * (2 * F.col("candidate") + 1) * 7919 + F.col("candidate") * 104729) % RANKS
    every = F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))
    ranked = masked.select("*", every.alias("candidate")).withColumn("rank", order.cast("int")).withColumn("range", F.expr(f"rank div {RANGE}").cast("int"))
    sums = kept(ranked.groupBy("candidate", "range").agg(*[F.sum(c).alias(c) for c in TALLIES], *sets), "ranges")  # at most as many rows as candidates times ranges, used three times
    earlier = Window.partitionBy("candidate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("candidate")
    based = sums.withColumns({"base": F.coalesce(F.sum("sentences").over(earlier), F.lit(0)), **{f"all_{c}": F.sum(c).over(whole) for c in TALLIES}})
    bounds, so_far = [], 0.0
    for name, share in targets.items():
        so_far += share
        bounds.append((name, so_far))

    def split(upto: Column) -> Column:
        out = F.lit(bounds[-1][0])
        for name, bound in reversed(bounds[:-1]):
            out = F.when(upto < bound * F.col("all_sentences"), name).otherwise(out)
        return out

    # The first document of a range starts at base; no document of it starts at or after the base of the next.
    spread = based.withColumns({"first": split(F.col("base")), "last": split(F.col("base") + F.col("sentences") - 1)})
    plain = spread.filter("first = last").select("candidate", F.col("first").alias("split"), *TALLIES, *bits)
    torn = spread.filter("first <> last").select("candidate", "range", "base", "all_sentences")
    within = Window.partitionBy("candidate", "range").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranked.join(F.broadcast(torn), ["candidate", "range"])  # at most a range for each candidate and end of a split
    placed = inner.withColumn("split", split(F.col("base") + F.coalesce(F.sum("sentences").over(within), F.lit(0)))).select("candidate", "split", *TALLIES, *bits)
    per = plain.unionByName(placed).groupBy("candidate", "split").agg(*[F.sum(c).alias(c) for c in TALLIES], *sets)
    goal = F.element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("split"))
    off = sum(F.abs(F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1)) - goal) for c in TALLIES)
    have = sum((F.bit_count(n) for n in bits), F.lit(0))
    scores = per.withColumn("off", off).groupBy("candidate").agg(F.sum("off").alias("off"), F.sum(have).alias("have"))
    scored = scores.select("candidate", (F.col("off") + len(inventory) * len(targets) - F.col("have")).alias("score"))
    best = scored.orderBy(F.round("score", 9), "candidate").limit(1)
    winner = F.broadcast(best)
    own = documents.select("doc_id", "sentences").join(winner).withColumn("rank", order.cast("int")).withColumn("range", F.expr(f"rank div {RANGE}").cast("int"))
    bases = based.select("candidate", "range", "base", "all_sentences").join(F.broadcast(best.select("candidate")), "candidate")
    final = own.join(F.broadcast(bases.drop("candidate")), "range").withColumn("split", split(F.col("base") + F.coalesce(F.sum("sentences").over(within), F.lit(0))))
    return final.select("candidate", "doc_id", "split", "score")
