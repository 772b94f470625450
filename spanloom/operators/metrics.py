"""Scores from counts: overlap-aware, exact, over seeds, and masked sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import count_scores, harmonic, ratio
from spanloom.operators.matching import COUNTS


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy of rows of the five counts; partial matches count half, an empty denominator gives 0."""
    hit = F.col("correct") + 0.5 * F.col("partial")
    common = F.col("correct") + F.col("incorrect") + F.col("partial")
    p, r = ratio(hit, common + F.col("spurious")), ratio(hit, common + F.col("missed"))
    scored = counts.withColumns({"precision": p, "recall": r, "accuracy": ratio(hit, common + F.col("missed") + F.col("spurious"))})
    return scored.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def label_scores(outcomes: DataFrame) -> DataFrame:
    """A row for each label and one for all (label null), each from summed counts."""
    return with_scores(outcomes.groupingSets([[F.col("label")], []], F.col("label")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]))


def exact_scores(marked: DataFrame) -> DataFrame:
    """micro and macro precision, recall and f1 of exact matches (rows of exact_matches()); macro is the mean over labels that either side has."""
    return exact_scores_of_sums(marked.groupBy("label", "side").agg(F.count_if("exact").alias("matched"), F.count("*").alias("mentions")))


def exact_scores_of_sums(sums: DataFrame) -> DataFrame:
    """The same from label, side, matched and mentions, in any number of parts that add up."""
    of = lambda n, side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(n))), F.lit(0))
    per = sums.groupBy("label").agg(of("matched", "g").alias("c"), of("mentions", "p").alias("p"), of("mentions", "g").alias("r"))
    scored = per.select("c", "p", "r", *[v.alias(k) for k, v in count_scores(F.col("c"), F.col("p"), F.col("r")).items()])
    total = scored.agg(F.sum("c").alias("c"), F.sum("p").alias("p"), F.sum("r").alias("r"), *[F.avg(k).alias(f"macro_{k}") for k in ("precision", "recall", "f1")])
    return total.select(*[v.alias(f"micro_{k}") for k, v in count_scores(F.col("c"), F.col("p"), F.col("r")).items()], "macro_precision", "macro_recall", "macro_f1")


def mean_and_spread(runs: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over runs (seeds)."""
    return runs.groupBy(*group).agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def masked_loss(logits: DataFrame) -> DataFrame:
    """Binary cross-entropy with weights of positives, over tokens that count: sum(loss * mask) / max(sum(mask), 1).

    Rows: logit, target, mask, weight for each token and label; the mask of a token stands on each of its labels, so the sum of masks is that of the tokens times the labels.
    """
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    x, y = F.col("logit"), F.col("target")
    loss = F.col("weight") * y * softplus(-x) + (1 - y) * softplus(x)
    return logits.agg((F.sum(loss * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1.0))).alias("loss"))


def best_setting(sweep: DataFrame, ordinal: str) -> DataFrame:
    """The row with the highest f1, then precision, then recall; of equal rows the first of the grid."""
    return sweep.orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"), F.asc(ordinal)).limit(1)
