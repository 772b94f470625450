"""One-to-one matching of reference and predicted mentions.

Both sides are rows of (record keys, start, end, label, ordinal) and a side, g (reference) or p. Per record: exact matches first, then same-label overlaps, where
each reference mention in order of (start, label, ordinal) takes the shortest free prediction, ties in the sorted order of predictions, then
equal spans with different labels. What is left is missed or spurious.

Choices where the rule is silent: overlap is strict and half open; a wrong label counts for the reference label; a spurious mention for the
predicted label. Everything of a record is worked out in its row (functions/mentions.py): mentions that stand beside their record are not shuffled at all,
mentions in rows of their own once, by the record keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.mentions import COUNTS, gathered, outcomes_of, with_exact


def both_sides(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mentions of both sides in one table, with side g or p; callers that make both in one pass need no union."""
    columns = [*keys, "start", "end", "label", "ordinal"]
    return gold.select(*columns, F.lit("g").alias("side")).unionByName(pred.select(*columns, F.lit("p").alias("side")))


def exact_matches(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All mentions of both sides with exact: whether it is among the first k of its (start, end, label), k the smaller count of both sides."""
    return with_exact(gathered(sides, keys)).select(*keys, F.inline("mentions"))


def outcomes(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, label and the five counts for each record and label."""
    return outcomes_in_row(gathered(sides.select(*keys, "start", "end", "label", "ordinal", "side"), keys), keys)


def outcomes_in_row(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for records that hold their mentions as an array; each row is a record."""
    return outcomes_of(records, keys)


def aligned_records(gold: DataFrame, pred: DataFrame, number: str = "record_no") -> DataFrame:
    """Records of both sides with the same number; the longer side's surplus is cut off."""
    g = gold.select(number, F.struct(*[c for c in gold.columns if c != number]).alias("gold"))
    p = pred.select(number, F.struct(*[c for c in pred.columns if c != number]).alias("pred"))
    return g.join(p, number)


def unaligned_records(gold: DataFrame, pred: DataFrame, number: str = "record_no") -> DataFrame:
    """Numbers that only one side has, for strict callers."""
    g, p = gold.select(number, F.lit(True).alias("in_gold")), pred.select(number, F.lit(True).alias("in_pred"))
    out = g.join(p, number, "full_outer")
    return out.select(number, F.coalesce("in_gold", F.lit(False)).alias("in_gold"), F.coalesce("in_pred", F.lit(False)).alias("in_pred")).filter(~(F.col("in_gold") & F.col("in_pred")))
