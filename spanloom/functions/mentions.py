"""Mentions beside their record, matched and flagged within the row, over Arrow batches.

A record is a row with an array of its mentions. All mentions of a slice of records are sorted together, and groups are read off the edges of the sorted
columns, so a record stays where it was read: nothing is shuffled, and no mention becomes a row of its own. A step works on one slice of records; where
the records are made over Arrow batches too, it runs in that pass, so that only its rows or sums leave the worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from spanloom.functions.tiling import _fields_with, _int, _replaced, _rows_of, _schema, _slices

GOLD, PRED = 0, 1
COUNTS = ("correct", "partial", "incorrect", "missed", "spurious")
#: Where a null start or end stands: behind and before all others, so that it overlaps nothing.
FAR = 1 << 33


def gathered(rows: DataFrame, keys: Sequence[str], into: str = "mentions") -> DataFrame:
    """keys and the rows of each record as an array of structs: one shuffle by the record keys."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])).alias(into))


def _order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns of whole numbers, the first one foremost; equal rows keep theirs.

    Columns are packed into one number, or as few as hold 63 bits each: mentions nearly stand in order as they come, and one stable sort finds that where a sort for
    each column, the last one first, undoes it.
    """
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    packed, bits = [], 0
    for c in columns:
        low = int(c.min())
        width = (int(c.max()) - low).bit_length()
        if not packed or width + bits > 63:
            packed.append(c - low if width < 64 else c)
            bits = width
        else:
            packed[-1] = (packed[-1] << width) | (c - low)
            bits += width
    return np.argsort(packed[0], kind="stable") if len(packed) == 1 else np.lexsort(packed[::-1])


class _Mentions:
    """The mentions of some records as columns of whole numbers; a label is its place among the sorted labels, null is -1."""

    def __init__(self, lists: pa.Array):
        flat = lists.flatten()
        number = lambda name, null: pc.fill_null(flat.field(name).cast(pa.int64()), null).to_numpy(zero_copy_only=False)
        self.rec = _rows_of(lists)[1]
        names = [f.name for f in flat.type]
        self.start, self.end = number("start", FAR), number("end", -FAR)
        self.ordinal = number("ordinal", -1) if "ordinal" in names else np.zeros(len(self.rec), np.int64)
        coded = flat.field("label").dictionary_encode()
        self.labels = coded.dictionary
        place = np.zeros(len(self.labels) + 1, dtype=np.int64)
        order = pc.sort_indices(self.labels).to_numpy()
        place[order] = np.arange(len(order))
        place[-1] = -1
        self.labels = self.labels.take(pa.array(order))
        self.label = place[pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)]
        self.side = np.where(pc.fill_null(pc.equal(flat.field("side"), "p"), False).to_numpy(zero_copy_only=False), PRED, GOLD) if "side" in names else np.zeros(len(self.rec), np.int64)
        # Record and start, and end and label, as one number each: fewer columns to compare.
        self.place, self.what = (self.rec << 35) + self.start, (self.end << len(self.labels).bit_length()) + self.label + 1
        self.length = self.end - self.start

    # Orders of all mentions; those of some are read off them, so that several runs need no sort of their own.

    @cached_property
    def by_span(self) -> np.ndarray:
        return _order(self.rec, self.start, self.length, self.label, self.side, self.ordinal)

    @cached_property
    def by_side(self) -> np.ndarray:
        return _order(self.rec, self.start, self.length, self.side, self.label, self.ordinal)

    @cached_property
    def by_label(self) -> np.ndarray:
        return _order(self.rec, self.label, self.start, self.ordinal, self.end)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _grouped(m: _Mentions, by: np.ndarray, *group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where in by each group begins, and its mentions of either side; by is in order of group."""
    first = np.flatnonzero(_edges(*[c[by] for c in group]))
    preds = np.add.reduceat(m.side[by], first) if len(first) else first
    return first, np.diff(np.append(first, len(by))) - preds, preds


def _paired(m: _Mentions, by: np.ndarray, *group: np.ndarray) -> np.ndarray:
    """Whether each mention is at by and among the first k of its side of its group, k the smaller count of both sides; by is in order of group and side."""
    first, golds, preds = _grouped(m, by, *group)
    number, side = np.repeat(np.arange(len(first)), golds + preds), m.side[by]
    nth = np.arange(len(by)) - first[number] - np.where(side == PRED, golds[number], 0)
    out = np.zeros(len(m.rec), dtype=bool)
    out[by] = nth < np.minimum(golds, preds)[number]
    return out


def _those(by: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    return by if own is None else by[own[by]]


def _exact(m: _Mentions, own: np.ndarray | None = None) -> np.ndarray:
    return _paired(m, _those(m.by_span, own), m.place, m.what)


def _overlapping(m: _Mentions, left: np.ndarray) -> np.ndarray:
    """Which of the mentions left over are matched by overlap within their label.

    Mentions that reach each other form runs. In one of a reference mention and a prediction there is nothing to choose; longer ones are gone through in order.
    """
    by = _those(m.by_label, left)
    start, end, side = m.start[by], m.end[by], m.side[by]
    label = _edges(m.rec[by], m.label[by])
    reach = np.maximum.accumulate((np.cumsum(label) << 36) + end) if len(by) else end
    begin = label.copy()
    begin[1:] |= (np.cumsum(label)[1:] << 36) + start[1:] >= reach[:-1]
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, len(by)))
    preds = np.add.reduceat(side, first) if len(first) else size
    hit = np.zeros(len(by), dtype=bool)
    two = first[(size == 2) & (preds == 1)]
    meet = two[(start[two] < end[two + 1]) & (start[two + 1] < end[two])]
    hit[meet] = hit[meet + 1] = True
    for a, n in zip(*(x[(size > 2) & (preds > 0) & (preds < size)].tolist() for x in (first, size)), strict=True):
        run = range(a, a + n)
        free = sorted((i for i in run if side[i] == PRED), key=lambda i: (end[i] - start[i], start[i], m.ordinal[by[i]], end[i]))
        for g in run:
            if side[g] == GOLD:
                best = next((i for i in free if start[i] < end[g] and start[g] < end[i]), None)
                if best is not None:
                    free.remove(best)
                    hit[g] = hit[best] = True
    out = np.zeros(len(m.rec), dtype=bool)
    out[by] = hit
    return out


def _matched(m: _Mentions) -> list[np.ndarray]:
    """Which mentions count as each of the five outcomes."""
    exact = _exact(m)
    overlap = _overlapping(m, ~exact)
    wrong = _paired(m, _those(m.by_side, ~exact & ~overlap), m.place, m.end)
    rest, gold = ~exact & ~overlap & ~wrong, m.side == GOLD
    return [exact & gold, overlap & gold, wrong & gold, rest & gold, rest & ~gold]


def _by_label(m: _Mentions, keys: dict[str, pa.Array], group: np.ndarray, label: np.ndarray, counts: dict[str, np.ndarray]) -> pa.RecordBatch:
    """keys, label and counts of groups; a label is its place and one more, 0 for null."""
    named = m.labels.take(pa.array(label - 1, mask=label == 0))
    return pa.RecordBatch.from_arrays([*(k.take(pa.array(group)) for k in keys.values()), named, *(pa.array(c.astype(np.int64)) for c in counts.values())], names=[*keys, "label", *counts])


# --- steps: what is made of a slice of records, here or in the pass that makes them --------------------------------------


def exact_in(part: pa.RecordBatch, mentions: str = "mentions") -> pa.RecordBatch:
    """The slice; its mentions (start, end, label, ordinal, side) have exact: whether one is among the first k of its (start, end, label), k the smaller count of both sides."""
    lists = part.column(mentions)
    return _replaced(part, **{mentions: _fields_with(lists, exact=pa.array(_exact(_Mentions(lists))))})


SUMS = "label string, " + ", ".join(f"{c} bigint" for c in COUNTS)
EXACT_SUMS = "label string, side string, matched bigint, mentions bigint"


def exact_sums_in(part: pa.RecordBatch, mentions: str = "mentions") -> pa.RecordBatch:
    """label, side, matched and mentions, added up over the slice: for each label of each side how many mentions there are, and how many of them are exact.

    Of the copies of a mention as many are exact on each side as the other side lets, so they are counted and not marked.
    """
    m = _Mentions(part.column(mentions))
    first, golds, preds = _grouped(m, m.by_span, m.place, m.what)
    n, matched = np.bincount(m.label * 2 + 2 + m.side), np.bincount(m.label[m.by_span[first]] + 1, np.minimum(golds, preds))
    some = np.flatnonzero(n)
    out = _by_label(m, {}, some, some // 2, {"matched": matched[some // 2], "mentions": n[some]})
    return pa.RecordBatch.from_arrays([out.column(0), pa.array(["g", "p"]).take(pa.array(some % 2)), out.column(1), out.column(2)], names=["label", "side", "matched", "mentions"])


def outcomes_in(part: pa.RecordBatch, keys: Sequence[str], mentions: str = "mentions") -> pa.RecordBatch:
    """keys, label and the five counts for each label that either side of a record has."""
    m = _Mentions(part.column(mentions))
    wide = len(m.labels) + 1
    group, number = np.unique(m.rec * wide + m.label + 1, return_inverse=True)
    counts = {c: np.bincount(number[x], minlength=len(group)) for c, x in zip(COUNTS, _matched(m), strict=True)}
    return _by_label(m, {k: part.column(k) for k in keys}, group // wide, group % wide, counts)


def outcome_sums_in(part: pa.RecordBatch, mentions: str = "mentions") -> pa.RecordBatch:
    """label and the five counts, added up over the slice, for each label that either side has."""
    m = _Mentions(part.column(mentions))
    some = np.unique(m.label) + 1
    counts = {c: np.bincount(m.label[x] + 1, minlength=len(m.labels) + 1)[some] for c, x in zip(COUNTS, _matched(m), strict=True)}
    return _by_label(m, {}, some, some, counts)


RUN_SUMS = "run int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def run_sums_in(part: pa.RecordBatch, runs: Sequence[Callable[[np.ndarray], np.ndarray]], mentions: str = "mentions") -> pa.RecordBatch:
    """run (from 0) and the five counts, added up over the slice, for several runs of predictions against one reference: each says by their ordinals which predictions it has.

    The mentions are read and sorted once for all runs. How many labels of a span are wrong is the smaller count of both sides there; which ones makes no difference to sums over all labels.
    """
    m = _Mentions(part.column(mentions))
    gold, sums = m.side == GOLD, []
    for run in runs:
        own = gold | run(m.ordinal)
        exact = _exact(m, own)
        overlap = _overlapping(m, own & ~exact)
        rest = own & ~exact & ~overlap
        wrong = np.minimum(*_grouped(m, _those(m.by_span, rest), m.place, m.end)[1:]).sum()
        sums.append([(exact & gold).sum(), (overlap & gold).sum(), wrong, (rest & gold).sum() - wrong, (rest & ~gold).sum() - wrong])
    sums = np.array(sums, dtype=np.int64).reshape(-1, len(COUNTS))
    return pa.RecordBatch.from_arrays([_int(np.arange(len(sums))), *map(pa.array, sums.T)], names=["run", *COUNTS])


def _flags(m: _Mentions, of: np.ndarray) -> dict[str, np.ndarray]:
    """same_span, nested and flat of the mentions at of, among themselves; those of all others are false.

    In order of start, longest first, a span lies inside an earlier one exactly if the furthest end so far reaches its end; the first mention of a span asks for all of them.
    """
    by = of[_order(m.rec[of], m.start[of], -m.length[of], m.label[of])]
    rec, start, end, label = m.rec[by], m.start[by], m.end[by], m.label[by]
    first = np.flatnonzero(_edges(rec, start, end)) if len(by) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(by)))
    known = np.where(label < 0, len(m.labels), label)
    lowest, highest = (f.reduceat(x, first) if len(first) else first for f, x in ((np.minimum, known), (np.maximum, label)))
    several = (lowest < highest) & (highest >= 0)
    reach = np.maximum.accumulate((rec << 36) + end) if len(by) else end
    inside = np.zeros(len(first), dtype=bool)
    inside[1:] = (rec[first[1:]] == rec[first[1:] - 1]) & (reach[first[1:] - 1] >= (rec[first[1:]] << 36) + end[first[1:]])
    inside &= end[first] > -FAR
    same, nested, flat = (np.zeros(len(m.rec), dtype=bool) for _ in range(3))
    same[by], nested[by], flat[by] = np.repeat(several, size), np.repeat(inside, size), np.repeat(~several & ~inside, size)
    return {"same_span": same, "nested": nested, "flat": flat}


def structure_in(part: pa.RecordBatch, mentions: str = "mentions") -> pa.RecordBatch:
    """The slice; its mentions (start, end, label) have same_span (another label on the same span), nested (strictly inside another) and flat (neither)."""
    lists = part.column(mentions)
    m = _Mentions(lists)
    return _replaced(part, **{mentions: _fields_with(lists, **{name: pa.array(x) for name, x in _flags(m, np.arange(len(m.rec))).items()})})


STRUCTURE = "mentions bigint, same_span bigint, nested bigint, flat bigint, labels array<string>"


def structure_counts_in(part: pa.RecordBatch, keys: Sequence[str], mentions: str = "mentions") -> pa.RecordBatch:
    """keys, how many mentions a record has and how many with each flag, and its distinct labels in order, null last."""
    m = _Mentions(part.column(mentions))
    counts = {"mentions": np.bincount(m.rec, minlength=part.num_rows), **{name: np.bincount(m.rec[x], minlength=part.num_rows) for name, x in _flags(m, np.arange(len(m.rec))).items()}}
    wide = len(m.labels) + 1
    held = np.unique(m.rec * wide + np.where(m.label < 0, len(m.labels), m.label))
    labels = m.labels.take(pa.array(held % wide, mask=held % wide == len(m.labels)))
    offsets = np.searchsorted(held // wide, np.arange(part.num_rows + 1)).astype(np.int32)
    names = ["mentions", "same_span", "nested", "flat"]
    return pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(counts[n].astype(np.int64)) for n in names), pa.ListArray.from_arrays(pa.array(offsets), labels)], names=[*keys, *names, "labels"])


KINDS = ("flat", "nested", "same_span")
RECOVERY_SUMS = "kind string, mentions bigint, matched bigint"


def recovery_sums_in(part: pa.RecordBatch, mentions: str = "mentions") -> pa.RecordBatch:
    """kind, mentions and matched, added up over the slice: how many reference mentions (start, end, label, ordinal, side) have each flag of their structure, and how many of them are exact.

    Copies of a mention have the same flags, and as many of them are exact as the other side lets, so one of each is flagged and none is marked.
    """
    m = _Mentions(part.column(mentions))
    first, golds, preds = _grouped(m, m.by_span, m.place, m.what)
    some = np.flatnonzero(golds)
    of, golds, matched = m.by_span[first[some]], golds[some], np.minimum(golds, preds)[some]
    flags = _flags(m, of)
    having = [flags[kind][of] for kind in KINDS]
    return pa.RecordBatch.from_arrays([pa.array(KINDS), *(pa.array([int(n[x].sum()) for x in having], pa.int64()) for n in (golds, matched))], names=["kind", "mentions", "matched"])


# --- the same over tables --------------------------------------------------------------------------------------------


def _in_slices(records: DataFrame, mentions: str, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(step, _slices(batch, mentions))

    return records.mapInArrow(run, schema)


def _flagged(records: DataFrame, mentions: str, *flags: str) -> StructType:
    old = [f for f in records.schema[mentions].dataType.elementType if f.name not in flags]
    return _schema(records, **{mentions: ArrayType(StructType([*old, *(StructField(name, BooleanType()) for name in flags)]))})


def with_exact(records: DataFrame, mentions: str = "mentions") -> DataFrame:
    """records whose mentions have exact, as in exact_in()."""
    return _in_slices(records, mentions, lambda part: exact_in(part, mentions), _flagged(records, mentions, "exact"))


def outcomes_of(records: DataFrame, keys: Sequence[str], mentions: str = "mentions") -> DataFrame:
    """keys, label and the five counts, one row for each label that either side of a record has. Keys may stand in several rows, each a record of its own."""
    own, keys = records.select(*keys, mentions), list(keys)
    schema = StructType([*(own.schema[k] for k in keys), *StructType.fromDDL(SUMS)])
    return _in_slices(own, mentions, lambda part: outcomes_in(part, keys, mentions), schema)


def with_structure(records: DataFrame, mentions: str = "mentions") -> DataFrame:
    """records whose mentions have the flags of structure_in()."""
    return _in_slices(records, mentions, lambda part: structure_in(part, mentions), _flagged(records, mentions, "same_span", "nested", "flat"))


def recovery_sums(records: DataFrame, mentions: str = "mentions") -> DataFrame:
    """kind, mentions and matched of recovery_sums_in(), in parts that add up."""
    return _in_slices(records.select(mentions), mentions, lambda part: recovery_sums_in(part, mentions), RECOVERY_SUMS)
