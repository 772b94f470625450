"""Decoding word-pair grids into entities, and sweeping decision thresholds in one job.

A grid is a sparse table (keys, row, col, channel, score). Channel 1 links a token to the next token of an entity; channels from 2 on mark the tail and head
of an entity of that type. Entities are all chains head = i0 < ... < ik = tail of links whose tail and head are marked; scores must exceed their thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.mentions import gathered
from spanloom.functions.text import count_scores
from spanloom.operators.matching import COUNTS, outcomes_in_row
from spanloom.operators.metrics import with_scores

NEXT = 1


def _by_record(grid: DataFrame, keys: Sequence[str], next_threshold, head_threshold) -> DataFrame:
    """keys, links array<struct<from, to, score>> and marks array<struct<head, tail, type, score>> that pass, by one shuffle over the record keys.

    A cell that stands in the grid more than once counts with its highest score.
    """
    score, channel = F.col("score").cast("double"), F.col("channel")
    link, mark = (channel == NEXT) & (F.col("row") < F.col("col")) & (score > next_threshold), (channel > NEXT) & (F.col("col") <= F.col("row")) & (score > head_threshold)
    own = grid.filter(link | mark).repartition(*keys).groupBy(*keys, "row", "col", "channel").agg(F.max(score).alias("score"))
    return own.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(channel == NEXT, F.struct(F.col("row").alias("from"), F.col("col").alias("to"), "score")))).alias("links"),
        F.collect_list(F.when(channel > NEXT, F.struct(F.col("col").alias("head"), F.col("row").alias("tail"), channel.alias("type"), "score"))).alias("marks"),
    )


def chains(grid: DataFrame, keys: Sequence[str], next_threshold, head_threshold) -> DataFrame:
    """keys, index array<int>, type, link_score and head_score: the distinct entities with the lowest score of their links (infinite for one token) and that of their mark.

    This lists every chain, and their number can grow exponentially with the length of a span; entity_counts() and sweep() count without it. Chains grow from the head, each only
    within the span of a marked (tail, head) and only over links from which the tail can still be reached, so no dead end is carried on. The number of steps is the
    number of tokens in the span. All of it happens in the row of the record.
    """
    keys = list(keys)
    spans = _by_record(grid, keys, next_threshold, head_threshold).select(
        *keys, "links", "marks", F.explode(F.array_distinct(F.transform("marks", lambda m: F.struct(m["head"].alias("head"), m["tail"].alias("tail"))))).alias("span")
    )
    inside = F.filter("links", lambda e: (e["from"] >= F.col("span.head")) & (e["to"] <= F.col("span.tail")))
    own = F.filter("marks", lambda m: (m["head"] == F.col("span.head")) & (m["tail"] == F.col("span.tail")))
    start = spans.select(*keys, "span.head", "span.tail", inside.alias("links"), own.alias("marks"))
    # Links that can reach the tail: the set of such tokens grows backwards by one sweep over descending tokens.
    reach = F.aggregate(
        F.reverse("links"),
        F.array("tail"),
        lambda seen, e: F.when(F.array_contains(seen, e["to"]), F.array_union(seen, F.array(e["from"]))).otherwise(seen),
    )
    useful = start.withColumn("reach", reach).withColumn("links", F.filter("links", lambda e: F.array_contains("reach", e["to"])))
    last = lambda c: F.element_at(c["index"], -1)
    longer = lambda c, e: F.struct(F.concat(c["index"], F.array(e["to"])).alias("index"), F.least(c["low"], e["score"]).alias("low"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.col("tail") - F.col("head") + 1),
        F.struct(F.array(F.struct(F.array("head").alias("index"), F.lit(float("inf")).alias("low"))).alias("open"), F.array().cast("array<struct<index:array<int>,low:double>>").alias("done")),
        lambda s, _: F.struct(
            F.flatten(F.transform(F.filter(s["open"], lambda c: last(c) != F.col("tail")), lambda c: F.transform(F.filter("links", lambda e: e["from"] == last(c)), lambda e: longer(c, e)))).alias("open"),
            F.concat(s["done"], F.filter(s["open"], lambda c: last(c) == F.col("tail"))).alias("done"),
        ),
    )
    found = useful.select(*keys, "marks", F.explode(grown["done"]).alias("c")).select(*keys, F.col("c.index").alias("index"), F.col("c.low").alias("link_score"), F.explode("marks").alias("m"))
    return found.select(*keys, "index", F.col("m.type").alias("type"), "link_score", F.col("m.score").alias("head_score"))


def decode(grid: DataFrame, keys: Sequence[str], next_threshold, head_threshold) -> DataFrame:
    """keys, index array<int>, type: the distinct entities."""
    return chains(grid, keys, next_threshold, head_threshold).select(*keys, "index", "type")


# --- counting without listing ------------------------------------------------------------------------------------------

#: What a count of chains between one head and one tail is held at; below it counts are exact.
MOST = 1 << 53
#: Grid cells of records that are counted at once.
TILE = 1 << 20


def path_counts(link: np.ndarray, threshold: float) -> np.ndarray:
    """For grids (records x n x n) of link scores, upwards only: the number of chains from each token to each, over links above a threshold; at most MOST."""
    n = link.shape[1]
    passing, out = (link > threshold).astype(np.float64), np.zeros(link.shape)
    for j in range(n):
        out[:, :, j] = np.minimum(np.matmul(out[:, :, :j], passing[:, :j, j, None])[:, :, 0], MOST)
        out[:, j, j] = 1
    return out.astype(np.int64)


def match_cells(golds: Sequence[tuple], preds: Sequence[tuple], counts: np.ndarray) -> np.ndarray:
    """The five counts (rows) of one record in every cell (columns), by the rules of matching.outcomes(), for all cells side by side.

    golds: (start, end, label) in order of (start, ordinal). preds: different (start, end, label). counts: how often each prediction stands in each cell; they are used up.
    Copies of a prediction are alike, so numbers do for them.
    """
    at = {p: i for i, p in enumerate(preds)}
    left = [np.ones(counts.shape[1], dtype=bool) for _ in golds]

    def take(i: int, which: int) -> np.ndarray:
        hit = left[i] & (counts[which] > 0)
        counts[which] -= hit
        left[i] = left[i] & ~hit
        return hit

    totals = np.zeros((len(COUNTS), counts.shape[1]), dtype=np.int64)
    for i, g in enumerate(golds):
        if g in at:
            totals[0] += take(i, at[g])
    shortest = sorted(range(len(preds)), key=lambda m: (preds[m][1] - preds[m][0], preds[m][0]))
    for i, (start, end, label) in enumerate(golds):
        for which in shortest:
            if preds[which][2] == label and preds[which][0] < end and start < preds[which][1]:
                totals[1] += take(i, which)
    for span in {g[:2] for g in golds}:
        missing = sum(left[i].astype(np.int64) for i, g in enumerate(golds) if g[:2] == span)
        totals[2] += np.minimum(missing, sum((counts[m] for m, p in enumerate(preds) if p[:2] == span), np.zeros_like(missing)))
    totals[3] = sum((x.astype(np.int64) for x in left), np.zeros(counts.shape[1], np.int64)) - totals[2]
    totals[4] = counts.sum(0) - totals[2]
    return totals


ENTITY_COUNTS = ("same_entities", "predicted", "relevant")


class _Cells:
    """The cells of a sweep, and the sums over records of what each lets pass."""

    def __init__(self, cells: Sequence[tuple[int, float, float]], matched: bool):
        self.matched = matched
        self.number, self.heads = [c[0] for c in cells], np.array([c[2] for c in cells])
        self.levels, self.level = np.unique([c[1] for c in cells], return_inverse=True)
        self.next = np.array([c[1] for c in cells])
        self.sums = np.zeros((len(COUNTS) + len(ENTITY_COUNTS), len(cells)), dtype=object)

    def add(self, entries: pa.Array, golds: list) -> None:
        """entries: the lists (channel, row, col, score) of records; golds: their lists of (index, type), or None."""
        size = entries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = entries.flatten()
        rec = np.repeat(np.arange(len(size)), size)
        channel, row, col = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("channel", "row", "col"))
        score = flat.field("score").to_numpy(zero_copy_only=False)
        tokens = np.array([max((t + 1 for g in own or () for t in g["index"]), default=1) for own in golds], dtype=np.int64)
        np.maximum.at(tokens, rec, np.maximum(row, col) + 1)
        for n in np.unique(tokens).tolist():
            records = np.flatnonzero(tokens == n)
            for part in np.split(records, range(max(1, TILE // n**2), len(records), max(1, TILE // n**2))):
                own = np.isin(rec, part)
                self._tile(n, [golds[i] or [] for i in part.tolist()], np.searchsorted(part, rec[own]), channel[own], row[own], col[own], score[own])

    def _tile(self, n: int, golds: list, rec: np.ndarray, channel: np.ndarray, row: np.ndarray, col: np.ndarray, score: np.ndarray) -> None:
        link = np.full((len(golds), n, n), -np.inf)
        up = (channel == NEXT) & (row < col)
        np.maximum.at(link, (rec[up], row[up], col[up]), score[up])
        down = (channel > NEXT) & (col <= row)
        place, where = np.unique(np.stack([rec[down], col[down], row[down], channel[down]], axis=1), axis=0, return_inverse=True)
        best = np.full(len(place), -np.inf)
        np.maximum.at(best, where.reshape(-1), score[down])
        paths = np.stack([path_counts(link, t)[place[:, 0], place[:, 1], place[:, 2]] for t in self.levels], axis=1)
        counts = paths[:, self.level] * (best[:, None] > self.heads)
        if len(counts):
            self.sums[len(COUNTS) + 1] += (counts if int(counts.max()) * len(counts) < 1 << 62 else counts.astype(object)).sum(0)
        bounds = np.searchsorted(place[:, 0], np.arange(len(golds) + 1)).tolist()
        for i, own in enumerate(golds):
            a, b = bounds[i], bounds[i + 1]
            entities = sorted({(tuple(g["index"]), g["type"]) for g in own})
            marked = {tuple(p): m for p, m in zip(place[a:b, 1:].tolist(), range(a, b))}
            for index, kind in entities:
                m = marked.get((index[0], index[-1], kind))
                weakest = min((link[i, x, y] for x, y in zip(index, index[1:])), default=np.inf)
                if m is not None:
                    self.sums[len(COUNTS)] += (weakest > self.next) & (best[m] > self.heads)
            self.sums[len(COUNTS) + 2] += len(entities)
            if self.matched:
                mentions = [(index[0], index[-1] + 1, kind) for index, kind in entities]
                mentions.sort(key=lambda g: g[0])  # the order of the entities stays among equal starts
                found = [(h, t + 1, c) for h, t, c in place[a:b, 1:].tolist()]
                self.sums[: len(COUNTS)] += match_cells(mentions, found, counts[a:b].copy())

    def batch(self) -> pa.RecordBatch:
        limit = np.iinfo(np.int64).max
        names = [*COUNTS, *ENTITY_COUNTS]
        return pa.RecordBatch.from_arrays([pa.array(self.number, pa.int32()), *(pa.array([min(int(x), limit) for x in line], pa.int64()) for line in self.sums)], names=["cell", *names])


def cell_counts(grid: DataFrame, gold: DataFrame, cells: Sequence[tuple[int, float, float]], keys: Sequence[str], matched: bool = True) -> DataFrame:
    """cell, the five counts (matched), same_entities, predicted and relevant, for cells (number, next threshold, head threshold) of any number, in one pass over the records.

    Nothing is listed. The chains between a head and a tail are counted by adding up those to each token before it, once for each different next threshold; a reference entity is
    predicted where its weakest link and its mark pass; and mentions are matched with the number of their copies. Time is polynomial in the tokens of a record.
    A record's grid and its reference are one row each; a task sends on one row for each cell.
    """
    keys = list(keys)
    lowest = [min((c[i] for c in cells), default=0.0) for i in (1, 2)]
    score, channel = F.col("score").cast("double"), F.col("channel").cast("int")
    useful = grid.filter(((channel == NEXT) & (F.col("row") < F.col("col")) & (score > lowest[0])) | ((channel > NEXT) & (F.col("col") <= F.col("row")) & (score > lowest[1])))
    entries = useful.groupBy(*keys).agg(F.collect_list(F.struct(channel.alias("channel"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), score.alias("score"))).alias("entries"))
    true = gold.groupBy(*keys).agg(F.collect_list(F.struct("index", "type")).alias("golds"))
    cells = list(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Cells(cells, matched)
        for batch in batches:
            held.add(batch.column("entries"), batch.column("golds").to_pylist())
        yield held.batch()

    names = [*COUNTS, *ENTITY_COUNTS]
    parts = entries.join(true, keys, "full_outer").select("entries", "golds").mapInArrow(run, "cell int, " + ", ".join(f"{n} long" for n in names))
    limit = F.lit((1 << 63) - 1)
    return parts.groupBy("cell").agg(*[F.least(F.sum(F.col(n).cast("decimal(19,0)")), limit).cast("long").alias(n) for n in names])


def entity_counts(grid: DataFrame, gold: DataFrame, keys: Sequence[str], next_threshold: float, head_threshold: float) -> DataFrame:
    """One row: correct, predicted (distinct), relevant (distinct) entities, and their precision, recall and f1, counted and not listed."""
    found = cell_counts(grid, gold, [(0, next_threshold, head_threshold)], keys, matched=False)
    whole = found.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(to) for n, to in zip(ENTITY_COUNTS, ("correct", "predicted", "relevant"), strict=True)])
    return whole.select("*", *[v.alias(k) for k, v in count_scores(F.col("correct"), F.col("predicted"), F.col("relevant")).items()])


def threshold_grid(spark, first: Sequence[float], second: Sequence[float], names: tuple[str, str] = ("next_threshold", "head_threshold")) -> DataFrame:
    """cell (from 0, in order) and two thresholds, for all pairs."""
    pairs = [(i, float(a), float(b)) for i, (a, b) in enumerate((a, b) for a in first for b in second)]
    return spark.createDataFrame(pairs, f"cell int, {names[0]} double, {names[1]} double")


def _scored_cells(cells: DataFrame, outcomes_: DataFrame) -> DataFrame:
    """cells with the five counts and the scores of the shared evaluator; a cell without mentions has zeros."""
    counts = outcomes_.groupBy("cell").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return with_scores(cells.join(counts, "cell", "left").na.fill(0, list(COUNTS)))


def sweep(grid: DataFrame, gold: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cell, thresholds, counts of decoded entities and the scores of every cell, from one read of the grid. Cells are a small list.

    The entities of a cell are matched to the reference one by one: an entity's span is that from its first to its last token, its label the type.
    """
    listed = [tuple(r) for r in cells.select("cell", "next_threshold", "head_threshold").collect()]
    counts = cell_counts(grid, gold, listed, keys)
    return with_scores(cells.join(F.broadcast(counts), "cell", "left").na.fill(0, [*COUNTS, *ENTITY_COUNTS]))


def flat_sweep(gold: DataFrame, pred: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cell, thresholds, counts and scores: predicted mentions (with logit and prob) whose scores exceed both thresholds of a cell, against the reference.

    Mentions are gathered by record once; each record is then matched in every cell where it is, and what goes on is a row for each cell and task.
    """
    mention = lambda df, side, *scores: df.select(*keys, "start", "end", "label", "ordinal", F.lit(side).alias("side"), *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in scores])
    records = gathered(mention(gold.drop("logit", "prob"), "g", "logit", "prob").unionByName(mention(pred, "p", "logit", "prob")), keys)
    passing = F.filter("mentions", lambda m: (m["side"] == "g") | ((m["logit"] > F.col("logit_threshold")) & (m["prob"] > F.col("prob_threshold"))))
    own = F.transform(passing, lambda m: F.struct(*[m[c].alias(c) for c in ("start", "end", "label", "ordinal", "side")]))
    return _scored_cells(cells, outcomes_in_row(records.join(F.broadcast(cells)).select("cell", own.alias("mentions")), ["cell"]))
