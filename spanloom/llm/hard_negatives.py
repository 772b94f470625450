"""Hard-negative mining with early discarding in a PCA rotation.

1. Rotation: the eigenvectors of the second moments of a bounded sample (SAMPLE rows at most, products are taken about the origin, so moments are too)
   turn every vector so that leading components hold most of it. It is orthogonal, so inner products stay what they are. Every row is searched.
2. A pair's product is that of its leading components plus a rest, and the rest is at most the product of both residual norms. With the slack for
   rounding this bounds the pair from both sides; pairs that cannot come among the first, or lie above every positive, are dropped after an eighth, a quarter
   and a half of the components. First whole tiles are summed, and single pairs once few are left.
3. What survives is verified by the integer product of the unrotated vectors. Only that score counts, so the result is exact.

Anchors go out in blocks (ANCHOR_BYTES of vectors each), each block against all rows, which stay where they are: no row is shuffled. A block's rows come in waves,
the first of some SAMPLE rows and each later one GROWTH times all before, drawn by a hash. The k-th scores of one wave are the thresholds of the next, so that a task sends on only
what beats them, and what is sent grows with the number of waves and not with that of tasks. First all waves look for positives, then, with the positives'
scores as roofs, all waves look for negatives. The driver sees one block of anchors and its thresholds at a time.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; vectors of different lengths are never
compared; a row with the anchor's own id is neither its positive nor its negative; an anchor id on several rows is one anchor, with its smallest (label, vector);
other repeated rows all count; ties go to the smaller id; products beyond 64 bits are held at the limits of long; an anchor without a row of
its label, or a positive without a row in range, has no row in the result; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import dropped, written
from spanloom.llm.vectors import by_length, finite, floors

ANCHOR_BYTES, SAMPLE, SAMPLE_BYTES, GROWTH = 16 << 20, 16384, 64 << 20, 8
#: Anchors and rows of a tile, and pairs whose components are gathered at once.
TILE_ANCHORS, TILE_ROWS, PAIRS = 1024, 4096, 1 << 15
#: A tile is summed whole while more than this share of its pairs is left.
DENSE = 1 / 16
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns are the eigenvectors of the sample's second moments, by falling eigenvalue."""
    x = sample.astype(np.float64)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def steps(dim: int) -> list[int]:
    """Numbers of leading components after which pairs are dropped; the last is all of them."""
    return sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2), dim} if dim else {0})


class Rotated:
    """Integer vectors with their rotation and the norm of what lies beyond each step."""

    def __init__(self, v: np.ndarray, turn: np.ndarray | None):
        self.v, self.x = v, v.astype(np.float64) if turn is None else v.astype(np.float64) @ turn
        squares = np.cumsum((self.x**2)[:, ::-1], axis=1)[:, ::-1]
        whole = squares[:, 0] if v.shape[1] else np.zeros(len(v))
        self.norm = np.sqrt(whole)
        self.rest = np.stack([np.sqrt(squares[:, m]) if m < v.shape[1] else np.zeros(len(v)) for m in steps(v.shape[1])], axis=1)

    def rows(self, at) -> "Rotated":
        out = object.__new__(Rotated)
        out.v, out.x, out.norm, out.rest = self.v[at], self.x[at], self.norm[at], self.rest[at]
        return out


def slack(dim: int) -> float:
    """Rounding of a rotated product, as a share of the product of both norms: the rotation, both sums and the norms, each with dim terms."""
    return 32.0 * (dim + 1) ** 2 * 2.0**-52


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer products of rows in pairs, held at the limits of long (the lowest is kept free)."""
    high = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0.0))
    if high(q) * high(v) * max(1, q.shape[1]) < 2.0**62:
        return np.einsum("ij,ij->i", q, v)
    return np.array([min(max(int(s), _NONE + 1), _LAST) for s in (q.astype(object) * v.astype(object)).sum(1)], dtype=np.int64)


def survivors(q: Rotated, v: Rotated, allowed: np.ndarray, floor: np.ndarray, roof: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) among those allowed whose product may lie between the anchor's floor and roof."""
    dim = q.v.shape[1]
    error = slack(dim)
    tile, keep, done, pairs = np.zeros(allowed.shape), allowed, 0, None
    for i, m in enumerate(steps(dim)):
        if pairs is None and keep.mean() <= DENSE:
            a, r = np.nonzero(keep)
            pairs = a, r, tile[a, r]
        if pairs is None:
            tile += q.x[:, done:m] @ v.x[:, done:m].T
            rest = np.outer(q.rest[:, i] + error * q.norm, v.rest[:, i] + error * v.norm) + error * np.outer(q.norm, v.norm)
            keep = keep & (tile + rest >= floor[:, None]) & (tile - rest <= roof[:, None])
        else:
            kept = []
            for at in range(0, len(pairs[0]), PAIRS):
                a, r, p = (x[at : at + PAIRS] for x in pairs)
                p = p + np.einsum("ij,ij->i", q.x[a, done:m], v.x[r, done:m])
                rest = (q.rest[a, i] + error * q.norm[a]) * (v.rest[r, i] + error * v.norm[r]) + error * q.norm[a] * v.norm[r]
                good = (p + rest >= floor[a]) & (p - rest <= roof[a])
                kept.append((a[good], r[good], p[good]))
            pairs = tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else pairs
        done = m
    return (pairs[0], pairs[1]) if pairs is not None else np.nonzero(keep)


class Best:
    """The k highest scores of each slot, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.score, self.id = np.full((slots, k), _NONE), np.full((slots, k), _LAST)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        k, touched = self.score.shape[1], np.unique(slot)
        slot = np.concatenate([slot, np.repeat(touched, k)])
        score, ids = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < k
        self.score[slot[keep], rank[keep]], self.id[slot[keep], rank[keep]] = score[keep], ids[keep]


class Block:
    """One block of anchors, in order of id, and the state of its search: thresholds so far, and for negatives the positives' scores and lowest scores in range."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], turns: dict[int, np.ndarray], k: int):
        self.ids, self.labels, self.k = ids, labels, k
        sizes = np.array([len(v) for v in vectors])
        self.groups = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
        self.turns = turns
        self.vectors = {d: np.array([vectors[i] for i in rows], dtype=np.int64).reshape(len(rows), d) for d, rows in self.groups.items()}
        self.roofs = self.floors = None
        self.kth = np.full((len(ids), 1), _NONE)

    def for_negatives(self, score: np.ndarray, low: tuple[int, int], k: int) -> None:
        """score: the positives of each anchor, _NONE where there is none."""
        there = score != _NONE
        lowest = np.array([-(-int(s) * low[0] // low[1]) for s in score.ravel()], dtype=object).reshape(score.shape)
        self.roofs = np.where(there, score, _NONE)
        self.floors = np.where(there, np.minimum(lowest, _LAST), _LAST).astype(np.int64)
        self.kth, self.k = np.full(score.shape, _NONE), k


FOUND = "anchor_id long, ordinal int, vec_id long, score long"


def _scan(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first rows of each anchor (and positive) among a task's rows, as far as they reach the thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        n, wide = block.kth.shape
        best, negative = Best(n * wide, block.k), block.roofs is not None
        turned = {d: Rotated(v, block.turns.get(d)) for d, v in block.vectors.items()}
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            for rows, v in by_length(batch, "v"):
                if (dim := v.shape[1]) in block.groups:
                    for at in range(0, len(rows), TILE_ROWS):
                        own = rows[at : at + TILE_ROWS]
                        part = Rotated(v[at : at + TILE_ROWS], block.turns.get(dim))
                        for start in range(0, len(block.groups[dim]), TILE_ANCHORS):
                            places = block.groups[dim][start : start + TILE_ANCHORS]
                            _tile(block, best, negative, places, turned[dim].rows(slice(start, start + TILE_ANCHORS)), ids[own], labels[own], part)
        slot, place = np.nonzero(best.id < _LAST)
        columns = [pa.array(block.ids[slot // wide]), pa.array((slot % wide).astype(np.int32)), pa.array(best.id[slot, place]), pa.array(best.score[slot, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "ordinal", "vec_id", "score"])

    return run


def _tile(block: Block, best: Best, negative: bool, places: np.ndarray, q: Rotated, ids: np.ndarray, labels: np.ndarray, v: Rotated) -> None:
    wide = block.kth.shape[1]
    slots = places[:, None] * wide + np.arange(wide)
    reach = np.maximum(block.kth[places], best.score[slots, -1])  # what a row must reach to come among the first
    same = block.labels[places][:, None] == labels[None, :]
    allowed = (~same if negative else same) & (block.ids[places][:, None] != ids[None, :])
    if negative:
        reach = np.maximum(reach, block.floors[places])
        roof = block.roofs[places]
        open_ = reach <= roof
        a, r = survivors(q, v, allowed & open_.any(1)[:, None], np.where(open_, reach, _LAST).min(1).astype(float), np.where(open_, roof, _NONE).max(1).astype(float))
    else:
        a, r = survivors(q, v, allowed, reach[:, 0].astype(float), np.full(len(places), np.inf))
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], r[at : at + PAIRS]
        score = exact(q.v[x], v.v[y])
        for ordinal in range(wide):
            good = score >= reach[x, ordinal]
            if negative:
                good &= score <= roof[x, ordinal]
            best.add(slots[x[good], ordinal], score[good], ids[y[good]])


def mine(
    vectors: DataFrame, is_anchor: Callable, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), scale: int = 256, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components count as floor(scale * x). For each row for which is_anchor(id column) holds: its first positives of the same label (whole numbers), and
    for each of them the first rows of other labels that score from low[0]/low[1] of the positive's score up to it.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v")).filter("id is not null and label is not null")
    rows = finite(plain, "v").select("id", "label", floors(F.col("v"), scale).alias("v"))
    total, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    waves = 1 + max(0, ceil(log(max(total, 1) / SAMPLE, GROWTH)))
    part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) / float(1 << 40)
    wave = sum(((part >= float(GROWTH) ** -j).cast("int") for j in range(1, waves)), F.lit(0))
    base = written(rows.withColumn("wave", wave), "vectors", by=("wave",))
    fit = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * max(longest, 1))))
    sample = [np.asarray(v, np.int64) for v in base.filter("wave = 0").limit(fit).select("v").toPandas()["v"]]
    turns = {d: rotation(np.stack([v for v in sample if len(v) == d])) for d in {len(v) for v in sample} if d}

    anchors = base.filter(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    anchors = written(anchors, "anchors")
    held = anchors.agg(F.coalesce(F.sum(F.size("v") + 4), F.lit(0))).first()[0] * 8
    blocks, out = -(-held // ANCHOR_BYTES), []
    for number in range(blocks):
        own = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).orderBy("id").toPandas()  # one block
        if len(own):
            block = Block(own["id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), [np.asarray(v, np.int64) for v in own["v"]], turns, positives)
            first = _all_waves(base, waves, block, 1, positives)
            block.for_negatives(_scores(first, block, positives), low, negatives)
            second = _all_waves(base, waves, block, positives, negatives)
            named = first.select("anchor_id", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            hard = second.select("anchor_id", (F.col("ordinal") + 1).alias("positive"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            out.append(written(hard.join(named, ["anchor_id", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined"))
            dropped(first, second)
    dropped(base, anchors)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(out[0].schema).parquet(*[t.written_to for t in out])


def _all_waves(base: DataFrame, waves: int, block: Block, wide: int, k: int) -> DataFrame:
    """anchor_id, ordinal, vec_id, score, rank: the first k rows of each slot of a block."""
    spark, best = base.sparkSession, None
    rank = F.row_number().over(Window.partitionBy("anchor_id", "ordinal").orderBy(F.desc("score"), "vec_id"))
    for wave in range(waves):
        shared = spark.sparkContext.broadcast(block)
        found = base.filter(F.col("wave") == wave).select("id", "label", "v").mapInArrow(_scan(shared), FOUND)
        rows = found if best is None else best.drop("rank").unionByName(found)
        newer = written(rows.withColumn("rank", rank).filter(F.col("rank") <= k), "best")
        if best is not None:
            dropped(best)
        best = newer
        if wave + 1 < waves:
            at = best.filter(F.col("rank") == k).select("anchor_id", "ordinal", "score").toPandas()  # at most one row a slot of the block
            block.kth[np.searchsorted(block.ids, at["anchor_id"].to_numpy(np.int64)), at["ordinal"].to_numpy(np.int64)] = at["score"].to_numpy(np.int64)
        shared.unpersist()
    return best


def _scores(first: DataFrame, block: Block, positives: int) -> np.ndarray:
    at = first.select("anchor_id", "rank", "score").toPandas()  # at most positives rows an anchor of the block
    out = np.full((len(block.ids), positives), _NONE)
    out[np.searchsorted(block.ids, at["anchor_id"].to_numpy(np.int64)), at["rank"].to_numpy(np.int64) - 1] = at["score"].to_numpy(np.int64)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), lambda i: i % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a, e c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
}
