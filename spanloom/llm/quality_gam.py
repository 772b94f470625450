"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting of shallow trees.

Features are computed from the bytes and words of each whole text. Each feature is cut into at most BINS quantile bins.
Boosting goes round the features again and again; each visit fits one tree of at most LEAVES leaves to the gradient of the
log loss over that feature's bins and adds it to the feature's lookup table. Then the PAIRS pairs of features whose joint bins
explain most of what is left are boosted in the same way with four-leaf trees over two features. A score is the intercept plus one
table entry for each feature and pair: vectorised bin look-ups and additions, then the logistic function.

The model is fitted on at most max_rows labelled rows, those with the smallest hashes of their ids (a documented bound of the
fit only; every text is scored). An id trains once: of several labels the largest counts, of several texts the one with the smallest hash.

Defined cases: a null or empty text has its own score (all word features 0); rows with a null label or id do not train; with no
labelled rows, or labels of one kind only, every score is the prior (0.5 without labels); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.words import byte_hashes, chunks, split_words

BINS, LEAVES, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 4, 120, 0.2, 6, 8, 40
MAX_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper_share", "digit_share", "sign_share", "end_mark_share", "comma_share", "bar_share",
    "distinct_words", "repeated_next", "repeated_pairs", "longest_word", "short_words", "signed_words", "capital_words", "words_per_line",
    "repeated_lines", "top_word_share", "non_ascii_share",
)

_CLASS = np.zeros((7, 256), dtype=np.float64)
_CLASS[0, 0x41:0x5B] = 1  # upper
_CLASS[1, 0x30:0x3A] = 1  # digit
_CLASS[2, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1  # sign
_CLASS[3, [0x2E, 0x21, 0x3F]] = 1  # end mark
_CLASS[4, 0x2C] = 1
_CLASS[5, 0x7C] = 1
_CLASS[6, 0x80:0x100] = 1
_CLASS = _CLASS.astype(np.float32)


def _by_text(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the count of its commonest key."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    packed = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    who = (packed[first] >> np.uint64(40)).astype(np.int64)
    size = np.diff(np.append(first, len(packed)))
    top = np.zeros(n)
    np.maximum.at(top, who, size)
    return np.bincount(who, minlength=n).astype(float), top


def features(data: np.ndarray, text_ptr: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(text_ptr) - 1
    words = split_words(data, text_ptr)
    owner, count = words.owner(), np.diff(words.ptr).astype(float)
    size = np.diff(text_ptr).astype(float)
    some, one = np.maximum(count, 1), np.maximum(size, 1)
    per_byte = [_by_text(_CLASS[i][data], text_ptr) for i in range(len(_CLASS))]
    key, length = words.hashes(), (words.end - words.start).astype(float)
    same = np.zeros(len(key))
    if len(key) > 1:
        same[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    pair = (key[1:] * np.uint64(3) ^ key[:-1]) if len(key) > 1 else np.zeros(0, np.uint64)
    inside = owner[1:] == owner[:-1] if len(key) > 1 else np.zeros(0, bool)
    distinct, top = _repeats(key, owner, n)
    pairs, _ = _repeats(pair[inside], owner[1:][inside], n) if len(pair) else (np.zeros(n), None)
    n_pairs = np.maximum(count - 1, 1)
    first, last = data[words.start] if len(key) else np.zeros(0, np.uint8), data[words.end - 1] if len(key) else np.zeros(0, np.uint8)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    lines = data == 0x0A
    n_lines = _by_text(lines, text_ptr) + 1
    at = np.flatnonzero(lines)
    line_start = np.unique(np.concatenate([text_ptr[:-1], at + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_key = byte_hashes(data, line_start, line_end) if len(line_start) else np.zeros(0, np.uint64)
    line_owner = np.searchsorted(text_ptr, line_start, side="right") - 1
    distinct_lines, _ = _repeats(line_key, line_owner, n)
    out = [
        np.log1p(size), np.log1p(count), size / some, per_byte[0] / one, per_byte[1] / one, per_byte[2] / one, per_byte[3] / some, per_byte[4] / some, per_byte[5] / some,
        distinct / some, _by_text(same, words.ptr) / some, 1 - pairs / n_pairs, longest, _by_text(length <= 2, words.ptr) / some, _by_text(_CLASS[2][last], words.ptr) / some, _by_text(_CLASS[0][first], words.ptr) / some,
        count / n_lines, 1 - distinct_lines / n_lines, top / some, per_byte[6] / one,
    ]
    return np.stack(out, axis=1).astype(np.float32)


# --- the model ------------------------------------------------------------------------------------------------------


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Best-first tree over ordered bins: the value of each bin."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = max(((gain(a, c) + gain(c, b) - gain(a, b), a, c, b) for a, b in parts for c in range(a + 1, b)), default=(0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        parts.remove((best[1], best[3]))
        parts += [(best[1], best[2]), (best[2], best[3])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _fit_pair(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree of four leaves over two features: one cut of the rows, and a cut of the columns in each half."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))
    rows, cols = grad.shape
    best = (0.0, np.zeros_like(grad))
    whole = g[-1, -1] ** 2 / (h[-1, -1] + 1)
    for r in range(1, rows):
        gain, out = 0.0, np.zeros_like(grad)
        for a, b in ((0, r), (r, rows)):
            left_g, left_h = g[b, 1:-1] - g[a, 1:-1], h[b, 1:-1] - h[a, 1:-1]
            all_g, all_h = g[b, -1] - g[a, -1], h[b, -1] - h[a, -1]
            score = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1)
            c = int(np.argmax(score))
            gain += score[c]
            out[a:b, : c + 1] = left_g[c] / (left_h[c] + 1)
            out[a:b, c + 1 :] = (all_g - left_g[c]) / (all_h - left_h[c] + 1)
        if gain - whole > best[0]:
            best = (gain - whole, out)
    return best


class AdditiveModel:
    """intercept + a table for each feature + a table for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape
        prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
        self.intercept, self.pairs = float(np.log(prior / (1 - prior))), []
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.coarse = [c[np.unique(np.linspace(0, len(c) - 1, min(len(c), PAIR_BINS - 1)).astype(int))] if len(c) else c for c in self.cuts]
        if not n or not 0 < y.mean() < 1:
            return
        bins = [self.bin(x, j, self.cuts) for j in range(k)]
        raw = np.full(n, self.intercept)
        for _ in range(ROUNDS):
            for j in range(k):
                p = _logistic(raw)
                step = RATE * _fit_tree(np.bincount(bins[j], y - p, len(self.tables[j])), np.bincount(bins[j], p * (1 - p), len(self.tables[j])), LEAVES)
                self.tables[j] += step
                raw += step[bins[j]]
        wide = [self.bin(x, j, self.coarse) for j in range(k)]
        shape = lambda a, b: (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)

        def sums(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            both = wide[a] * shape(a, b)[1] + wide[b]
            return tuple(np.bincount(both, w, shape(a, b)[0] * shape(a, b)[1]).reshape(shape(a, b)) for w in (y - p, p * (1 - p)))

        p = _logistic(raw)
        found = sorted(((_fit_pair(*sums(a, b, p))[0], a, b) for a in range(k) for b in range(a + 1, k) if min(shape(a, b)) > 1), reverse=True)[:PAIRS]
        self.pairs = [[a, b, np.zeros(shape(a, b))] for _, a, b in found]
        for _ in range(PAIR_ROUNDS):
            for a, b, table in self.pairs:
                step = RATE * _fit_pair(*sums(a, b, _logistic(raw)))[1]
                table += step
                raw += step[wide[a], wide[b]]

    @staticmethod
    def bin(x: np.ndarray, j: int, cuts: list[np.ndarray]) -> np.ndarray:
        return np.searchsorted(cuts[j], x[:, j], side="right")

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            raw += table[self.bin(x, j, self.cuts)]
        for a, b, table in self.pairs:
            raw += table[self.bin(x, a, self.coarse), self.bin(x, b, self.coarse)]
        return _logistic(raw)


def feature_rows(docs: DataFrame, text_column: str) -> DataFrame:
    """The other columns of docs and features array<float> of each whole text."""
    kept = [c for c in docs.columns if c != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, text_column):
                x = features(data, ptr)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), lists], names=[*kept, "features"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text_column) + ", features array<float>")


def fit(docs: DataFrame, labels: DataFrame, label_column: str, id_column: str = "doc_id", text_column: str = "text", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fits on at most max_rows of the labelled ids, one row for each; only their features (not their texts) come to the driver."""
    labelled = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("double").alias("y"))
    chosen = labelled.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    own = named.join(F.broadcast(chosen.select("id")), "id", "left_semi").withColumn("hash", F.xxhash64("text"))
    once = feature_rows(own, "text").groupBy("id").agg(F.min(F.struct("hash", "features")).alias("x"))
    rows = once.join(F.broadcast(chosen), "id").select("x.features", "y", "id").toPandas().sort_values("id", kind="stable")
    x = np.array(rows["features"].tolist(), dtype=np.float32).reshape(len(rows), len(FEATURES))
    return AdditiveModel(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score (0 to 1) of each whole text; the model is of a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, text_column):
                yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(shared.value.score(features(data, ptr)))], names=[id_column, "score"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {dict(docs.dtypes)[id_column]}, score double")


def accepted(docs: DataFrame, model: AdditiveModel, threshold: float, text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, batch.schema.names[at]):
                yield rows.filter(pa.array(shared.value.score(features(data, ptr)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


THRESHOLD = 0.3


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    scored = score(docs, fit(docs, labels, "quality"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality_gam": op4_quality_gam}
ORACLES: dict = {}
