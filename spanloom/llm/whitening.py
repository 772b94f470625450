"""Whitening of embeddings by the leading principal components.

1. Components become whole numbers x = floor(scale * c) + shift; n and the sums S of each dimension are exact.
2. n * x - S is exact too, so rows are centred without error; divided by n once they are the rows of a RowMatrix (Spark MLlib), whose Gramian by n is the
   covariance. A shift that is large against the spread costs no digits that way.
3. The covariance (dim x dim numbers) is taken apart at the driver; its leading eigenvectors, divided by the roots of their eigenvalues, are broadcast, and
   mapInPandas projects every centred row.
4. The covariance of what came out is measured over all rows, in two passes (means, then products about them), and its distance from the identity reported.

Only n, S, the covariance and the projection leave the rows. The input is read once for each step and never shuffled.

Defined cases: rows whose vector is null or holds null or a non-finite entry are dropped, and so are empty vectors, which have no component; a null id stays null; repeated rows
all count and all come out; vectors of different lengths are whitened apart, each length with its own n, S and covariance (a job for each length);
a component without variance beyond rounding (constant dimensions, fewer rows than components, a single row) has whitened 0 and counts as explained by its
eigenvalue, and the identity error leaves it out; a deviation beyond the limits of long is null, and stands in deviation_exact; numbers whose
n * x leaves the limits of long fail the job; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import written
from spanloom.llm.vectors import by_length, finite, floors

_LONG = np.iinfo(np.int64)
WHITENED = "`{id}` {kind}, n long, deviation decimal(38,0), w array<double>"
SCHEMA = "`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def totals(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of v: the number of vectors and the exact sum of each dimension. A task sends one row for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for at, v in by_length(batch, "v"):
                n, s = held.setdefault(v.shape[1], [0, np.zeros(v.shape[1], np.int64)])
                held[v.shape[1]] = [n + len(at), s + v.sum(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s for _, s in held.values()], pa.list_(pa.int64()))], names=["dim", "n", "s"]
        )

    parts = rows.select("v").mapInArrow(run, "dim int, n long, s array<long>")
    sums = parts.select("dim", "n", F.posexplode("s").alias("at", "s")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"])
    found = sums.groupBy("dim").agg(F.max("n").alias("n"), each.alias("s")).collect()  # a row for each vector length
    return {r["dim"]: (r["n"], np.array(r["s"], np.int64)) for r in found}


def covariance(rows: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of the columns of v, from the Gramian of exactly centred rows."""
    # Built-in arithmetic up to the matrix: n * x - S is a whole number, its division by n the only rounding.
    sums = F.array(*[F.lit(int(x)) for x in s])
    centred = F.transform(F.arrays_zip(F.col("v").alias("v"), sums.alias("s")), lambda p: (F.lit(n) * p["v"] - p["s"]).cast("double") / float(n))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row")
    return RowMatrix(vectors, numRows=n, numCols=len(s)).computeGramianMatrix().toArray() / n


def projection(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """dim x k projection onto the leading eigenvectors over the roots of their eigenvalues (0 without variance), and each one's share of the trace."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    k = min(components, len(values))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    real = values > max(float(values[0]), 0.0) * len(v) * np.finfo(float).eps * 4
    trace = float(np.trace(v))
    return np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0), np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(k)


def squares(y: np.ndarray) -> list[Decimal]:
    """The exact sum of squares of each row of whole numbers."""
    top = float(np.abs(y.astype(np.float64)).max(initial=0.0))
    if top * top * max(1, y.shape[1]) < 2.0**62:
        return [Decimal(x) for x in (y * y).sum(1).tolist()]
    if top * y.shape[1] < 2.0**52:  # in halves of 26 bits
        high, low = y >> 26, y & ((1 << 26) - 1)
        parts = ((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())
        return [Decimal((a << 52) + (b << 27) + c) for a, b, c in zip(*parts, strict=True)]
    return [Decimal(sum(int(x) ** 2 for x in row)) for row in y]


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row for each vector and each of its leading components: id, component (from 1), n, deviation (sum of (n * x - S)^2 over dimensions), whitened, explained, identity_error, deviation_exact."""
    spark, kind = vectors.sparkSession, vectors.schema[id_column].dataType.simpleString()
    rows = finite(vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")), "v").filter(F.size("v") > 0).select("id", floors(F.col("v"), scale, shift).alias("v"))
    out = []
    for dim, (n, s) in sorted(totals(rows).items()):
        own = rows.filter(F.size("v") == dim)
        turn, explained = projection(covariance(own, n, s), components)
        shared = spark.sparkContext.broadcast((n, s, turn))

        def project(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            n, s, turn = shared.value
            for pdf in batches:
                y = n * np.stack(pdf["v"].to_list()).astype(np.int64, copy=False) - s if len(pdf) else np.zeros((0, len(s)), np.int64)
                yield pd.DataFrame({"id": pdf["id"], "n": n, "deviation": squares(y), "w": list((y / float(n)) @ turn)})

        white = written(own.mapInPandas(project, WHITENED.format(id="id", kind=kind)), "whitened")
        error = identity_error(white, n, np.flatnonzero(np.abs(turn).sum(0) > 0).tolist())
        share = F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("at") + 1)
        each = white.select("id", "n", "deviation", F.posexplode("w").alias("at", "whitened"))
        long = F.when(F.col("deviation") <= F.lit(_LONG.max), F.col("deviation").cast("long")).alias("deviation")
        out.append(each.select(F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), "n", long, "whitened", share.alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact")))
    if not out:
        return spark.createDataFrame([], SCHEMA.format(id=id_column, kind=kind))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def identity_error(white: DataFrame, n: int, real: list[int]) -> float:
    """The largest absolute entry of the covariance of w, measured over all rows about their means, minus the identity; over components with variance."""
    if not real:
        return 0.0
    means = white.agg(*[F.avg(F.col("w")[i]) for i in real]).first()
    about = {i: F.col("w")[i] - F.lit(m) for i, m in zip(real, means, strict=True)}
    pairs = [(i, j) for i in real for j in real if i <= j]
    found = white.agg(*[F.sum(about[i] * about[j]) for i, j in pairs]).first()
    return max(abs(x / n - (i == j)) for x, (i, j) in zip(found, pairs, strict=True))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op12_whitening": op12_whitening}
#: SQL has no eigenvectors.
ORACLES: dict = {}
