"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only).

Every input partition is one run of (digest, smallest id, count). Runs are merged in rounds as in a binomial tree, FAN_IN
at a time: run r of one round goes to run r div FAN_IN of the next. A merge has two passes over sorted rows: each task sorts what it holds by
(run, digest) and folds equal neighbours, sends the sorted rest on, dealt out by run and digest so that no task ever holds a whole run, and the receiver sorts
what comes from the FAN_IN runs together and folds neighbours again. The states are structs, for which Spark aggregates over sorted input and not by hash.
(Spark has no operator that interleaves sorted streams without a sort of its own; its external sort merges the sorted spills.) Folding before sending leaves a digest one row for
each task and round, however many copies it has. Each level verifies what it merges: rows of one
SHA-256 must agree on a second hash and on the length of the text, or the job fails.

Defined cases: a null text counts as empty; texts are equal when identical after replacing each run of
[\\x20\\x09-\\x0D] by one space; of equal texts the smallest id stays (nulls last: a null id stays only if the group has no
other, and a group with several rows of the smallest id marks each of them as kept); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import written
from spanloom.llm.skew import join_unique

#: Runs that one merge joins.
FAN_IN = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, digest, check, size, run) of each row."""
    text = normalised(F.col(text_column))
    return docs.select(F.col(id_column).alias("id"), text.alias("t"), F.spark_partition_id().alias("run")).select(
        "id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("check"), F.length("t").alias("size"), "run"
    )


def _merge(runs: DataFrame) -> DataFrame:
    """One merge of the sorted runs that share run; fails where equal digests hide different texts.

    The check stands on the identifier, which every plan needs, so that no optimizer can leave it out.
    """
    merged = runs.groupBy("run", "digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    fails = F.raise_error(F.lit("equal digests of different texts")).cast(runs.schema["first"].dataType)
    return merged.withColumn("first", F.when(F.col("low") == F.col("high"), F.col("first")).otherwise(fails))


def tree_merge(rows: DataFrame, n_runs: int) -> DataFrame:
    """(digest, id, n): the smallest identifier and number of rows of each digest."""
    proof = F.struct("check", "size")
    runs = rows.select("run", "digest", F.struct(F.col("id").isNull().alias("none"), "id").alias("first"), F.lit(1).cast("long").alias("n"), proof.alias("low"), proof.alias("high"))
    while True:
        n_runs = -(-n_runs // FAN_IN)
        runs = _merge(runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int") if n_runs > 1 else F.lit(0)))
        if n_runs <= 1:
            return runs.select("digest", F.col("first.id").alias("id"), "n")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs, id_column, text_column), "digests")
    total, last = rows.agg(F.count("*"), F.max("run")).first()
    merged = written(tree_merge(rows, (last or 0) + 1), "merged").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    out = join_unique(rows.select("id", "digest"), merged, ["digest"], "group_size", total)
    return out.select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
}
