"""The corpus pipeline: quality, line dedup, near-dedup, mixing, encoding; every stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import byte_bpe, line_dedup, near_dedup, pfair_mix, quality_gam
from spanloom.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below its threshold) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality_gam.held_out())
    return quality_gam.accepted(docs, quality_gam.fit(docs, labels, "quality"), quality_gam.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, all but their first place; n_chars follows."""
    return line_dedup.without_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, each partition a range of it."""
    return pfair_mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, and the place of each document in the mixture."""
    placed = pfair_mix.in_mixture(docs).select(F.struct("doc_id", "mix_position").alias("doc"), "text")
    return byte_bpe.round_trip(placed, *byte_bpe.multilingual_50k(), id_column="doc").select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "doc.mix_position")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("byte_bpe", encoding)]

#: DuckDB SQL cannot express the classifier, the signatures or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")])
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
