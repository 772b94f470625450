"""The record checks over streams: they look at one record at a time, so they run unchanged on micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.integrity import RECORD, leak_errors, record_errors


def record_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New JSON-line files of a folder, as records."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_record_errors(records: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return record_errors(records, list(keys))


def stream_leak_errors(records: DataFrame, excluded: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Leaks of a stream against a table of excluded documents."""
    return leak_errors(records, excluded, list(keys))


def run_to_end(errors: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the errors of what there is by now to Parquet, exactly once."""
    errors.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
