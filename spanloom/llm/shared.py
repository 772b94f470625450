"""Tables in the folder that all executors share, used to cut lineage between jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spanloom-")
    return _own[app]


#: Shuffle partitions that one file of a narrow table takes in.
NARROW = 8


def written(df: DataFrame, name: str, narrow: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: no lineage, and no loss with an executor.

    narrow: rows are a few numbers each and cheap to make, so that a task may take NARROW partitions and fewer files come out.
    by: columns of a few values, each with a folder of its own, so that a filter on them reads no other.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if narrow:
        df = df.coalesce(max(12, int(spark.conf.get("spark.sql.shuffle.partitions")) // NARROW))
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _noted:
        _noted[-1].append(out)
    return out


_noted: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes, when it ends, the tables that were written within it, but for those added to the list it gives: what the result still reads. After an error all stay."""
    needed: list[DataFrame] = []
    _noted.append([])
    try:
        yield needed
    except BaseException:
        _noted.pop()
        raise
    stay = {t.written_to for t in needed}
    dropped(*[t for t in _noted.pop() if t.written_to not in stay])


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() from which nothing that is still to run derives."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_: Column, text: Column) -> Column:
    """128 bits of a SHA-256 over id and text: rows share it if they have the same id and the same text (null as empty)."""
    whole = F.concat(F.when(id_.isNull(), "n").otherwise("i"), F.coalesce(id_.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
