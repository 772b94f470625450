"""Session settings used by tests and benchmarks (a cluster brings its own), the shared folder, logging and seeds."""

from __future__ import annotations

import logging
import random
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spanloom", config: dict[str, str] | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config(map=config or {})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = tempfile.mkdtemp(prefix="spanloom-")
    return _own[application]


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and root that Spark resolves it to, in the form that other libraries read too (file:///...)."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()
    return re.sub(r"^file:/+", "file:///", whole)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: worked out once, however often it is used."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def logger(name: str, path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console and, if given, to a file; asking again adds no second handler."""
    out = logging.getLogger(name)
    out.setLevel(level)
    if not out.handlers:
        for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            out.addHandler(handler)
    return out


def seed_everything(seed: int) -> None:
    """Seeds the generators of the driver process. Rows are never drawn by rand(), which depends on partitions: use seeded()."""
    random.seed(seed)
    np.random.seed(seed % 2**32)


def seeded(key: str, seed: int) -> Column:
    """A number from 0 to 1 for each key and seed, the same on any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) / float(1 << 52)
