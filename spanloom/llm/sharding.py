"""Shards of near-equal bytes by longest-processing-time scheduling, equal texts together.

1. A group is all rows of one text (by its SHA-256); copies are counted before they are shuffled, so a text that a third of the rows repeat is one row.
2. Groups are sorted by bytes, the largest first, over range partitions with the digest as a tie-breaker, so that one frequent size is spread too. Each run of
   equal sizes within a partition becomes one row: (partition, bytes, number of groups).
3. One task goes through these rows from the largest, with a heap of the shards' loads: the next group goes to the least-loaded shard, the first of equals. A run of equal groups is
   dealt at once: shard j takes its next group at load, load + size, load + 2 * size ..., and the run takes the lowest such marks of all shards, which are those that
   a heap pops one by one. The task holds the loads alone. Its rows are one for each distinct size and one for each partition: different sizes add up
   to at most all bytes, so there are fewer than the root of twice the bytes (20 million at 200 TB), whatever the number of groups.
4. Groups look up their shard in the row of their run, and documents that of their group (frequent texts by broadcast). Slots are numbers in a sort by
   shard and id over range partitions: places within a partition, and a sum over one row for each shard and partition.

The largest shard is at most 4/3 of the best possible one (Graham's bound); a group that is larger than a shard's share alone takes one whole.

Defined cases: a null text has no bytes and is one group with empty texts; repeated rows are documents of their own, each with its slot; a null id is a document too. Slots follow the id within
a shard (nulls last, then by text, and in any order between equal rows); fewer groups than shards leave shards empty; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import dropped, written
from spanloom.llm.skew import join_unique

#: Bytes that a document takes beside its text.
OVERHEAD = 8


def deal(loads: list[tuple[int, int]], size: int, count: int) -> list[tuple[int, int]]:
    """(shard, number of groups) of count groups of one size, each in turn to the least-loaded shard; loads, a heap of (load, shard), is brought up to date.

    While few are left they are popped one by one; otherwise as many as all marks below a bound are taken at once.
    """
    taken: dict[int, int] = {}
    if count > 4 * len(loads) and size > 0:
        low, high = loads[0][0], loads[0][0] + size * (count + 1)
        while low < high:  # the highest bound with no more than count marks below it
            mid = (low + high + 1) // 2
            if sum(max(0, -(-(mid - load) // size)) for load, _ in loads) <= count:
                low = mid
            else:
                high = mid - 1
        for load, shard in loads:
            if (n := max(0, -(-(low - load) // size))) > 0:
                taken[shard] = n
        loads[:] = [(load + size * taken.get(shard, 0), shard) for load, shard in loads]
        heapq.heapify(loads)
        count -= sum(taken.values())
    for _ in range(count):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        taken[shard] = taken.get(shard, 0) + 1
    return sorted(taken.items())


def schedule(runs: DataFrame, shards: int) -> DataFrame:
    """runs (part, bytes, n, first) with shards and ends: group number i of a run (from 0) goes to the first shard whose end is above i."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [(0, j) for j in range(shards)]
        for pdf in batches:
            dealt = [deal(loads, b, n) for b, n in zip(pdf["bytes"].tolist(), pdf["n"].tolist(), strict=True)]
            ends = []
            for one in dealt:
                at, own = 0, []
                for _, n in one:
                    own.append(at := at + n)
                ends.append(own)
            yield pdf.assign(shards=[[j for j, _ in one] for one in dealt], ends=ends)

    ordered = runs.select("part", "bytes", "n", "first").repartition(1).sortWithinPartitions(F.desc("bytes"), "part")
    return ordered.mapInPandas(run, "part int, bytes long, n long, first long, shards array<int>, ends array<long>")


def _placed(rows: DataFrame, *order) -> DataFrame:
    """rows in one order over range partitions, with part and at (the place within it)."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return own.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))


def sharded(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, text_crc32, law ('bytes'), shard, slot (from 0 in each shard), grown_shard (null) of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = written(rows, "rows")
    total = rows.count()
    groups = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"))
    groups = written(_placed(groups, F.desc("bytes"), F.asc("digest")), "groups")
    runs = groups.groupBy("part", "bytes").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    dealt = written(schedule(runs, shards), "dealt")
    before = F.size(F.filter("ends", lambda e: e <= F.col("at") - F.col("first")))
    held = groups.join(dealt.drop("n"), ["part", "bytes"]).select("digest", "copies", F.get("shards", before).alias("shard"))
    held = written(held, "group-shards")
    documents = join_unique(rows, held, ["digest"], "copies", total).drop("copies")
    order = (F.asc("shard"), F.asc_nulls_last("id"), F.asc("digest"))
    numbered = written(_placed(documents, *order).drop("digest"), "sharded")
    dropped(rows, groups, dealt, held)
    # A partition is a range of the order: a row for each shard and for each partition.
    spans = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = spans.select("shard", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    slot = F.col("base") + F.col("at") - F.col("first")
    out = numbered.join(based, ["shard", "part"])
    return out.select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op13_sharding": op13_sharding}
#: A heap over groups is no SQL.
ORACLES: dict = {}
