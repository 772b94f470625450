"""Mixing sources to target weights by Pfair scheduling (DataFrame and SQL functions only).

Each source is cut into blocks of block_size characters of whole documents, in a fixed pseudo-random order of its documents.
With weights of n of W slots, block j (from 1) of a source is released at slot floor((j-1)*W/n) and due by ceil(j*W/n). In every slot
the released block with the earliest deadline goes next. The weights fill all W slots, so the schedule repeats after W slots and no source ever
runs a whole block ahead of or behind its share. One cycle is computed in a fold over W slots (a table whose size depends on the number of
sources alone); the slot of any block then follows by arithmetic, without a pass over the blocks.

When a source has run out, its slots are left out and the others keep their proportions: every document is placed once.
A document longer than a block uses up as many of its source's blocks, so that shares hold in characters.

Running totals never gather a source in one task: documents are dealt over hash buckets of a source, buckets are summed first, then groups of
buckets, and the totals before each group and bucket are added to those within. A task orders some BUCKET_ROWS documents, or the root of the number of
buckets. The cycle is a table of a row a slot, broadcast up to BROADCAST_SLOTS rows and joined beyond. Its fold takes slots times sources steps: sources are meant
to be collections (thousands at most), not single hosts.

Defined cases: a null text has length 0; a null source is a source of its own; repeated rows are all placed, in adjoining places of either order; a
source without a given weight gets one slot of a cycle; a weight for an absent source is left out; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import written

SLOTS, BLOCK_CHARS, BUCKET_ROWS, BROADCAST_SLOTS, CYCLES = 1000, 65536, 1000, 100_000, 1024


def _edf(shares: str, total: str):
    """Source index of each slot of one cycle, as a column."""
    pick = (
        f"array_min(filter(transform({shares}, (n, i) -> named_struct('due', case when (state.done[i] * {total}) div n <= t "
        f"then ((state.done[i] + 1) * {total} + n - 1) div n end, 'i', i)), x -> x.due is not null)).i"
    )
    step = (
        f"(state, t) -> transform(array({pick}), p -> named_struct('done', transform(state.done, (d, i) -> if(i = p, d + 1, d)), "
        "'picks', concat(state.picks, array(p))))[0]"
    )
    start = f"named_struct('done', transform({shares}, s -> cast(0 as bigint)), 'picks', cast(array() as array<int>))"
    return F.expr(f"aggregate(sequence(cast(0 as bigint), {total} - 1), {start}, {step}, state -> state.picks)")


def cycle(spark_weights: DataFrame) -> DataFrame:
    """(mix_key, n, total, i, at): the slots of each source in one cycle; weights has (mix_key, n)."""
    listed = spark_weights.agg(F.array_sort(F.collect_list(F.struct("mix_key", F.col("n").cast("long").alias("n")))).alias("s"))
    arrays = listed.select("s", F.transform("s", lambda x: x["n"]).alias("shares"), F.expr("aggregate(s, cast(0 as bigint), (a, x) -> a + x.n)").alias("total")).filter("total > 0")
    picks = arrays.select("s", "total", F.posexplode(_edf("shares", "total")).alias("at", "p"))
    own = picks.select(F.col("s")[F.col("p")]["mix_key"].alias("mix_key"), F.col("s")[F.col("p")]["n"].alias("n"), "total", F.col("at").cast("long").alias("at"))
    return own.withColumn("i", F.row_number().over(Window.partitionBy("mix_key").orderBy("at")).cast("long") - 1)


def _key(source: str):
    return F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(F.col(source).cast("string"), F.lit("")))


def _size(docs: DataFrame, column: str):
    """Characters of a text column; a numeric column holds sizes already."""
    whole = F.length(column) if dict(docs.dtypes)[column] == "string" else F.col(column)
    return F.coalesce(whole, F.lit(0)).cast("long")


def root_weights(docs: DataFrame, source_column: str = "source", text_column: str = "text", slots: int = SLOTS) -> DataFrame:
    """(mix_key, n): slots in proportion to the square root of each source's characters over all documents, one at least."""
    sizes = docs.groupBy(_key(source_column).alias("mix_key")).agg(F.sqrt(F.sum(_size(docs, text_column)).cast("double")).alias("r"))
    whole = sizes.agg(F.sum("r").alias("whole"))
    return sizes.join(F.broadcast(whole)).select("mix_key", F.when(F.col("whole") > 0, F.greatest(F.lit(1), F.round(F.col("r") / F.col("whole") * slots))).otherwise(1).cast("long").alias("n"))


def given_weights(docs: DataFrame, weights: Mapping[str | None, float], source_column: str = "source", slots: int = SLOTS) -> DataFrame:
    """(mix_key, n): slots in proportion to the given weights, one at least for every source there is."""
    total = sum(weights.values())
    cases = [F.when(F.col(source_column).eqNullSafe(F.lit(s)), F.lit(max(1, round(w / total * slots)))) for s, w in weights.items()]
    return docs.groupBy(_key(source_column).alias("mix_key")).agg(F.max(F.coalesce(*cases, F.lit(1))).cast("long").alias("n"))


def _before(sums: DataFrame, group: list[str], coarse: str, fine: str, value: str, out: str) -> DataFrame:
    """sums with out: the total of value in all rows of the group before this one in the order of fine. coarse goes up with fine; no task orders more than its values or the rows of one of them."""
    nothing = F.lit(0).cast("long")
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.groupBy(*group, coarse).agg(F.sum(value).alias("mix_top"))
    tops = tops.select(*group, coarse, F.coalesce(F.sum("mix_top").over(earlier(group, coarse)), nothing).alias("mix_top"))
    inner = F.coalesce(F.sum(value).over(earlier([*group, coarse], fine)), nothing)
    return sums.withColumn(out, inner).join(tops, [*group, coarse]).withColumn(out, F.col(out) + F.col("mix_top")).drop("mix_top")


def scheduled(docs: DataFrame, weights: DataFrame | None = None, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", block_size: int = BLOCK_CHARS) -> DataFrame:
    """row (a struct of the columns of docs), mix_block (from 1, within its source), mix_slot, mix_order, mix_id and mix_size: sorting by the last four gives the mixture."""
    weights = root_weights(docs, source_column, text_column) if weights is None else weights
    digits = max(1, math.ceil(math.log(max(docs.count() / BUCKET_ROWS, 1), 16)))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        _key(source_column).alias("mix_key"),
        _size(docs, text_column).alias("mix_size"),
        F.col(id_column).alias("mix_id"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("mix_order"),
    ).withColumn("mix_bucket", F.substring("mix_order", 1, digits))
    sums = keyed.groupBy("mix_key", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum"))
    grouped = sums.withColumn("mix_group", F.substring("mix_bucket", 1, (digits + 1) // 2))
    bases = _before(grouped, ["mix_key"], "mix_group", "mix_bucket", "mix_sum", "mix_base").select("mix_key", "mix_bucket", "mix_base")
    within = Window.partitionBy("mix_key", "mix_bucket").orderBy("mix_order", "mix_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("mix_before", F.coalesce(F.sum("mix_size").over(within), F.lit(0).cast("long"))).join(bases, ["mix_key", "mix_bucket"])
    blocks = placed.withColumn("mix_block", F.floor((F.col("mix_base") + F.col("mix_before")) / F.lit(block_size)).cast("long"))
    table = written(cycle(weights), "cycle", narrow=True)  # a row for each slot of a cycle
    known = F.broadcast if table.count() <= BROADCAST_SLOTS else lambda df: df
    share = table.select("mix_key", F.col("n").alias("mix_n"), F.col("total").alias("mix_total")).distinct()
    slots = blocks.join(known(share), "mix_key").withColumn("mix_i", F.col("mix_block") % F.col("mix_n"))
    slots = slots.join(known(table.select("mix_key", F.col("i").alias("mix_i"), F.col("at").alias("mix_at"))), ["mix_key", "mix_i"])
    slots = slots.withColumn("mix_slot", F.expr("mix_block div mix_n") * F.col("mix_total") + F.col("mix_at"))
    return slots.select("row", (F.col("mix_block") + 1).alias("mix_block"), "mix_slot", "mix_order", "mix_id", "mix_size", F.expr("mix_block div mix_n").alias("mix_cycle"))


def positions(placed: DataFrame) -> DataFrame:
    """scheduled() rows with mix_position, from 0: totals of runs of CYCLES cycles, of cycles, then of slots, then places within a slot."""
    slots = placed.groupBy("mix_cycle", "mix_slot").agg(F.count("*").alias("c"))
    cycles = slots.groupBy("mix_cycle").agg(F.sum("c").alias("cc")).withColumn("mix_era", F.expr(f"mix_cycle div {CYCLES}"))
    first = _before(cycles, [], "mix_era", "mix_cycle", "cc", "b0").select("mix_cycle", "b0")
    inner = Window.partitionBy("mix_cycle").orderBy("mix_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slots.withColumn("b1", F.coalesce(F.sum("c").over(inner), F.lit(0).cast("long"))).join(first, "mix_cycle").select("mix_slot", (F.col("b0") + F.col("b1")).alias("b"))
    place = F.row_number().over(Window.partitionBy("mix_slot").orderBy("mix_order", "mix_id", "mix_size"))
    return placed.withColumn("place", place).join(bases, "mix_slot").withColumn("mix_position", (F.col("b") + F.col("place") - 1).cast("long")).drop("b", "place")


def mixed(docs: DataFrame, weights: DataFrame | None = None, **columns) -> DataFrame:
    """docs in the order of the mixture: partitions are ranges of it, sorted within; in_mixture() finds the order of a written table again."""
    placed = scheduled(docs, weights, **columns)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(n, "mix_slot", "mix_order").sortWithinPartitions("mix_slot", "mix_order", "mix_id", "mix_size")
    return ordered.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def in_mixture(table: DataFrame) -> DataFrame:
    """table, read from the Parquet files of mixed(), with mix_position from 0.

    Spark reads files and their parts in any order, so places come from the files: each is a range of the mixture, numbered in its name by its
    partition (and by a counter where a partition was cut), with its rows in order.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    rows = table.select(columns.alias("row"), F.col("_metadata.file_path").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    number = lambda pattern: F.coalesce(F.regexp_extract("mix_file", pattern, 1).try_cast("long"), F.lit(0))
    part, cut = number(r"/part-(\d+)-[^/]*$"), number(r"-c(\d+)\.[^/]*$")
    files = rows.groupBy("mix_file").agg(F.count("*").alias("c")).select("mix_file", "c", part.alias("mix_part"), F.struct(part.alias("part"), cut.alias("cut")).alias("mix_at"))
    bases = _before(files.withColumn("mix_era", F.expr(f"mix_part div {CYCLES}")), [], "mix_era", "mix_at", "c", "mix_base").select("mix_file", "mix_base")
    bases = written(bases, "files", narrow=True)  # a row for each file
    joined = rows.join(F.broadcast(bases) if bases.count() <= BROADCAST_SLOTS else bases, "mix_file")
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in table.columns], (F.col("mix_base") + F.col("mix_row")).alias("mix_position"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.length("text").alias("size"))
    placed = positions(scheduled(written(docs, "sizes"), text_column="size"))
    return placed.select("row.doc_id", "row.source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))


QUERIES = {"op9_pfair_mix": op9_pfair_mix}
ORACLES = {
    "op9_pfair_mix": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, coalesce(length(text), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents
), r AS (SELECT k, sqrt(CAST(sum(size) AS DOUBLE)) AS r FROM d GROUP BY k
), w AS (SELECT k, CAST(CASE WHEN (SELECT sum(r) FROM r) > 0 THEN greatest(1, round(r / (SELECT sum(r) FROM r) * {SLOTS})) ELSE 1 END AS BIGINT) AS n FROM r
), l AS (SELECT list(k ORDER BY k) AS ks, list(n ORDER BY k) AS ns, CAST(sum(n) AS BIGINT) AS total FROM w
), e(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ns, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p FROM (
    SELECT t, done, total, list_min(list_transform(ns, lambda n, i: CASE WHEN (done[i] * total) // n <= t + 1 THEN (((done[i] + 1) * total + n - 1) // n) * 100000 + i END)) % 100000 AS p
    FROM e, l WHERE t + 1 < total)
), c AS (
  SELECT ks[pick] AS k, ns[pick] AS n, total, t AS slot_at, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS i FROM e, l WHERE t >= 0
), b AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_CHARS} AS b0 FROM d
), p AS (SELECT doc_id, source, o, size, CAST(b0 + 1 AS BIGINT) AS block, CAST((b0 // n) * total + slot_at AS BIGINT) AS slot FROM b JOIN c ON b.k = c.k AND b0 % n = i)
SELECT doc_id, source, block, slot, row_number() OVER (ORDER BY slot, o, doc_id, size) - 1 AS position FROM p
"""
}
