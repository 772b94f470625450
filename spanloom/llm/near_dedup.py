"""Near-duplicate classes by DartMinHash signatures, banded joining and verified links.

The weight of a word shingle is its number of occurrences, and similarity is weighted Jaccard: sum of smaller over sum of larger weights.
Signatures: every weighted element is hit by darts whose places depend on the element alone: unit-area cells of (weight, rank) space,
each with a Poisson(1) number of darts, weights in dyadic strips. A dart counts if it lies below the element's weight and below
a rank bound set so that a text gets about DARTS_PER_COORDINATE darts for each coordinate whatever its length. Each dart falls to one
coordinate, which keeps its earliest dart; if a coordinate stays empty the bound is doubled for that text. Two texts agree in a coordinate with a chance equal to
their weighted Jaccard similarity.

1. Texts with the same sequence of words, by the SHA-256 of the words joined by spaces, are one node. Copies cost one row each and never meet again.
2. BANDS bands of ROWS coordinates make buckets. In each bucket every node is paired with one hub, not with every other node.
3. Pairs are verified against the shingles of both whole texts, and verified links joined into components.
4. A bucket whose nodes lie in several components still may hide links. Another hub is tried there; then the nodes of different
   components of a bucket are compared: pair by pair in small buckets, apart from pairs that the triangle inequality of Jaccard distance
   rules out by the distances to a common hub; block against block in large ones, where one link for each two components comes out, never
   the pairs. So no link between candidates is lost, and a bucket whose nodes are joined already costs nothing.
Hubs and the labels of large classes are keys of many rows: rows meet them through broadcasts of the few hot ones (llm/skew.py) or over salts.

Verification compares 32-bit shingle ids: the chance of a wrong common shingle is below n * n / 2**32 for texts of n shingles.

Defined cases: words are runs outside [\\x20\\x09-\\x0D], unchanged; a text of fewer words than a shingle has one shingle, all its words; texts without words
(null, empty, blank) are copies of each other; repeated rows are copies, and rows with the same id and text are one document, kept or not alike; a class is named by its smallest id (nulls last); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import dropped, row_key, scratch, written
from spanloom.llm.skew import join_unique
from spanloom.llm.words import U, Words, chunks, joined, mix, range_hashes, split_words

SHINGLE, SIMILAR, BANDS, ROWS, DARTS_PER_COORDINATE, HUB_ROUNDS = 5, 0.8, 20, 5, 8, 1
#: Buckets of up to LIGHT nodes are compared pair by pair, larger ones in blocks of about BLOCK nodes or BLOCK_BYTES of shingle ids.
LIGHT, BLOCK, BLOCK_BYTES = 32, 1024, 16 << 20
#: Keys of 16 bytes that may be broadcast.
BROADCAST_KEYS = 250_000
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(18)])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each group of the given sizes."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text."""
    key, count = words.hashes(), np.diff(words.ptr)
    each = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(count)), each)
    start = words.ptr[text] + _within(each)
    found = range_hashes(key, start, np.minimum(start + SHINGLE, words.ptr[text + 1]))
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    first = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (text[1:] != text[:-1]))) if len(found) else np.zeros(0, np.int64)
    return text[first], found[first], np.diff(np.append(first, len(found)))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash signature of each of n texts: k values of 64 bits; 0 for a text without elements."""
    total = np.bincount(text, weight, n)
    out = np.zeros(n * k, dtype=U)
    todo = total > 0
    bound = DARTS_PER_COORDINATE * k / np.maximum(total, 1)
    while todo.any():
        use = todo[text]
        t, e, w = text[use], element[use], weight[use]
        strips = np.frexp(w.astype(np.float64))[1]  # strip v covers weights from 2**v - 1 to 2**(v + 1) - 1
        at = np.repeat(np.arange(len(t)), strips)
        v = _within(strips)
        high = np.exp2(v)
        cells = np.ceil(bound[t[at]] * high).astype(np.int64)
        at, high, v = np.repeat(at, cells), np.repeat(high, cells), np.repeat(v, cells)
        q = _within(cells)
        cell = mix(e[at] ^ mix(v.astype(U) * U(0x9E3779B97F4A7C15) + q.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(1)))
        darts = np.searchsorted(_POISSON, (cell >> U(11)).astype(np.float64) * 2.0**-53, side="right")
        hit = np.flatnonzero(darts)
        darts = darts[hit]
        hit = np.repeat(hit, darts)
        dart = mix(cell[hit] + (_within(darts) + 1).astype(U) * U(0x165667B19E3779F9))
        where = mix(dart ^ U(0x27D4EB2F165667C5))
        at, high = at[hit], high[hit]
        rank = (q[hit] + (dart >> U(11)).astype(np.float64) * 2.0**-53) / high
        height = high - 1 + (where & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * high
        ok = (height < w[at]) & (rank < bound[t[at]])
        place = t[at[ok]] * k + (((where[ok] >> U(32)) * U(k)) >> U(32)).astype(np.int64)
        late_first = np.argsort(rank[ok])[::-1]
        out[place[late_first]] = dart[ok][late_first] | U(1)  # of several darts the earliest is written last
        todo &= (out.reshape(n, k) == 0).any(1)
        out.reshape(n, k)[todo] = 0
        bound[todo] *= 2
    return out.reshape(n, k)


def bands(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    n = len(signature)
    parts = signature.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), (n, BANDS))
    for i in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def digests(words: Words) -> list[bytes]:
    """SHA-256 of the words of each text, joined by one space."""
    data, bounds = joined(words)
    view, ends = memoryview(data), bounds.tolist()
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def node_rows(docs: DataFrame) -> DataFrame:
    """key, id, digest and band keys of each text; docs has key, id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, "text"):
                words = split_words(data, ptr)
                keys = bands(signatures(*shingles(words), rows.num_rows))
                some = np.diff(words.ptr) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("id"), pa.array(digests(words), pa.binary()), lists], names=["key", "id", "digest", "bands"])

    return docs.mapInArrow(run, f"key binary, id {dict(docs.dtypes)['id']}, digest binary, bands array<long>")


def shingle_ids(docs: DataFrame) -> DataFrame:
    """node and its sorted 32-bit ids, one for each occurrence of a shingle; docs has node, digest and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ptr in chunks(batch, "text"):
                words = split_words(data, ptr)
                text, found, weight = shingles(words)
                ids = np.repeat(found, weight) + _within(weight).astype(U) * U(0xD6E8FEB86659FD93)
                packed = np.sort((np.repeat(text, weight).astype(U) << U(32)) | (mix(ids) >> U(32)))
                ends = np.searchsorted(packed, np.arange(rows.num_rows + 1, dtype=U) << U(32))
                raw = (packed & U(0xFFFFFFFF)).astype(np.uint32)
                same = [d == own for d, own in zip(rows.column("digest").to_pylist(), digests(words), strict=True)]
                sets = pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("node"), sets], names=["node", "ids"]).filter(pa.array(same))

    return docs.select("node", "digest", "text").mapInArrow(run, "node long, ids binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays in which a repeated value is rare."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and similarity of each pair. A node in many pairs is spread over as many tasks."""
    degree = pairs.groupBy("b").agg(F.count("*").alias("degree"))
    total = pairs.count()
    salts = F.ceil(F.col("degree") * 1000 / F.lit(max(total, 1))).cast("int")
    known = written(degree.select("b", "degree", salts.alias("salts")), "degree", narrow=True)
    spread = join_unique(pairs, known, ["b"], "degree", total).withColumn("salt", F.pmod(F.hash("a"), F.col("salts")))
    left = spread.join(sets.select(F.col("node").alias("a"), F.col("ids").alias("of_a")), "a").select("a", "b", "salt", "of_a")
    right = sets.withColumnRenamed("node", "b").join(known, "b").select("b", F.col("ids").alias("of_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return written(left.join(right, ["b", "salt"]).select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, similarity double"), "verified")


def block_links(node: np.ndarray, component: np.ndarray, side: np.ndarray, ids: list[bytes]) -> list[tuple[int, int]]:
    """One link for each two components that have any, among the nodes of one block (side all 0) or between two (sides 0 and 1)."""
    sets = [np.frombuffer(x, np.uint32) for x in ids]
    size = np.array([len(x) for x in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times[at] > 1  # what only one node has is in no intersection
    owner, column = owner[shared], number[at[shared]]
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if side.any() else a
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        x, y = np.searchsorted(column, (first, first + 2048))
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[owner[x:y], column[x:y] - first] = 1
        both += part[a] @ part[b].T
    near = both >= SIMILAR * np.maximum(size[a][:, None] + size[b][None, :] - both, 1)
    known, label = np.unique(component, return_inverse=True)
    i, j = np.nonzero(near & (label[a][:, None] != label[b][None, :]))
    _, pick = np.unique(np.minimum(label[a[i]], label[b[j]]) * len(known) + np.maximum(label[a[i]], label[b[j]]), return_index=True)
    return list(zip(node[a[i[pick]]].tolist(), node[b[j[pick]]].tolist(), strict=True))


def heavy_links(unresolved: DataFrame, sets: DataFrame) -> DataFrame:
    """a and b: links between the components of large buckets, found block against block."""
    sized = unresolved.join(sets.select("node", F.length("ids").alias("bytes")), "node")
    needed = sized.groupBy("band").agg(F.count("*").alias("nodes"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    planned = written(needed.select("band", "nodes", blocks.alias("blocks")), "blocks", narrow=True)
    own = join_unique(unresolved, planned, ["band"], "nodes", unresolved.count()).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), (F.col("own") > o).cast("int").alias("side")))
    spread = own.select("band", "node", "component", F.explode(tasks).alias("t")).select("band", "node", "component", "t.*").join(sets, "node")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            found = block_links(np.array([h[1] for h in held]), np.array([h[2] for h in held]), np.array([h[3] for h in held]), [h[4] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        held: list = []
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for row in zip(zip(c["band"], c["i"], c["j"], strict=True), c["node"], c["component"], c["side"], c["ids"], strict=True):
                if held and held[0][0] != row[0]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    return spread.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of links (a, b): smallest label of all neighbours, then label of the label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", narrow=True)
    total = both.count()
    # Links stand in both directions, so the links of a node are its neighbours.
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("size")).withColumnRenamed("a", "node"), "labels", narrow=True)
    nodes = labels.count()
    while True:
        near = join_unique(both, labels.withColumnRenamed("node", "b"), ["b"], "size", total).groupBy("a").agg(F.min("label").alias("near"))
        pulled = written(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", "size", F.least("label", "near").alias("low")), "pulled", narrow=True)
        named = pulled.groupBy("low").agg(F.count("*").alias("members"))
        above = written(labels.select(F.col("node").alias("low"), F.col("label").alias("above")).join(named, "low"), "above", narrow=True)
        jumped = join_unique(pulled, above, ["low"], "members", nodes).select("node", F.least("low", "above").alias("label"), "size", F.col("label").alias("old"))
        now = written(jumped, "labels", narrow=True)
        dropped(labels, pulled, above)
        labels = now
        if now.filter("label <> old").limit(1).count() == 0:
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), class_size, kept (one row of each class), copies (rows with the same words)."""
    with scratch() as needed:
        texts = docs.select(row_key(F.col(id_column), F.col(text_column)).alias("key"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        rows = written(node_rows(texts), "rows")
        nodes = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("lead"), F.count("*").alias("size"), F.first("bands").alias("bands"))
        nodes = written(nodes.select("digest", F.col("lead.key").alias("key"), F.col("lead.id").alias("first_id"), "size", "bands", F.monotonically_increasing_id().alias("node")), "nodes")
        members = nodes.select("node", F.explode("bands").alias("band"))
        buckets = written(members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "buckets", narrow=True)
        total = nodes.count() * BANDS
        inside = written(join_unique(members, buckets, ["band"], "n", total), "inside", narrow=True)
        involved = inside.select("node").distinct().join(nodes.select("node", "key", "digest"), "node")
        sets = written(shingle_ids(texts.select("key", "text").join(involved.hint("shuffle_hash"), "key")).dropDuplicates(["node"]), "sets")
        tested = verified(written(inside.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs", narrow=True), sets)
        links = tested.filter(F.col("similarity") >= SIMILAR)
        label = components(links)
        for step in range(HUB_ROUNDS + 1):
            placed = inside.select("node", "band", "hub").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
            open_bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("node", F.hash(F.col("node"), F.lit(step))).alias("next"), F.count("*").alias("n")).filter("low <> high")
            unresolved = written(join_unique(placed, written(open_bands.select("band", "next", "n"), "open", narrow=True), ["band"], "n", total), "unresolved", narrow=True)
            if step < HUB_ROUNDS:
                pairs = unresolved.filter("node <> next").select(F.col("node").alias("a"), F.col("next").alias("b"))  # verified() salts hubs, which stand in b
                fresh = unresolved.limit(0).select(F.col("node").alias("a"), F.col("hub").alias("b"))
            else:
                light = F.col("n") <= LIGHT
                near = tested.select(F.col("a").alias("node"), F.col("b").alias("hub"), (1 - F.col("similarity")).alias("far"))
                side = unresolved.filter(light).join(near, ["node", "hub"], "left").withColumn("far", F.coalesce("far", F.when(F.col("node") == F.col("hub"), 0.0)))
                x, y = side.alias("x"), side.alias("y")
                apart = F.col("x.far").isNull() | F.col("y.far").isNull() | (F.abs(F.col("x.far") - F.col("y.far")) <= 1 - SIMILAR + 1e-3)
                joined = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & apart)
                pairs = joined.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
                fresh = written(heavy_links(unresolved.filter(~light), sets), "heavy")
            done = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            found = verified(written(pairs.distinct().join(done, ["a", "b"], "left_anti"), "pairs", narrow=True), sets)
            tested = tested.unionByName(found)
            fresh = fresh.unionByName(found.filter(F.col("similarity") >= SIMILAR).select("a", "b"))
            if fresh.limit(1).count():
                links = links.select("a", "b").unionByName(fresh)
                label = components(links)
        named = nodes.select("node", "digest", "key", "first_id", "size").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = written(named, "named", narrow=True)
        classes = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("size").alias("class_size"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("best"), F.count("*").alias("nodes"))
        whole = join_unique(named, written(classes, "components", narrow=True), ["component"], "nodes", named.count())
        classed = written(whole.select("digest", "size", "class_id", "class_size", F.when(F.col("best.node") == F.col("node"), F.col("key")).alias("lead_key")), "classes")
        out = join_unique(rows.select("key", "id", "digest"), classed, ["digest"], "size", rows.count())
        needed += [rows, classed]
        return out.select(
            F.col("id").alias(id_column), "class_id", "class_size", F.col("key").eqNullSafe(F.col("lead_key")).alias("kept"), F.col("size").alias("copies"), F.col("key").alias("dedup_key")
        )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each class."""
    keep = written(near_classes(docs, id_column, text_column).filter("kept").groupBy("dedup_key").agg(F.count("*").alias("rows")), "kept")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(F.col(id_column), F.col(text_column)).alias("dedup_key"))
    first = packed.join(keep.filter("rows = 1"), "dedup_key", "left_semi").select("row")
    again = keep.filter("rows > 1").select("dedup_key")
    if again.limit(1).count():
        # Rows of one id and text: that with the smallest hash of its other columns, chosen before rows are shuffled, so that a key with many rows is one row a task.
        others = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name not in (id_column, text_column) and "map<" not in f.dataType.simpleString()]
        rest = packed.join(F.broadcast(again) if again.count() <= BROADCAST_KEYS else again, "dedup_key", "left_semi")
        first = first.unionByName(rest.groupBy("dedup_key").agg(F.min_by("row", F.xxhash64(*others) if others else F.lit(0)).alias("row")).select("row"))
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("dedup_key")


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES: dict = {}
