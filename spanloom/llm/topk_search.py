"""Exact top-k inner-product search over KD-trees, one tree per shard.

1. Cells: median splits of a bounded sample (SAMPLE vectors at most) cut space into MAX_CELLS cells at most; every vector is indexed, in its cell. A cell with more rows
   than a shard holds is dealt over several shards by row hash. A shard's size is fixed (SHARD_ROWS, SHARD_BYTES): it is their number that grows with the table.
2. Trees: in each shard, median splits along the widest side of the tight bounding box, down to LEAF vectors. A node keeps its box.
3. Each query has an order of its own over the cells: its own cell first, then by the bound of their boxes. It goes through it in waves of
   1, FIRST, FIRST * GROWTH, ... cells; its k-th score and id, as improved so far, go along, and it ends where the next bound cannot beat them. Within a cell it visits the
   shards whose own boxes can still beat its k-th score.
4. Within a tree each query starts at the root and goes on with its open node of the highest bound: an inner node gives way to its children, a leaf is scored.
   It ends when that bound falls below its k-th score. Queries of a block take these steps side by side.
The bound of a box for query q is the sum over dimensions of max(q*low, q*high): no vector in the box scores higher.
A box that ties with the k-th score is visited, so ties by smaller id are exact.

Only the boxes of cells reach all tasks: at most MAX_CELLS for each vector length, of 2 * dim numbers; those of shards are a table. A tree goes to the queries that visit its shard, once for
each QUERY_BLOCK of them, so what is moved grows with the vectors and with the visits and not with their product.

Defined cases: a vector that is null or holds null or a non-finite component takes no part, nor does a null id; vectors of
different lengths are never compared; repeated rows are all candidates, except those with the query's own id; a query id on several
rows is searched once, with its smallest vector; products beyond 64 bits are held at the limits of long; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import dropped, written

SAMPLE, MAX_CELLS, SHARD_ROWS, SHARD_BYTES, LEAF, QUERY_BLOCK, FIRST, GROWTH = 16384, 4096, 8192, 16 << 20, 256, 4096, 4, 4
#: Queries whose bounds for all cells are held at once.
ROUTE_BLOCK = 512
_LONG = np.iinfo(np.int64)


def quantised(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v array<long>) of the rows that take part: v = floor(64 * x) of each component x."""
    x = F.transform(F.col(vector_column), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.select(F.col(id_column).cast("long").alias("id"), x.alias("x"), bad.alias("bad")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.col("bad")).select(
        "id", F.transform("x", lambda e: F.floor(F.lit(64.0) * e).cast("long")).alias("v")
    )


# --- cells ---------------------------------------------------------------------------------------------------------


def split_cells(sample: np.ndarray, cells: int) -> list:
    """Nested (dim, cut, left, right) median splits; a leaf is its cell's number."""
    count = 0

    def cut(rows: np.ndarray, n: int):
        nonlocal count
        if n > 1 and len(rows) > 1 and rows.shape[1]:
            d = int(np.argmax(rows.max(0) - rows.min(0)))
            at = np.partition(rows[:, d], len(rows) // 2)[len(rows) // 2]
            low = rows[:, d] < at
            if low.any() and not low.all():
                return (d, int(at), cut(rows[low], n // 2), cut(rows[~low], n - n // 2))
        count += 1
        return count - 1

    return cut(sample, cells)


def assign_cells(tree, v: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    if isinstance(tree, int):
        out[rows] = tree
        return
    d, at, low, high = tree
    side = v[rows, d] < at
    assign_cells(low, v, out, rows[side])
    assign_cells(high, v, out, rows[~side])


# --- trees ---------------------------------------------------------------------------------------------------------


def build_tree(ids: np.ndarray, v: np.ndarray) -> dict:
    """Median-split tree over rows in ascending order of id; leaves are ranges of perm."""
    order = np.lexsort((ids,))
    ids, v = ids[order], v[order]
    perm = np.arange(len(ids))
    low, high, left, right, begin, stop = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        me = len(low)
        rows = v[perm[a:b]]
        low.append(rows.min(0))
        high.append(rows.max(0))
        left.append(-1), right.append(-1), begin.append(a), stop.append(b)
        if b - a > LEAF and rows.shape[1]:
            d = int(np.argmax(high[me].astype(np.float64) - low[me]))
            if high[me][d] > low[me][d]:
                mid = (b - a) // 2
                perm[a:b] = perm[a:b][np.argpartition(rows[:, d], mid)]
                left[me] = node(a, a + mid)
                right[me] = node(a + mid, b)
        return me

    node(0, len(ids))
    for a, b, child in zip(begin, stop, left, strict=True):
        if child < 0:
            perm[a:b] = np.sort(perm[a:b])
    return {"ids": ids, "v": v[perm], "perm": perm, "low": np.array(low), "high": np.array(high), "left": left, "right": right, "begin": begin, "stop": stop}


def _exact_floats(q: np.ndarray, v: np.ndarray) -> bool:
    top = lambda a: float(np.abs(a.astype(np.float64)).max()) if a.size else 0.0
    return top(q) * top(v) * max(1, q.shape[1]) < 2.0**52


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q and v, held at the limits of long."""
    if _exact_floats(q, v):
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    wide = q.astype(object) @ v.astype(object).T
    return np.clip(wide, _LONG.min, _LONG.max).astype(np.int64)


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Highest product of each query with any point of each box."""
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    return up @ high.astype(np.float64).T + down @ low.astype(np.float64).T


def _slack(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Twice the rounding error that box_bounds can have; 0 where floats are exact."""
    if _exact_floats(q, low) and _exact_floats(q, high):
        return np.zeros(len(q))
    size = np.abs(q.astype(np.float64)).sum(1) * float(max(np.abs(low.astype(np.float64)).max(initial=0), np.abs(high.astype(np.float64)).max(initial=0)))
    return size * 2.0**-40


def pair_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bound of each query for its own box."""
    return np.maximum(q * low, q * high).sum(1)


def search_tree(tree: dict, qid: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec id, score) of what can be among the k best, given each query's k-th score and id so far."""
    n = len(qid)
    best_s = np.full((n, k), _LONG.min, dtype=np.int64)
    best_r = np.full((n, k), len(tree["ids"]), dtype=np.int64)  # rank of the id in the shard: smaller is better
    floor_s, floor_r = kth.copy(), np.searchsorted(tree["ids"], kth_id)
    left, right = np.array(tree["left"]), np.array(tree["right"])
    slack, real = _slack(q, tree["low"], tree["high"]), q.astype(np.float64)
    low, high = tree["low"].astype(np.float64), tree["high"].astype(np.float64)
    # The open nodes of each query: bounds and numbers, in the first used columns.
    bound, node, used = np.full((n, 4), -np.inf), np.zeros((n, 4), dtype=np.int64), np.ones(n, dtype=np.int64)
    bound[:, 0] = pair_bounds(real, low[:1], high[:1]) + slack
    active = np.arange(n)
    while len(active):
        place = bound[active].argmax(1)
        still = bound[active, place] >= floor_s[active]
        active, place = active[still], place[still]
        at = node[active, place]
        bound[active, place] = -np.inf
        inner = left[at] >= 0
        rows, parent = active[inner], at[inner]
        if len(rows):
            if used[rows].max() == bound.shape[1]:
                bound, node = np.concatenate([bound, np.full_like(bound, -np.inf)], axis=1), np.concatenate([node, np.zeros_like(node)], axis=1)
            for child, free in ((left[parent], place[inner]), (right[parent], used[rows])):
                bound[rows, free], node[rows, free] = pair_bounds(real[rows], low[child], high[child]) + slack[rows], child
            used[rows] += 1
        asking, leaf = active[~inner], at[~inner]
        by_leaf = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for rows in np.split(by_leaf, cuts) if len(leaf) else []:
            which, rows = int(leaf[rows[0]]), asking[rows]
            a, b = tree["begin"][which], tree["stop"][which]
            s = products(q[rows], tree["v"][a:b])
            rank = tree["perm"][a:b]
            good = ((s > floor_s[rows, None]) | ((s == floor_s[rows, None]) & (rank[None, :] < floor_r[rows, None]))) & (tree["ids"][rank][None, :] != qid[rows, None])
            some = good.any(1)
            if not some.any():
                continue
            rows, s, good = rows[some], s[some], good[some]
            all_s = np.concatenate([best_s[rows], np.where(good, s, _LONG.min)], axis=1)
            all_r = np.concatenate([best_r[rows], np.where(good, rank[None, :], len(tree["ids"]))], axis=1)
            best = np.lexsort((all_r, ~all_s), axis=1)[:, :k]
            best_s[rows], best_r[rows] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_r, best, 1)
            full = best_r[rows, -1] < len(tree["ids"])
            floor_s[rows[full]], floor_r[rows[full]] = best_s[rows[full], -1], best_r[rows[full], -1]
    row, place = np.nonzero(best_r < len(tree["ids"]))
    return row, tree["ids"][best_r[row, place]], best_s[row, place]


# --- the distributed search -------------------------------------------------------------------------------------------

FOUND = "query_id long, vec_id long, score long"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def can_reach(v: F.Column, low: F.Column, high: F.Column, kth: F.Column) -> F.Column:
    """Whether a box may hold a vector that scores kth or more for v, with slack for rounding; in built-in expressions."""
    number = lambda x: x.cast("double")
    sides = F.arrays_zip(v.alias("q"), low.alias("l"), high.alias("h"))
    most = F.aggregate(sides, F.lit(0.0), lambda t, x: t + F.greatest(number(x["q"]) * number(x["l"]), number(x["q"]) * number(x["h"])))
    size = F.aggregate(sides, F.lit(0.0), lambda t, x: t + F.abs(number(x["q"])) * F.greatest(F.abs(number(x["l"])), F.abs(number(x["h"]))))
    return most + size * 2.0**-40 >= kth


def topk_search(vectors: DataFrame, is_query: Callable, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest products of every row for which is_query(id column) holds."""
    base = written(quantised(vectors, id_column, vector_column).withColumn("dim", F.size("v")), "vectors")
    counts = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each vector length
    total = sum(counts.values())
    hold = {dim: max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(dim, 1)))) for dim in counts}
    cells = {}
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = base.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE).select("dim", "v").toPandas()
    for dim, n in counts.items():
        seen = drawn["v"][drawn["dim"] == dim]
        cells[dim] = split_cells(_matrix(seen), max(1, min(MAX_CELLS, n // hold[dim]))) if len(seen) else 0  # a length that the sample misses is one cell
    session_cells = cells

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), dtype=np.int64)
            for dim in pdf["dim"].unique():
                rows = np.flatnonzero(pdf["dim"].to_numpy() == dim)
                part = np.zeros(len(rows), dtype=np.int64)
                assign_cells(session_cells[int(dim)], _matrix(pdf["v"].iloc[rows]), part, np.arange(len(rows)))
                cell[rows] = part
            yield pdf.assign(cell=cell)

    placed = written(base.mapInPandas(place, "id long, v array<long>, dim int, cell long"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()  # at most MAX_CELLS rows for each length
    pieces = spark_map(placed.sparkSession, [(r["dim"], r["cell"], -(-r["n"] // hold[r["dim"]])) for r in sizes])
    sharded = placed.join(F.broadcast(pieces), ["dim", "cell"]).select("id", "v", F.concat_ws("_", "dim", "cell").alias("cell"), F.pmod(F.xxhash64("id", "v"), F.col("pieces")).alias("piece"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(pdf["id"].to_numpy(np.int64), _matrix(pdf["v"]))
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "piece": [pdf["piece"].iloc[0]], "low": [tree["low"][0]], "high": [tree["high"][0]], "tree": [pickle.dumps(tree)]})

    trees = written(sharded.groupBy("cell", "piece").applyInPandas(build, "cell string, piece long, low array<long>, high array<long>, tree binary"), "trees")
    asked = sharded.filter(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q")).select(F.col("id").alias("query_id"), F.col("q.v").alias("v"), F.col("q.cell").alias("home"))
    asked = written(asked, "queries")
    sides = trees.select("cell", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("low") - 1).alias("at"), "low", "high")).alias("x")).filter("x.low is not null").groupBy("cell", "x.at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    corners: dict[str, list] = {r["cell"]: [] for r in trees.select("cell").distinct().collect()}
    for r in sides.collect():  # of at most MAX_CELLS cells for each length
        corners[r["cell"]].append((r["at"], r["low"], r["high"]))
    boxes = [(cell, *(np.array([x[i] for x in sorted(own)], dtype=np.int64) for i in (1, 2))) for cell, own in sorted(corners.items())]
    shared_boxes = placed.sparkSession.sparkContext.broadcast(boxes)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(left):
            q, qid = _matrix(left["v"]), left["query_id"].to_numpy(np.int64)
            for blob in right["tree"]:
                row, vec, score = search_tree(pickle.loads(blob), qid, q, k, left["kth"].to_numpy(np.int64), left["kth_id"].to_numpy(np.int64))
                out.append((qid[row], vec, score))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def visit(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The queries with the shards they visit, and what they find there. Searches the trees of the shards whose boxes can beat the k-th scores of queries, in the cells that routed names; a tree is copied for each block of them."""
        own = trees.select("cell", "piece", "low", "high")
        near = written(routed.join(own, "cell").filter(can_reach(F.col("v"), F.col("low"), F.col("high"), F.col("kth"))).drop("low", "high"), "near")
        blocks = near.groupBy("cell", "piece").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))  # at most a row for each shard
        there = trees.select("cell", "piece", "tree").join(blocks, ["cell", "piece"]).select("cell", "piece", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        here = near.join(blocks, ["cell", "piece"]).withColumn("block", F.pmod(F.hash("query_id"), F.col("blocks"))).drop("blocks")
        keys = ["cell", "piece", "block"]
        return near, here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(search, FOUND)

    def route(first: int, stop: int) -> Callable:
        """Queries with each cell at places first to stop of their orders whose bound can still beat the k-th score."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by_dim: dict[int, list] = {}
            for cell, low, high in shared_boxes.value:
                by_dim.setdefault(int(cell.split("_")[0]), []).append((cell, low, high))
            for pdf in batches:
                for dim, whole in pdf.groupby(pdf["v"].map(len)):
                    names = np.array([b[0] for b in by_dim[dim]], dtype=object)
                    low, high = (np.stack([b[i] for b in by_dim[dim]]) for i in (1, 2))
                    for at in range(0, len(whole), ROUTE_BLOCK):
                        group = whole.iloc[at : at + ROUTE_BLOCK]
                        q = _matrix(group["v"])
                        bound = box_bounds(q, low, high) + _slack(q, low, high)[:, None]
                        bound[names[None, :] == group["home"].to_numpy(object)[:, None]] = np.inf  # its own cell is first
                        order = np.argsort(-bound, axis=1, kind="stable")[:, first:stop]
                        row, place = np.nonzero(np.take_along_axis(bound, order, 1) >= group["kth"].to_numpy(np.int64)[:, None])
                        yield group.iloc[row][["query_id", "v", "kth", "kth_id"]].assign(cell=names[order[row, place]])

        return run

    none, first_id = F.lit(_LONG.min).cast("long"), F.lit(_LONG.max).cast("long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, begin, width = None, 0, 1
    longest = max([sum(1 for s, _, _ in boxes if int(s.split("_")[0]) == dim) for dim in counts], default=0)
    while begin < longest or best is None:
        known = asked.withColumns({"kth": none, "kth_id": first_id})
        if best is not None:  # the k-th of each query that has k results
            reached = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("s"), F.col("vec_id").alias("i"))
            known = asked.join(reached, "query_id", "left").select("query_id", "v", "home", F.coalesce("s", none).alias("kth"), F.coalesce("i", first_id).alias("kth_id"))
        routed = written(known.mapInPandas(route(begin, begin + width), "query_id long, v array<long>, kth long, kth_id long, cell string"), "routed")
        if best is not None and routed.limit(1).count() == 0:  # bounds only fall along an order: nothing further on can be better
            dropped(routed)
            break
        near, found = visit(routed)
        if best is not None:
            found = best.drop("rank").unionByName(found)
        earlier = [best] if best is not None else []
        best = written(found.withColumn("rank", rank).filter(F.col("rank") <= k), "best")
        dropped(routed, near, *earlier)
        begin, width = begin + width, FIRST if begin == 0 else width * GROWTH
    dropped(base, placed, trees, asked)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def spark_map(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "dim int, cell long, pieces int")


def op1_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk_search(vectors, lambda i: i % 20 == 0, k=20)


QUERIES = {"op1_kdtree_topk": op1_kdtree_topk}
ORACLES = {
    "op1_kdtree_topk": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
