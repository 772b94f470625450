"""Top-k search and exact dedup against brute force, on ties, nulls, repeats and empty tables."""

import hashlib
import pickle
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, topk_search

VECTORS = "vec_id long, embedding array<double>, score string, rank string"


def brute(rows, is_query, k):
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, q in asked.items():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def searched(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    out = topk_search.topk_search(df, lambda i: i % 20 == 0, k=k).select("query_id", "rank", "vec_id", "score")
    return sorted(tuple(r) for r in out.collect())


def test_topk_random_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk_search, "LEAF", 8)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(150)]  # many equal vectors
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (None, [1.0] * 6), (2080, [1.0, 2.0]), (2081, [1.0, 3.0]), (2100, []), (40, [0.3] * 6)]
    assert searched(spark, rows) == brute(rows, lambda i: i % 20 == 0, 5)


def test_topk_of_lengths_that_the_sample_misses(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SAMPLE", 64)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(2000)] + [(3000, [1.0, 2.0]), (3001, [0.5, -1.0])]
    assert searched(spark, rows) == brute(rows, lambda i: i % 20 == 0, 5)


def test_topk_moves_trees_in_proportion(spark, monkeypatch):
    """Vectors moved with trees grow with the vectors and with the visits of queries, not with their product."""
    for name, value in (("SHARD_ROWS", 100), ("QUERY_BLOCK", 100)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(6)
    moved, keep = {}, topk_search.written
    for n in (1000, 4000):
        copies = []

        def seen(df, name, copies=copies):
            out = keep(df, name)
            if name == "near":
                copies += [-(-r["count"] // 100) for r in out.groupBy("cell", "piece").count().collect()]
            return out

        monkeypatch.setattr(topk_search, "written", seen)
        centres = rng.normal(size=(8, 3)) * 20
        rows = [(i, (centres[i % 8] + rng.normal(size=3)).tolist()) for i in range(n)]
        assert len(searched(spark, rows)) == n // 20 * 5
        moved[n] = sum(copies)
    assert moved[4000] <= 6 * moved[1000]  # four times the vectors and queries; the product would be sixteen


def test_shards_keep_their_size_while_the_table_grows(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 100), ("MAX_CELLS", 4), ("ROUTE_BLOCK", 7)):
        monkeypatch.setattr(topk_search, name, value)
    rng, keep, largest = np.random.default_rng(12), topk_search.written, {}
    for n in (1000, 4000):
        sizes = []

        def seen(df, name, sizes=sizes):
            out = keep(df, name)
            if name == "trees":
                sizes += [len(pickle.loads(r.tree)["ids"]) for r in out.select("tree").collect()]
            return out

        monkeypatch.setattr(topk_search, "written", seen)
        rows = [(i, rng.normal(size=3).round(2).tolist()) for i in range(n)] + [(n + i, [0.5, 0.5, 0.5]) for i in range(n // 4)]
        assert searched(spark, rows) == brute(rows, lambda i: i % 20 == 0, 5)
        largest[n] = max(sizes)
        assert len(sizes) >= n // 100 and sum(sizes) == len(rows)
    assert largest[4000] < 300 > largest[1000]  # shards are dealt by hash, and equal vectors of different ids spread


def test_most_boxes_are_never_looked_at(monkeypatch):
    """A search from the root leaves most of a tree's boxes alone, and finds what a search through all rows finds."""
    monkeypatch.setattr(topk_search, "LEAF", 16)
    rng = np.random.default_rng(13)
    v = (rng.integers(-60, 60, (64, 4))[rng.integers(0, 64, 20_000)] * 30 + rng.integers(-20, 20, (20_000, 4))).astype(np.int64)
    tree = topk_search.build_tree(np.arange(len(v)), v)
    asked, looked = np.arange(0, len(v), 100), []
    plain = topk_search.pair_bounds
    monkeypatch.setattr(topk_search, "pair_bounds", lambda q, low, high: looked.append(len(q)) or plain(q, low, high))
    lowest, last = np.full(len(asked), np.iinfo(np.int64).min), np.full(len(asked), np.iinfo(np.int64).max)
    row, ids, score = topk_search.search_tree(tree, asked, v[asked], 5, lowest, last)
    expected = {i: sorted((-s, j) for j, s in enumerate((v[q] @ v.T).tolist()) if j != q)[:5] for i, q in enumerate(asked.tolist())}
    found = {i: sorted((-s, j) for r, j, s in zip(row.tolist(), ids.tolist(), score.tolist()) if r == i) for i in range(len(asked))}
    leaves = sum(child < 0 for child in tree["left"])
    assert found == expected and sum(looked) < 0.1 * leaves * len(asked)


def test_topk_few_and_none(spark):
    assert searched(spark, [(0, [1.0, 0.0]), (7, [0.0, 1.0])]) == [(0, 1, 7, 0)]
    assert searched(spark, [(0, [1.0])]) == []
    assert searched(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    tree = topk_search.build_tree(np.arange(300), rng.integers(-90, 90, (300, 4)))
    q = rng.integers(-90, 90, (5, 4))
    for at in range(len(tree["low"])):
        inside = tree["v"][tree["begin"][at] : tree["stop"][at]]
        assert (topk_search.products(q, inside).max(1) <= topk_search.box_bounds(q, tree["low"][[at]], tree["high"][[at]])[:, 0]).all()


def test_large_products_do_not_round():
    q = np.array([[2**40 + 1, 1]])
    assert topk_search.products(q, np.array([[2**20, 1]]))[0, 0] == (2**40 + 1) * 2**20 + 1


TEXTS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (2, ""), (8, " "), (8, " "), (None, "c"), (7, "c"), (None, "only"), (6, "x" * 200_000), (1, "x" * 200_000 + " ")]


def test_exact_dedup(spark, documents):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    expected = []
    for i, t in TEXTS:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    found = exact_dedup.exact_dedup(documents(TEXTS)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)
    assert exact_dedup.exact_dedup(documents([])).count() == 0


def test_tree_merge_rounds_and_verification(spark):
    rows = spark.range(2000).select((F.col("id") % 90).alias("id"), F.unhex(F.sha2((F.col("id") % 30).cast("string"), 256)).alias("digest"), (F.col("id") % 30).alias("check"), F.lit(1).alias("size"), (F.col("id") % 100).cast("int").alias("run"))
    merged = exact_dedup.tree_merge(rows, 100).collect()
    plan = exact_dedup.tree_merge(rows, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 6 and "HashAggregate" not in plan  # three rounds, each folds sorted rows before and after the exchange
    assert len(merged) == 30 and sorted(r.id for r in merged) == list(range(30)) and sum(r.n for r in merged) == 2000
    with pytest.raises(Exception, match="equal digests"):
        exact_dedup.tree_merge(rows.withColumn("check", F.col("id")), 100).collect()
