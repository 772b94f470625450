"""Hard negatives, whitening and sharding against plain versions, on ties, nulls, repeats, odd lengths and empty tables."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import hard_negatives, registry, sharding, whitening

VECTORS = "vec_id long, label int, embedding array<double>, id string, v string, wave string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, "a", "b", "c", "d") for i, label, v in rows], VECTORS)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


# --- hard negatives ----------------------------------------------------------------------------------------------------


def mined_plainly(rows, is_anchor):
    good = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if i is not None and label is not None and usable(v)]
    anchors = {}
    for i, label, v in good:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in good if i != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(i, -t) for t, i, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, r + 1, n, -s, t) for r, (n, t) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("skewed", [False, True])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, skewed):
    for name, value in (("ANCHOR_BYTES", 1500), ("SAMPLE", 40), ("TILE_ROWS", 64), ("TILE_ANCHORS", 3), ("PAIRS", 50)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    scale = 2.0 ** -np.arange(12) if skewed else np.ones(12)
    rows = [(i, int(rng.integers(3)), (rng.normal(size=12) * scale).round(2 if skewed else 0).tolist()) for i in range(600)]
    rows += [(1000 + i, i % 2, [1.0] * 12) for i in range(200)]  # equal vectors of two labels: ties everywhere
    rows += [(2000, None, [1.0] * 12), (2100, 1, None), (2200, 1, [None] * 12), (2300, 1, [float("nan")] * 12), (2400, 0, [1.0, 2.0]), (2401, 0, [1.0, 1.0]), (2402, 1, [1.0, 1.5]), (2500, 1, []), (None, 0, [1.0] * 12)]
    rows += [(100, 2, [0.5] * 12), (101, 1, rows[101][2])]  # an anchor's id on two rows, and a repeated row
    found = hard_negatives.mine(vectors(spark, rows), lambda i: i % 100 == 0)
    assert sorted(map(tuple, found.collect())) == mined_plainly(rows, lambda i: i % 100 == 0)


def test_hard_negatives_of_wide_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (rng.integers(-4, 5, size=3) * 2.0**20 * 1.25).tolist()) for i in range(120)]
    found = hard_negatives.mine(vectors(spark, rows), lambda i: i % 10 == 0)
    assert sorted(map(tuple, found.collect())) == mined_plainly(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(vectors(spark, []), lambda i: i % 100 == 0).collect() == []
    assert hard_negatives.mine(vectors(spark, [(100, 1, [1.0]), (101, 2, [1.0])]), lambda i: i % 100 == 0).collect() == []


def test_most_pairs_are_dropped_early():
    """Where few components hold most of the length, few pairs reach the last step."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(3000, 64)) * 256 * 0.8 ** np.arange(64)).astype(np.int64)
    turn = hard_negatives.rotation(x[:500])
    assert np.allclose(turn.T @ turn, np.eye(64))
    q, v = hard_negatives.Rotated(x[:20], turn), hard_negatives.Rotated(x, turn)
    true = x[:20] @ x.T
    floor = np.sort(true, axis=1)[:, -6].astype(float)
    a, r = hard_negatives.survivors(q, v, np.ones(true.shape, bool), floor, np.full(20, np.inf))
    assert {(i, j) for i, j in zip(*np.nonzero(true >= floor[:, None]))} <= set(zip(a.tolist(), r.tolist()))
    assert len(a) < 0.01 * true.size


# --- whitening -----------------------------------------------------------------------------------------------------------


def whitened_plainly(rows):
    good = [(i, [int(np.floor(1024 * c)) + 100000 for c in v]) for i, _, v in rows if usable(v) and v]
    x = np.array([v for _, v in good], dtype=object)
    n, s = len(x), x.sum(0)
    y = n * x - s
    e, u = np.linalg.eigh((y.T @ y).astype(float) / n**3)
    e, u = e[::-1], u[:, ::-1]
    k = min(8, len(e))
    w = (y.astype(float) / n) @ u[:, :k] / np.sqrt(e[:k])
    return [i for i, _ in good], n, (y * y).sum(1), w, e[:k] / e.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(12, 12)) / 4
    rows = [(i, 0, (rng.normal(size=12) @ mix).tolist()) for i in range(400)] + [(7, 0, [0.25] * 12), (7, 0, [0.25] * 12), (None, 0, [0.5] * 12)]
    rows += [(900, 0, None), (901, 0, [None] * 12), (902, 0, [float("inf")] * 12), (903, 0, [])]
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    ids, n, deviation, w, share = whitened_plainly(rows)
    assert len(got) == 8 * len(ids) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    assert Counter(got["vec_id"].dropna().astype(int)) == Counter(i for i in ids * 8 if i is not None)
    order = got.drop_duplicates(["vec_id", "component"]).set_index(["vec_id", "component"])
    sign = {c: np.sign(order.loc[(0, c), "whitened"] * w[0, c - 1]) for c in range(1, 9)}
    for at, i in enumerate(ids):
        if i is not None and i != 7:
            for c in range(1, 9):
                row = order.loc[(i, c)]
                assert row["deviation"] == deviation[at] and abs(row["whitened"] * sign[c] - w[at, c - 1]) < 1e-8 and abs(row["explained"] - share[c - 1]) < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, 0, None)])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, 0, [0.5, 0.25])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, c, 1, 0, 0.0, 0.0, 0.0) for c in (1, 2)]
    rows = [(i, 0, [i / 8, 1.0, -i / 8]) for i in range(9)] + [(50, 0, [0.5]), (51, 0, [0.75])]  # one dimension is constant, two depend on each other; another length
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    three = got[got["vec_id"] < 50]
    assert len(got) == 29 and np.allclose(three[three["component"] > 1]["whitened"], 0) and np.isclose(three[three["component"] == 1]["whitened"].std(ddof=0), 1)
    assert (got["identity_error"] < 1e-9).all() and sorted(got[got["vec_id"] > 49]["whitened"].round(9)) == [-1.0, 1.0]


def test_squares_are_exact_at_every_size():
    rng = np.random.default_rng(2)
    for top in (2**10, 2**33, 2**44, 2**60):
        y = rng.integers(-top, top, size=(20, 64))
        assert [int(d) for d in whitening.squares(y)] == [sum(int(x) ** 2 for x in row) for row in y]


# --- sharding --------------------------------------------------------------------------------------------------------------


def loads_plainly(texts, shards):
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 8
    heap = [(0, j) for j in range(shards)]
    for size in sorted(groups.values(), reverse=True):
        load, j = heap[0]
        heapq.heapreplace(heap, (load + size, j))
    return sorted(load for load, _ in heap)


def check_shards(rows, got, shards):
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == Counter((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8) for r in rows)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    homes, slots, sums = defaultdict(set), defaultdict(list), Counter({j: 0 for j in range(shards)})
    for r in got:
        homes[(r["size"], r["text_crc32"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(sums.values()) == loads_plainly([r[1] for r in rows], shards)


def test_sharding_against_a_heap(spark, documents):
    rng = random.Random(9)
    rows = [(i, "w" * rng.choice([3, 5, 5, 5, 40, rng.randrange(300)]) + str(i if i % 7 else 0)) for i in range(1500)]
    rows += [(2000 + i, "the same text") for i in range(600)] + [(3000, None), (3001, ""), (3002, None), (None, "x"), (5, "again"), (5, "again"), (6, "é€😀"), (7, "long " * 200_000)]
    check_shards(rows, sharding.sharded(documents(rows)).collect(), 24)


def test_sharding_of_few_rows(spark, documents):
    assert sharding.sharded(documents([])).collect() == []
    check_shards([(1, "a"), (2, "b"), (3, "b")], sharding.sharded(documents([(1, "a"), (2, "b"), (3, "b")]), shards=4).collect(), 4)


def test_dealing_runs_is_dealing_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        shards = rng.randrange(1, 9)
        loads = [(rng.randrange(0, 60), j) for j in range(shards)]
        heapq.heapify(loads)
        plain = list(loads)
        size, count, taken = rng.randrange(1, 12), rng.randrange(0, 90), Counter()
        for _ in range(count):
            load, j = plain[0]
            heapq.heapreplace(plain, (load + size, j))
            taken[j] += 1
        assert sharding.deal(loads, size, count) == sorted(taken.items()) and sorted(loads) == sorted(plain)


# --- registered queries ---------------------------------------------------------------------------------------------------


def test_registered_queries(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(10)), rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(i, f"text {i % 40}", "en", "s", 1) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    ask = lambda name: registry.QUERIES[name](spark, str(tmp_path))
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert sorted(map(tuple, ask("op11_hard_negatives").collect())) == mined_plainly(moved, lambda i: i % 100 == 0)
    white = ask("op12_whitening").toPandas()
    assert len(white) == 900 * 8 and white["identity_error"].max() < 1e-9
    check_shards(docs, ask("op13_sharding").collect(), 24)
