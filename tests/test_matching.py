"""Matching and scores against a sequential reading of the rules, always with duplicates and ties."""

import random

import pytest

from spanloom.operators import matching, metrics

SCHEMA = "rec int, start int, end int, label string, ordinal int"


def sequential(gold, pred):
    """Counts of one record, by taking the rules one after another."""
    g, p = sorted(gold, key=lambda m: (m[0], m[2], m[3])), sorted(pred, key=lambda m: (m[0], m[2], m[3]))
    n = dict.fromkeys(matching.COUNTS, 0)
    for m in list(g):
        for q in p:
            if q[:3] == m[:3]:
                g.remove(m), p.remove(q)
                n["correct"] += 1
                break
    for m in list(g):
        near = [q for q in p if q[2] == m[2] and q[0] < m[1] and m[0] < q[1]]
        if near:
            p.remove(min(near, key=lambda q: (q[1] - q[0], p.index(q))))
            g.remove(m)
            n["partial"] += 1
    for m in list(g):
        same = [q for q in p if q[:2] == m[:2] and q[2] != m[2]]
        if same:
            p.remove(same[0]), g.remove(m)
            n["incorrect"] += 1
    n["missed"], n["spurious"] = len(g), len(p)
    return n


def mentions(rng, n):
    out = []
    for i in range(n):
        s = rng.randint(0, 6)
        out.append((s, s + rng.randint(0, 4), rng.choice("AB"), i))
    return out


def totals(spark, gold, pred):
    row = lambda side: [(r, *m) for r, ms in enumerate(side) for m in ms]
    return matching.outcomes(matching.both_sides(spark.createDataFrame(row(gold), SCHEMA), spark.createDataFrame(row(pred), SCHEMA), ["rec"]), ["rec"])


def test_random_records_match_the_sequential_rule(spark):
    rng = random.Random(5)
    gold, pred = ([mentions(rng, rng.randint(0, 7)) for _ in range(600)] for _ in range(2))
    found = {r: dict.fromkeys(matching.COUNTS, 0) for r in range(600)}
    for row in totals(spark, gold, pred).collect():
        for c in matching.COUNTS:
            found[row.rec][c] += row[c]
    for r in range(600):
        assert found[r] == sequential(gold[r], pred[r]), (gold[r], pred[r])


def test_hand_case(spark):
    gold = [[(0, 5, "A", 0), (10, 20, "B", 1), (30, 35, "C", 2), (40, 45, "D", 3), (50, 55, "E", 4)]]
    pred = [[(0, 5, "A", 0), (10, 15, "B", 1), (30, 35, "D", 2)]]
    total = metrics.label_scores(totals(spark, gold, pred)).filter("label is null").first()
    assert [total[c] for c in matching.COUNTS] == [1, 1, 1, 2, 0]
    assert [total[c] for c in ("precision", "recall", "f1", "accuracy")] == pytest.approx([0.5, 0.3, 0.375, 0.3])


def test_ties_keep_the_input_order(spark):
    gold = [[(0, 4, "A", 0), (0, 6, "A", 1), (0, 4, "A", 2)]]
    pred = [[(0, 4, "A", 0), (1, 3, "A", 1), (5, 9, "A", 2)]]
    found = totals(spark, gold, pred).first()
    assert {c: found[c] for c in matching.COUNTS} == sequential(gold[0], pred[0])


def test_no_mentions(spark):
    none = spark.createDataFrame([], SCHEMA)
    both = matching.both_sides(none, none, ["rec"])
    assert matching.outcomes(both, ["rec"]).count() == 0
    total = metrics.label_scores(matching.outcomes(both, ["rec"]))
    assert [tuple(r[c] for c in ("f1", "accuracy")) for r in total.collect()] in ([], [(0.0, 0.0)])
