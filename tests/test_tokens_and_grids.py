"""Tokens against Python's own expressions, and decoding against plain path enumeration."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as fn
from spanloom.functions.tiling import exploded, with_alignment, with_pieces, with_tokens
from spanloom.operators import decode, structure, tokens

ALPHABET = ["a", "Z", "é", "_", "7", " ", "\n", "\t", " ", "-", ".", "😀", "ß", "中", "'"]


def plain_tokens(text, tags=()):
    edges = {0, len(text)} | {e for m in re.finditer(r"\w+|[^\w\s]", text) for e in m.span()} | {e for t in tags for e in t}
    cuts = sorted(edges)
    return [(a, b, text[a:b]) for a, b in zip(cuts, cuts[1:]) if text[a:b] and not text[a:b].isspace()]


SPANS = "id int, text string, spans array<struct<start:int,end:int,tag:string>>"


def test_tokens_and_cuts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(300)]
    tags = [[tuple(sorted(rng.sample(range(len(t) + 1), 2))) for _ in range(rng.randint(0, 3))] if len(t) > 1 else [] for t in texts]
    df = spark.createDataFrame([(i, t, [(a, b, "x") for a, b in tags[i]]) for i, t in enumerate(texts)] + [(998, "a b", None), (999, None, None)], SPANS)
    for out, cut in ((tokens.tokens(df, ["id"]), False), (exploded(tokens.cut_at_spans(df), ["id"], "tokens"), True)):
        found = {}
        for r in out.orderBy("id", "pos").collect():
            found.setdefault(r.id, []).append((r.start, r.end, r.token))
        for i, t in enumerate(texts):
            assert found.get(i, []) == plain_tokens(t, tags[i] if cut else ()), (t, tags[i])


def plain_fit(cut, start, end):
    """first, last, n_tokens and aligned of a span among tokens (start, end, ...)."""
    inside = [i for i, (a, b, *_) in enumerate(cut) if a >= start and b <= end]
    fit = bool(inside) and (cut[inside[0]][0], cut[inside[-1]][1]) == (start, end)
    return (inside[0], inside[-1], len(inside), fit) if inside else (None, None, 0, False)


def test_alignment_equals_a_search_through_all_tokens(spark):
    """Spans of any place and order, beyond the text, empty, repeated; with cuts at their edges, and over the uncut tokens."""
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(200)]
    spans = [[(a := rng.randint(-1, len(t) + 2), a + rng.randint(-1, 9), "x") for _ in range(rng.randint(0, 4))] for t in texts]
    df = spark.createDataFrame([(i, t, spans[i]) for i, t in enumerate(texts)] + [(900, "a b", None), (901, None, [(0, 1, "x")]), (902, "ab", [(0, 2, "x"), (0, 2, "x"), (None, 2, "x")])], SPANS)
    clip = lambda t, s: tuple(min(max(x, 0), len(t)) for x in s[:2])
    for made, cut in ((tokens.cut_at_spans(df, words=False), True), (with_alignment(with_tokens(df, words=False)), False)):
        rows = {r.id: r.spans for r in made.collect()}
        for i, t in enumerate(texts):
            own = plain_tokens(t, [clip(t, s) for s in spans[i]] if cut else ())
            assert [(s.start, s.end, s.tag, s.first, s.last, s.n_tokens, s.aligned) for s in rows[i]] == [(*s, *plain_fit(own, *s[:2])) for s in spans[i]], (t, spans[i])
        assert rows[900] is None and not rows[901][0].aligned and [s.aligned for s in rows[902]] == [True, True, False]


def test_alignment_moves_no_text_and_cuts_once(spark):
    from spanloom.plans import queries

    for name in ("span_alignment", "converted_records", "bio_labels", "padded_labels"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Scan parquet") == 1 and plan.count("MapInArrow") == 2, name


def test_alignment_contract(spark):
    df = spark.createDataFrame([(1, "ab cd", [(0, 2, "x"), (2, 5, "y")])], SPANS)
    out = tokens.cut_at_spans(df)
    assert {s.tag: s.aligned for s in out.first().spans} == {"x": True, "y": False}  # y begins with a blank
    for checked in (tokens.require_aligned(out), tokens.converted(out, ["id"])):
        with pytest.raises(Exception, match="span alignment failed for 2-5"):
            checked.collect()


def test_role_order(spark):
    rows = spark.createDataFrame([(0, 0, 0, 5), (1, 2, 0, 5), (0, 2, 0, 5), (4, 6, 0, 5)], "ts int, te int, ss int, se int")
    assert [r[0] for r in rows.select(fn.token_role(F.col("ts"), F.col("te"), F.col("ss"), F.col("se"))).collect()] == ["N", "I", "B", "O"]


def paths(links, head, tail):
    if head == tail:
        return [(head,)]
    return [(head, *rest) for a, b in links if a == head and b <= tail for rest in paths(links, b, tail)]


def test_decode_random_grids(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for rec in range(120):
        n = rng.randint(1, 7)
        scores = {(i, j, c): rng.choice([0.2, 0.5, 0.9]) for i in range(n) for j in range(n) for c in (1, 2, 3) if rng.random() < 0.6}
        rows += [(rec, i, j, c, s) for (i, j, c), s in scores.items()]
        links = sorted((i, j) for (i, j, c), s in scores.items() if c == 1 and s > 0.5 and i < j)
        expected[rec] = {(p, c) for (tail, head, c), s in scores.items() if c > 1 and s > 0.5 and head <= tail for p in paths(links, head, tail)}
    grid = spark.createDataFrame(rows, "rec int, row int, col int, channel int, score double")
    found = {r: set() for r in expected}
    for r in decode.decode(grid, ["rec"], F.lit(0.5), F.lit(0.5)).collect():
        found[r.rec].add((tuple(r["index"]), r.type))
    assert found == expected


def test_decode_keeps_entities_of_any_length(spark):
    n = 130
    grid = spark.createDataFrame([(1, i, i + 1, 1, 0.9) for i in range(n - 1)] + [(1, n - 1, 0, 2, 0.9)], "rec int, row int, col int, channel int, score double")
    assert [(list(r["index"]), r.type) for r in decode.decode(grid, ["rec"], F.lit(0.5), F.lit(0.5)).collect()] == [(list(range(n)), 2)]


def test_counts_equal_enumeration_on_random_grids(spark):
    """Every cell, with references that are predicted, half predicted, repeated and wrong; records of one side only."""
    from test_matching import sequential

    rng = random.Random(17)
    rows, golds, expected = [], [], {}
    cells = [(i, n, h) for i, (n, h) in enumerate((n, h) for n in (0.1, 0.5, 0.8) for h in (0.3, 0.8))]
    for rec in range(80):
        n = rng.randint(1, 7)
        scores = {(i, j, c): rng.choice([0.2, 0.5, 0.6, 0.9]) for i in range(n) for j in range(n) for c in (1, 2, 10) if rng.random() < 0.7} if rec % 9 else {}
        rows += [(rec, i, j, c, s) for (i, j, c), s in scores.items()] + [(rec, i, j, c, 0.1) for i, j, c in list(scores)[:3]]
        own = [(tuple(sorted(rng.sample(range(n), rng.randint(1, min(n, 3))))), rng.choice([2, 10])) for _ in range(rng.randint(0, 4))] if rec % 7 else []
        golds += [(rec, list(p), c) for p, c in own + own[:1]]
        true = sorted(set(own))
        for cell, t, h in cells:
            links = sorted((i, j) for (i, j, c), s in scores.items() if c == 1 and s > t and i < j)
            found = sorted({(p, c) for (tail, head, c), s in scores.items() if c > 1 and s > h and head <= tail for p in paths(links, head, tail)})
            mentions = lambda xs: [(p[0], p[-1] + 1, str(c), i) for i, (p, c) in enumerate(xs)]
            counts = sequential(mentions(true), mentions(found)) | {"same_entities": len(set(found) & set(true)), "predicted": len(found), "relevant": len(true)}
            expected[cell] = {k: expected.get(cell, {}).get(k, 0) + v for k, v in counts.items()}
    grid = spark.createDataFrame(rows, "rec int, row int, col int, channel int, score double")
    gold = spark.createDataFrame(golds, "rec int, index array<int>, type int")
    out = {r.cell: {k: r[k] for k in expected[0]} for r in decode.cell_counts(grid, gold, cells, ["rec"]).collect()}
    assert out == expected
    one = decode.entity_counts(grid, gold, ["rec"], 0.5, 0.8).first()
    assert (one.correct, one.predicted, one.relevant) == tuple(expected[3][k] for k in ("same_entities", "predicted", "relevant"))
    assert tuple(decode.entity_counts(grid.limit(0), gold.limit(0), ["rec"], 0.5, 0.8).first())[:3] == (0, 0, 0)


def test_complete_grids_are_counted_without_listing(spark):
    """A complete grid of n tokens has 2 ** (n - 2) chains from its first to its last."""
    rows = [(n, i, j, 1, 0.9) for n in (40, 70) for i in range(n) for j in range(i + 1, n)] + [(n, n - 1, 0, 2, 0.9) for n in (40, 70)]
    grid = spark.createDataFrame(rows, "rec int, row int, col int, channel int, score double")
    gold = spark.createDataFrame([(40, [0, 5, 39], 2), (40, [0, 39], 3)], "rec int, index array<int>, type int")
    found = decode.cell_counts(grid.filter("rec = 40"), gold, [(0, 0.5, 0.5), (1, 0.95, 0.5)], ["rec"]).orderBy("cell").collect()
    assert [(r.predicted, r.same_entities, r.relevant, r.correct, r.incorrect, r.spurious) for r in found] == [(1 << 38, 1, 2, 1, 1, (1 << 38) - 2), (0, 0, 2, 0, 0, 0)]
    assert decode.entity_counts(grid, gold, ["rec"], 0.5, 0.5).first().predicted == (1 << 38) + decode.MOST  # held at the limit of one pair


def test_one_decode_in_the_plan_of_the_sweep(spark):
    from spanloom.plans import queries

    plan = queries.QUERIES["threshold_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count(" Exchange") <= 4 and plan.count("BroadcastNestedLoopJoin") == 1  # the 192 places of a grid, in the inputs


def test_sweep_over_the_cells_of_the_reference(spark, tmp_path):
    """All 25 cells against plain enumeration and a sequential reading of the matching rules."""
    from test_matching import sequential

    from spanloom.operators import metrics
    from spanloom.plans import queries

    docs = list(range(0, 60, 7))
    spark.createDataFrame([(d,) for d in docs], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    score = lambda d, r, c, ch: ((d * 31 + r * 17 + c * 13 + ch * 7) % 100) / 100
    gold = {d: sorted([((d % 6, d % 6 + 1), 2), ((d % 6,), 3)]) for d in docs}
    mentions = lambda found: [(p[0], p[-1] + 1, str(c), i) for i, (p, c) in enumerate(found)]
    expected = {}
    for n in (0.3, 0.4, 0.5, 0.6, 0.7):
        links = {d: [(i, j) for i in range(8) for j in range(i + 1, 8) if score(d, i, j, 1) > n] for d in docs}
        for h in (0.3, 0.4, 0.5, 0.6, 0.7):
            total = dict.fromkeys([*metrics.COUNTS, "same_entities", "predicted", "relevant"], 0)
            for d in docs:
                found = sorted({(p, c) for t in range(8) for a in range(t + 1) for c in (2, 3) if score(d, t, a, c) > h for p in paths(links[d], a, t) if p[-1] == t})
                counts = sequential(mentions(gold[d]), mentions(found)) | {"same_entities": len(set(found) & set(gold[d])), "predicted": len(found), "relevant": len(gold[d])}
                total = {k: total[k] + counts[k] for k in total}
            expected[n, h] = total
    out = queries.QUERIES["threshold_sweep"](spark, str(tmp_path)).collect()
    assert {(r.next_threshold, r.head_threshold): {k: r[k] for k in expected[0.3, 0.3]} for r in out} == expected and len(out) == 25
    for r in out:
        hit, p, q = r.correct + 0.5 * r.partial, r.correct + r.incorrect + r.partial + r.spurious, r.correct + r.incorrect + r.partial + r.missed
        assert abs(r.precision - hit / p) < 1e-12 and abs(r.recall - hit / q) < 1e-12
    best = queries.QUERIES["best_threshold"](spark, str(tmp_path)).first()
    assert best == max(out, key=lambda r: (r.f1, r.precision, r.recall, -r.cell))
    assert queries.QUERIES["flat_sweep"](spark, str(tmp_path)).count() == 30


def test_thresholds_are_numbers(spark):
    from spanloom.functions.text import parse_numbers

    listed = spark.range(1).select(parse_numbers(F.lit("0.5, 0.7")).alias("n")).first().n
    assert [tuple(r) for r in decode.threshold_grid(spark, listed, [0.1]).collect()] == [(0, 0.5, 0.1), (1, 0.7, 0.1)]


def test_long_texts_are_cut_in_slices(spark, monkeypatch):
    from spanloom.functions import tiling

    rng = random.Random(8)
    text = "".join(rng.choices(ALPHABET, k=700_000))
    assert len(text.encode()) > tiling.SLICE / 4
    rows = [(1, text * 3), (2, "a b"), (3, text[:50])]
    df = spark.createDataFrame(rows, "id int, text string")
    found = {r.id: (r.n, r.last) for r in tokens.tokens(df, ["id"]).groupBy("id").agg(F.count("*").alias("n"), F.max("end").alias("last")).collect()}
    for i, t in rows:
        whole = plain_tokens(t)
        assert found[i] == (len(whole), whole[-1][1])


def test_lines_with_offsets(spark):
    from spanloom.functions.tiling import exploded, with_lines

    rows = [(1, "a\n\u00e9\U0001f600\n"), (2, ""), (3, None), (4, "\n\n"), (5, "x"), (6, "")]
    found = exploded(with_lines(spark.createDataFrame(rows, "id int, text string")), ["id"], "lines").drop("end").collect()
    expected = []
    for i, t in rows:
        at = 0
        for n, line in enumerate(t.split("\n") if t is not None else []):
            expected.append((i, n, at, line))
            at += len(line) + 1
    assert sorted(map(tuple, found)) == sorted(expected)


def test_subword_plug_in_and_padding(spark):
    pieces = lambda texts: [[(i, min(i + 4, len(t))) for i in range(0, len(t), 4)] for t in texts]
    df = spark.createDataFrame([(1, "abc😀ef"), (2, ""), (3, None)], "id int, text string")
    cut = tokens.subword_tokens(df, ["id"], pieces)
    assert [tuple(r) for r in cut.orderBy("pos").collect()] == [(1, 0, 0, 4, "abc😀"), (1, 1, 4, 6, "ef")]
    spans = "array(named_struct('start', 0, 'end', 6, 'label', 'B'), named_struct('start', 4, 'end', 6, 'label', 'A'), named_struct('start', 4, 'end', 6, 'label', 'A'), named_struct('start', 0, 'end', 4, 'label', 'none'))"
    both = with_pieces(df, pieces).withColumn("spans", F.expr(spans))
    labels = spark.createDataFrame([(0, "A"), (1, "B")], "label_id int, label string")
    assert [tuple(r) for r in tokens.bio_labels(both, labels, ["id"], 3).orderBy("pos", "label_id").collect()] == [(1, 0, 3), (1, 1, 1), (1, 1, 4)]
    assert [tuple(r) for r in tokens.bio_labels(both, labels, ["id"], 1).collect()] == [(1, 0, 3)]  # what lies beyond is cut
    row = lambda lengths: [tuple(r) for r in tokens.padded_labels(both, labels, ["id"], lengths).collect()]
    assert row((3, 8)) == [(1, 3, [1, 1, 0], [1 << 3, 1 << 1 | 1 << 4, 0])] and row((1,)) == [(1, 1, [1], [1 << 3])]


def test_labels_equal_a_search_through_all_tokens(spark):
    """Many labels (two longs a position), spans over several tokens, several rows, lengths that cut."""
    rng = random.Random(6)
    names = {f"N{i}": i for i in range(50)}
    texts = [" ".join(rng.choices(["a", "bcd", "ef"], k=rng.randint(0, 12))) for _ in range(80)]
    spans = [[(a := rng.randint(0, 20), a + rng.randint(0, 9), rng.choice(list(names))) for _ in range(rng.randint(0, 5))] for t in texts]
    df = spark.createDataFrame([(i, t, spans[i]) for i, t in enumerate(texts)], "id int, text string, spans array<struct<start:int,end:int,label:string>>")
    labels = spark.createDataFrame([(i, n) for n, i in names.items()], "label_id int, label string")
    made = with_tokens(df)
    bits = {r.id: r for r in tokens.padded_labels(made, labels, ["id"], (4, 8)).collect()}
    bio = {}
    for r in tokens.bio_labels(made, labels, ["id"], 8).collect():
        bio.setdefault(r.id, set()).add((r.pos, r.label_id))
    for i, t in enumerate(texts):
        own = plain_tokens(t)[:8]
        expected = {(p, 2 * names[n] + (1 if a == s else 2)) for s, e, n in spans[i] for p, (a, b, _) in enumerate(own) if a >= s and b <= e}
        assert bio.get(i, set()) == expected
        if own:
            r = bits[i]
            held = {(p, 64 * w + b) for p in range(r.padded_to) for w in range(2) for b in range(64) if r.label_bits[2 * p + w] >> b & 1}
            assert held == expected and r.padded_to == (4 if len(own) <= 4 else 8) and r.loss_mask == [1] * len(own) + [0] * (r.padded_to - len(own))
        else:
            assert i not in bits


def test_slices_of_a_batch_are_worked_on_alone(monkeypatch):
    """Lists in the middle of a batch, with nulls, give what they give by themselves."""
    from spanloom.functions import tiling

    rng = random.Random(7)
    rows = []
    for i in range(60):
        cuts = sorted(rng.sample(range(60), 2 * rng.randint(0, 9)))
        tokens_ = [{"pos": k, "start": a, "end": b} for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
        spans = [{"start": (a := rng.randint(0, 50)), "end": a + rng.randint(0, 12), "label": rng.choice("ab")} for _ in range(rng.randint(0, 4))]
        rows.append({"i": i, "tokens": tokens_, "spans": None if i % 11 == 0 else spans})
    kind = pa.schema([("i", pa.int32()), ("tokens", pa.list_(pa.struct([(n, pa.int32()) for n in ("pos", "start", "end")]))), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])))])
    batch = pa.RecordBatch.from_pylist(rows, schema=kind)
    names, ids = pa.array(["a", "b"]), np.array([0, 1])

    def labels(part):
        row, pos, label = tiling._labels(part, "tokens", "spans", names, ids, 5)
        return sorted(zip(part.column("i").to_numpy()[row].tolist(), pos.tolist(), label.tolist()))

    def aligned(part):
        owner, start, end, row, low, high = tiling._places(part, "tokens", "spans")
        yes = np.ones(len(row), bool)
        return tiling._align(part.column("spans"), row, low, high, owner, start, end, yes, yes).to_pylist()

    monkeypatch.setattr(tiling, "MEMBERS", 20)
    parts = list(tiling._slices(batch, "tokens"))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == 60
    assert sorted(x for p in parts for x in labels(p)) == labels(batch) and [x for p in parts for x in aligned(p)] == aligned(batch)
    assert aligned(batch)[0] is None
    for r, found in zip(rows, aligned(batch)):
        assert [(s["first"], s["last"], s["n_tokens"], s["aligned"]) for s in found or []] == [plain_fit([(t["start"], t["end"]) for t in r["tokens"]], s["start"], s["end"]) for s in r["spans"] or []]


def test_converted_records(spark):
    df = spark.createDataFrame([(1, "ab cd ef", [(3, 8, "Y"), (0, 2, "X")]), (2, "x", None), (3, " ", [])], SPANS)
    out = {r.id: (r.tokens, [(x["index"], x.type) for x in r.ner]) for r in tokens.converted(tokens.cut_at_spans(df), ["id"]).collect()}
    assert out == {1: (["ab", "cd", "ef"], [([0], "X"), ([1, 2], "Y")]), 2: (["x"], [])}


def test_conversion_stats(spark):
    rows = [(1, "", [(0, 1, "a"), (0, 1, "b"), (0, 1, "c"), (2, 3, "a"), (2, 3, "b"), (4, 5, "a")]), (2, "", None), (3, "", [(0, 1, "a")])]
    assert tuple(tokens.conversion_stats(spark.createDataFrame(rows, SPANS)).first()) == (3, 7, 1, 2, 3)


def test_block_pieces(spark):
    text = "a😀é" * 300
    cuts = [(0, 0), (0, 1), (255, 257), (256, 600), (899, 900), (900, 900), (10, 10)]
    row = spark.createDataFrame([(text,)], "t string").withColumn("b", fn.text_blocks(F.col("t")))
    assert [row.select(fn.block_piece(F.col("b"), F.lit(a), F.lit(b))).first()[0] for a, b in cuts] == [text[a:b] for a, b in cuts]


def test_structure_flags(spark):
    m = spark.createDataFrame([(1, 0, 9, "A"), (1, 0, 9, "B"), (1, 2, 4, "A"), (1, 0, 3, "A"), (1, 20, 22, "A"), (1, 2, 4, "A")], "id int, start int, end int, label string")
    assert structure.structure(m, ["id"]).count() == m.count()
    flags = {(r.start, r.end): (r.same_span, r.nested, r.flat) for r in structure.structure(m, ["id"]).collect()}
    assert flags == {(0, 9): (True, False, False), (2, 4): (False, True, False), (0, 3): (False, True, False), (20, 22): (False, False, True)}


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(fn.doc_id_from_name(F.lit("a/0text12.ann"))) == "12"
    assert value(fn.doc_id_from_name(F.lit("a/0text12.md"))) is None
    assert value(fn.record_doc_id(F.lit(""), F.lit("7_3"))) == "7"
    assert value(fn.europe_pmc_url(F.lit(""), F.lit("PMC5"), F.lit("x"))) == "https://europepmc.org/article/PMC/5"
    assert value(fn.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))) == "z"
    assert value(fn.piece(F.lit("a😀bc"), F.lit(1), F.lit(3))) == "😀b"
    assert value(fn.plain_name(F.lit("Body_Part, Organ-ism "))) == "BodyPartOrganism"
    assert value(fn.parse_numbers(F.lit("0.1,, 2 "))) == [0.1, 2.0]
    with pytest.raises(Exception, match="no numbers"):
        value(fn.parse_numbers(F.lit(" , ")))
