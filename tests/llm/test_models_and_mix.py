"""Classifier, mixing, secret scan and pipeline on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import pfair_mix, quality_gam, secret_scan
from spanloom.llm.shared import written

WORDS = "time person year way day thing man world life hand part child eye woman place work week case point number".split()


def good(rng):
    return " ".join(rng.choices(WORDS, k=rng.randint(20, 120))).capitalize() + "."


def bad(rng):
    return rng.choice([lambda: (rng.choice(WORDS) + " ") * rng.randint(30, 90), lambda: " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=40)), lambda: " ".join(w + rng.choice("$%&#") * 3 for w in rng.choices(WORDS, k=40))])()


def test_quality_learns_and_scores_every_row(spark, documents):
    rng = random.Random(2)
    rows = [(i, good(rng) if i % 3 else bad(rng)) for i in range(900)] + [(5000, None), (5001, ""), (5002, "word " * 100_000), (None, "no id"), (1, "again")]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(900)] + [(2, None, "x"), (None, 1, "x"), (1, 1, "x")], "doc_id long, quality int, text string")
    model = quality_gam.fit(docs, labels.filter(~quality_gam.held_out()), "quality")
    out = {r.doc_id: r.score for r in quality_gam.score(docs, model).filter("doc_id > 1 or doc_id = 0").collect()}
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == 902
    unseen = [r.doc_id for r in labels.filter(quality_gam.held_out()).collect() if r.doc_id in out]
    assert np.mean([(out[i] >= 0.3) == (i % 3 > 0) for i in unseen]) > 0.95
    assert quality_gam.score(docs, model).count() == len(rows)
    kept = quality_gam.accepted(docs, model, 0.3)
    assert kept.columns == docs.columns and 550 < kept.count() < 700


def test_quality_without_labels(spark, documents):
    docs = documents([(1, "some text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_gam.score(docs, quality_gam.fit(docs, none, "quality")).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality_gam.score(docs, quality_gam.fit(docs, one, "quality")).collect())
    assert quality_gam.score(documents([]), quality_gam.fit(documents([]), none, "quality")).count() == 0


def naive_score(model, row):
    """The score as a plain sum over tables, entry by entry."""
    place = lambda cuts, x: sum(x >= c for c in cuts)
    raw = model.intercept + sum(float(model.tables[j][place(model.cuts[j], row[j])]) for j in range(len(row)))
    raw += sum(float(t[place(model.coarse[a], row[a]), place(model.coarse[b], row[b])]) for a, b, t in model.pairs)
    return 1 / (1 + np.exp(-raw))


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality_gam.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction only
    model = quality_gam.AdditiveModel(x, y)
    assert (0, 1) in {(a, b) for a, b, _ in model.pairs}
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.85
    assert np.allclose(model.score(x[:100]), [naive_score(model, row) for row in x[:100]])


def test_the_fit_is_bounded_by_rows_whatever_repeats(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_gam, "AdditiveModel", lambda x, y: seen.append(len(x)))
    docs = documents([(1, f"text {i}") for i in range(300)] + [(2, "b"), (3, "c")])
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 1)], "doc_id long, quality int")
    quality_gam.fit(docs, labels, "quality")
    quality_gam.fit(docs, labels, "quality", max_rows=2)
    assert seen == [3, 2]
    many = documents([(1, f"token=abcdefghijkl{i:04}") for i in range(300)])
    monkeypatch.setattr(secret_scan, "MarkovRatio", lambda strings, labels: seen.append(sum("abcdefghijkl" in s for s in strings)))
    secret_scan.fit(many, rows=5)
    assert seen[-1] == 5


def held_out_accuracy(spark, sf_dir):
    scored = quality_gam.op4_quality_gam(spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]


def test_held_out_accuracy_on_the_test_data(spark):
    assert held_out_accuracy(spark, "/root/testdata/sf0.01") > 0.9


def held_out_strings(n=2000):
    """Random strings and identifiers of seeds and words that the models never saw."""
    words = "velvet harbour quantum ledger octopus marble thunder pixel galaxy cement lantern orbit pepper violin canyon meadow spiral anchor timber falcon".split()
    plain = [s for s in secret_scan.joined_words(words, 4 * n, seed=91) if len(s) >= secret_scan.MIN_RUN][:n]
    return secret_scan.random_strings(n, seed=92), plain


def test_markov_precision_and_recall_on_held_out_strings(spark):
    model = secret_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = []
    for strings in held_out_strings():
        data = np.frombuffer(" ".join(strings).encode(), np.uint8)
        found.append(int((secret_scan.scan_chunk(data, np.array([0, len(data)]), model)[3] >= 2).sum()))
    (right, wrong), (secrets, plain) = found, held_out_strings()
    assert right / len(secrets) > 0.85 and wrong / len(plain) < 0.02
    print("recall", right / len(secrets), "precision", right / (right + wrong))


@pytest.mark.parametrize("shares", [[500, 300, 200], [1, 1, 998], [7, 11, 13, 17], [1], [333, 333, 334]])
def test_one_cycle_stays_within_a_block(spark, shares):
    weights = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(shares)], "mix_key string, n long")
    order = [r.mix_key for r in pfair_mix.cycle(weights).orderBy("at").collect()]
    total = sum(shares)
    assert len(order) == total
    done = dict.fromkeys((f"s{i}" for i in range(len(shares))), 0)
    for t, key in enumerate(order, 1):
        done[key] += 1
        for i, n in enumerate(shares):
            assert abs(done[f"s{i}"] - t * n / total) < 1


@pytest.mark.parametrize("small", [False, True])
def test_mixture_places_every_document_once(spark, documents, monkeypatch, small):
    if small:  # many levels, eras and no broadcast
        for name, value in (("BUCKET_ROWS", 1), ("BROADCAST_SLOTS", 0), ("CYCLES", 2), ("SLOTS", 7)):
            monkeypatch.setattr(pfair_mix, name, value)
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice("aaab")) for i in range(500)] + [(600, None, "a"), (601, "y" * 9000, None), (602, "z", None), (3, "twice", "b"), (3, "twice", "b")]
    docs = documents(rows)
    placed = pfair_mix.positions(pfair_mix.scheduled(docs, block_size=500))
    found = placed.select("row.doc_id", "row.source", "mix_position", "mix_slot", "mix_block", "mix_order", "mix_size").orderBy("mix_position").collect()
    assert [r.mix_position for r in found] == list(range(len(rows)))
    assert sorted((str(r.doc_id), str(r.source)) for r in found) == sorted((str(r[0]), str(r[2])) for r in rows)
    assert [r.mix_slot for r in found] == sorted(r.mix_slot for r in found)
    running = {}
    for r in sorted(found, key=lambda r: (r.mix_order, r.doc_id, r.mix_size)):
        assert r.mix_block == running.get(r.source, 0) // 500 + 1
        running[r.source] = running.get(r.source, 0) + r.mix_size
    named = docs.withColumns({"mix_file": F.lit("f"), "mix_row": F.lit(1)})  # names that the operator uses itself
    out = pfair_mix.mixed(named, block_size=500)
    assert out.columns == named.columns and out.count() == len(rows)
    back = pfair_mix.in_mixture(written(out, "mixed"))
    assert back.columns == [*named.columns, "mix_position"]
    assert sorted((r.mix_position, str(r.doc_id)) for r in back.collect()) == [(i, str(r.doc_id)) for i, r in enumerate(found)]
    assert pfair_mix.mixed(documents([])).count() == 0
    given = pfair_mix.given_weights(docs, {"a": 3.0, "b": 1.0, "absent": 1.0})
    assert {r.mix_key: r.n for r in given.collect()} == {"sa": 600, "sb": 200, "n": 1}


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])]


def test_secrets(spark, documents):
    rng = random.Random(3)
    bits = ["password: ", "TOKEN = '", "api_key=", "apiKey:", "secret", "é", "😀 ", "\n", "AKIA", "ABCDEFGH12345678XY", "0123456789abcdef", "deadbeef", " ", "word", "=", '"', "aBc.123-xyz/ZZ", "ſecret=abcdefghijklmnop", "TOKEN=abcdefghijklmnop"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 9)))) for i in range(600)] + [(700, None), (701, ""), (702, "a " * 100_000 + "token=abcdefghijklmno"), (None, "token=abcdefghijklmno"), (5, "again")]
    docs = documents(rows)
    out = secret_scan.scan(docs, None).collect()
    found = sorted((str(r.doc_id), [f"{s.kind}:{s.start}:{s.end}" for s in r.spans]) for r in out)
    assert found == sorted((str(i), brute_spans(t or "")) for i, t in rows)
    model = secret_scan.fit(docs)
    strange, plain = "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "get_user_account_settings_by_name"
    more = secret_scan.scan(documents([(1, f"see {strange} and {plain} {'-' * 40} {'=' * 30}")]), model).first()
    assert [(s.kind, s.start, s.end) for s in more.spans] == [("markov", 4, 4 + len(strange))]
    mixed = secret_scan.scan(documents([(1, f"0123456789abcdef{strange}")]), model).first()  # beside a hex stretch of the same run
    assert [(s.kind, s.start, s.end) for s in mixed.spans] == [("hex", 0, 16), ("markov", 16, 16 + len(strange))]
    assert secret_scan.scan(documents([]), model).count() == 0
    assert secret_scan.fit(documents([])) is not None


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == before > 100
    assert docs.groupBy("text").agg(F.count("*").alias("n")).filter("n > 1").count() == 0


def test_the_mixture_reaches_the_result_of_the_pipeline(spark, monkeypatch):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    monkeypatch.setattr(pfair_mix.scheduled, "__defaults__", (*pfair_mix.scheduled.__defaults__[:-1], 2000))  # enough blocks on this few documents
    sources = [r.source for r in docs.select("source").distinct().orderBy("source").collect()]
    found = []
    for heavy in sources[:2]:
        weights = lambda d, *_, heavy=heavy: pfair_mix.given_weights(d, {s: 50.0 if s == heavy else 1.0 for s in sources})
        monkeypatch.setattr(pfair_mix, "root_weights", weights)
        at = {r.doc_id: r.mix_position for r in corpus_pipeline.run(spark, sf_dir).collect()}
        assert at == {r.doc_id: r.mix_position for r in pfair_mix.positions(pfair_mix.scheduled(docs)).select("row.doc_id", "mix_position").collect()}
        assert sorted(at.values()) == list(range(docs.count()))
        found.append(at)
    assert found[0] != found[1]
