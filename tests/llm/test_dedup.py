"""Near, substring and line dedup against brute force on small tables with copies, ties, nulls and long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from spanloom.llm import line_dedup, near_dedup, substring_dedup, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=8):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = prose(rng, rng.randint(60, 260))
        rows.append(" ".join(words))
        for copy in range(rng.randint(0, 5)):
            edited = list(words)
            for _ in range(rng.randint(0, 9)):
                edited[rng.randrange(len(edited))] = "edit" + str(rng.randint(0, 99))
            rows.append(("\n" if copy % 2 else " ").join(edited))
    rows += ["one two", "one  two", "one two three", "", " ", None, "w " * 4000, "w " * 4100, "tab\tword"]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, "null id text of a few words")]


def weighted(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    sets = [weighted(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, whole = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if (both >= 0.8 * whole) if whole else True:
                parent[root(i)] = root(j)
    named = {}
    for i, (doc, _) in enumerate(rows):
        named.setdefault(root(i), []).append(doc)
    return sorted((str(doc), str(min((d for d in named[root(i)] if d is not None), default=None)), len(named[root(i)])) for i, (doc, _) in enumerate(rows))


def test_near_classes_equal_brute_force(spark, documents):
    rows = corpus()
    out = near_dedup.near_classes(documents(rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in out) == brute_classes(rows)
    kept = near_dedup.one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns
    assert kept.count() == len({c for _, c, _ in brute_classes(rows)})
    assert near_dedup.near_classes(documents([])).count() == 0


def test_large_buckets_lose_no_link(spark, documents, monkeypatch):
    """A chain in which only neighbours are alike: no hub reaches all, block comparison does."""
    rng = random.Random(3)
    words = prose(rng, 400)
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(40)]
    for light in (32, 1):
        monkeypatch.setattr(near_dedup, "LIGHT", light)
        monkeypatch.setattr(near_dedup, "BLOCK", 8)
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000 if light == 1 else 1 << 20)
        out = near_dedup.near_classes(documents(rows)).collect()
        assert {r.class_id for r in out} == {0}


def test_texts_that_trick_polynomial_hashes_are_no_copies(spark, documents):
    """Thue-Morse orders of two words and their complement collide under any polynomial hash modulo 2**64."""
    order = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, " ".join(("alpha", "beta")[b] for b in order)), (2, " ".join(("beta", "alpha")[b] for b in order)), (3, " ".join(("alpha", "beta")[b] for b in order) + " ")]
    assert {r.doc_id: r.copies for r in near_dedup.near_classes(documents(rows)).collect()} == {1: 2, 2: 1, 3: 2}


def test_components_of_a_large_star_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr("spanloom.llm.skew.HOT_SHARE", 20)
    links = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 440)] + [(900, 905), (905, 903)]
    found = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(400, 441), 400), 900: 900, 903: 900, 905: 900}


def test_hashes_of_long_texts_are_made_in_pieces(monkeypatch):
    rng = random.Random(5)
    data = np.frombuffer(" ".join(prose(rng, 5000) + ["x" * 700] + prose(rng, 50)).encode(), np.uint8)
    words = near_dedup.split_words(data, np.array([0, len(data)]))
    whole, raw = words.hashes().tolist(), data.tobytes()
    monkeypatch.setattr("spanloom.llm.words.CHUNK_BYTES", 300)
    assert words.hashes().tolist() == whole
    assert near_dedup.digests(words) == [hashlib.sha256(b" ".join(raw.split())).digest()]


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(0)
    element = near_dedup.mix(rng.integers(1, 1 << 62, 300).astype(np.uint64))
    w1, w2 = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    s = near_dedup.signatures(np.repeat([0, 1], 300), np.tile(element, 2), np.concatenate([w1, w2]), 2, k=6000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.03
    assert (near_dedup.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 2) == 0).all()


def brute_windows(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((str(doc), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def substrings(df, **more):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup.substring_dedup(df, **more).collect())


def test_automata_undo_false_confirmations(spark, documents):
    """Under hashes of no bits all windows about a common anchor count as one; what the automata locate once stays."""
    rng = random.Random(12)
    middle = prose(rng, 34)
    rows = [(i, " ".join(prose(rng, 33) + middle + prose(rng, 33))) for i in range(6)]
    assert substrings(documents(rows), bits=0) == sorted(brute_windows(rows)) and all(n == 0 for _, _, n, _ in brute_windows(rows))
    rows += [(50, rows[0][1])]  # alone with its anchors where only copies have them
    assert substrings(documents(rows)) == sorted(brute_windows(rows))


def test_anchors_with_many_passages_and_pieces(spark, documents, monkeypatch):
    rng = random.Random(13)
    base = prose(rng, 120)
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(120)] = rng.choice("xyz")
        rows.append((i, " ".join(words)))
    for n_passages, n_pieces in ((3, 7), (10_000, 5), (2, 10_000)):
        monkeypatch.setattr(substring_dedup, "PASSAGES", n_passages)
        monkeypatch.setattr(substring_dedup, "PIECES", n_pieces)
        assert substrings(documents(rows)) == sorted(brute_windows(rows))


def thue_morse(zero, one, levels=12):
    """Two sequences of 2**levels members that every polynomial hash modulo 2**64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(1 << levels)]
    return [(zero, one)[b] for b in bits], [(one, zero)[b] for b in bits]


def test_long_words_that_trick_polynomial_hashes_are_told_apart(spark, documents):
    rng = random.Random(15)
    a, b = ("".join(x) for x in thue_morse("a", "b"))
    left, right = prose(rng, 40), prose(rng, 40)
    rows = [(i, " ".join([*left, word, *right, f"end{i}"])) for i, word in enumerate([a, a, b, b])]
    assert substrings(documents(rows)) == sorted(brute_windows(rows)) and [n for *_, n, _ in sorted(brute_windows(rows))] == [81] * 4


def test_long_lines_that_trick_polynomial_hashes_are_told_apart(spark, documents):
    a, b = thue_morse("alpha", "beta")
    rows = [(1, " ".join(["x", "y", "z", *a])), (2, " ".join(["x", "y", "z", *b])), (3, " ".join(["x", "y", "z", *b]))]
    found = {r.row.doc_id: r.text for r in line_dedup.line_dedup(documents(rows)).collect()}
    assert found == {1: rows[0][1], 2: rows[1][1], 3: ""}


def test_hashes_of_ranges_tell_contents_and_lengths():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    start = rng.integers(0, 400, 3000)
    end = np.minimum(start + rng.integers(0, 70, 3000), 400)
    for hashes in (words.range_hashes, words.list_hashes):
        by_hash, by_content = {}, {}
        for h, a, b in zip(hashes(values, start, end, 7).tolist(), start.tolist(), end.tolist()):
            content = tuple(values[a:b].tolist())
            assert by_hash.setdefault(h, content) == content and by_content.setdefault(content, h) == h
    a, b = (np.array([0 if x == "a" else 1 for x in t], np.uint64) for t in thue_morse("a", "b"))
    for hashes in (words.range_hashes, words.list_hashes):
        assert hashes(a, np.array([0]), np.array([len(a)])) != hashes(b, np.array([0]), np.array([len(b)]))


def test_substring_dedup_of_texts_beyond_a_slice(spark, documents):
    rng = random.Random(14)
    shared = prose(rng, 60)
    long = prose(rng, 150_000) + shared + prose(rng, 150_000)
    rows = [(1, " ".join(long)), (2, " ".join(prose(rng, 50) + shared)), (3, " ".join(["same"] * 200_000))]
    assert all(len(t) > substring_dedup.chunks.__defaults__[0] * 0.75 for i, t in rows if i != 2)
    assert substrings(documents(rows)) == sorted(brute_windows(rows))


def test_substring_dedup_equals_brute_force(spark, documents):
    rng = random.Random(1)
    shared = prose(rng, 90)
    rows = corpus(4) + [(100 + i, " ".join(prose(rng, 20) + shared[i : i + 30 + i] + prose(rng, 30))) for i in range(12)]
    expected = brute_windows(rows)
    for broadcast in (substring_dedup.BROADCAST_KEYS, 0):
        substring_dedup.BROADCAST_KEYS, before = broadcast, substring_dedup.BROADCAST_KEYS
        try:
            out = substring_dedup.substring_dedup(documents(rows)).collect()
        finally:
            substring_dedup.BROADCAST_KEYS = before
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in out) == sorted(expected)
    assert substring_dedup.substring_dedup(documents([])).count() == 0


def test_anchors_do_not_depend_on_the_place_in_a_text(monkeypatch):
    rng = random.Random(2)
    data = np.frombuffer(" ".join(rng.choices(["a", "b", "c", "dd"], k=3000)).encode(), np.uint8)
    words = substring_dedup.split_words(data, np.array([0, len(data)]))
    whole = [x.tolist() for x in substring_dedup.segments(words)]
    monkeypatch.setattr(substring_dedup, "PLACE_BITS", 6)
    assert [x.tolist() for x in substring_dedup.segments(words)] == whole


def brute_lines(rows):
    """Lines that go, by the rules of the template tree on Python strings."""
    parsed = []
    for doc, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            tokens = [("<*>" if re.search(r"[0-9@]", t) else t, t) for t in WORD.findall(line)]
            if len(tokens) < line_dedup.MIN_TOKENS:
                continue
            only = all(m == "<*>" for m, _ in tokens)
            masked = [t if only else m for m, t in tokens]
            head = min(len(masked), line_dedup.DEPTH)
            rest, n = masked[head:], min(len(masked) - head, line_dedup.FIELDS)
            fields = [tuple(rest[i * len(rest) // n : (i + 1) * len(rest) // n]) for i in range(n)]
            leaf = (only and tuple(masked), len(masked), tuple(masked[:head]))
            parsed.append((doc, at, leaf, tuple(masked), fields))
    leaves = {}
    for _, _, leaf, masked, fields in parsed:
        leaves.setdefault(leaf, {})[masked] = fields
    template = {}
    for leaf, members in leaves.items():
        common = Counter((i, f) for fields in members.values() for i, f in enumerate(fields))
        for masked, fields in members.items():
            alike = sum(common[i, f] * 2 > len(members) for i, f in enumerate(fields))
            joined = len(members) > 1 and fields and alike >= line_dedup.SIMILAR * len(fields)
            template[leaf, masked] = (leaf, "*" if joined else masked)
    where = {}
    for doc, at, leaf, masked, _ in parsed:
        where.setdefault(template[leaf, masked], []).append((doc, at))
    return {place for places in where.values() if len({d for d, _ in places}) > 1 for place in places if place != min(places)}


def test_line_dedup_equals_brute_force(spark, documents):
    rng = random.Random(6)
    rows = []
    for i in range(30):
        lines = [" ".join(prose(rng, rng.randint(1, 30))) for _ in range(4)]
        lines.insert(rng.randint(0, 4), f"Order {rng.randint(1, 9999)} of user{i} was shipped on day {i} from {rng.choice(['Bonn', 'Rome'])} by our own carrier")
        lines.insert(2, "All rights reserved by the " + rng.choice(["owner", "owners", "author"]) + " of this page and its many other readers")
        lines += ["12 34 56", f"{i} {i} {i}", "", "short"]
        rows.append((i, "\n".join(lines)))
    rows += [(40, None), (41, ""), (42, rows[0][1]), (43, "z y x w v\nz y x w v"), (44, "q " * 30_000)]
    out = line_dedup.line_dedup(documents(rows)).select("row.doc_id", "text", "lines").collect()
    gone = {(r.doc_id, at) for r in out for at in r.lines or []}
    assert gone == brute_lines(rows)
    for r in out:
        text = dict(rows)[r.doc_id]
        assert r.text == (text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (r.doc_id, i) not in gone))
    whole = line_dedup.without_lines(documents(rows))
    assert whole.columns == documents(rows).columns and whole.filter("n_chars <> length(text)").count() == 0
    assert line_dedup.without_lines(documents([])).count() == 0
    again = line_dedup.line_dedup(documents([(1, "a b c d"), (1, "a b c d"), (None, "a b c d")])).collect()
    assert sorted((str(r.row.doc_id), r.text) for r in again) == [("1", ""), ("1", ""), ("None", "a b c d")]


def brute_templates(rows, similar=0.75, constant=0.5):
    """Lines that go when a leaf keeps any number of templates that generalise with every line: token by token on Python strings."""
    places = {}
    for doc, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            masked = tuple("<*>" if re.search(r"[0-9@]", t) else t for t in WORD.findall(line))
            if len(masked) >= 3 and set(masked) != {"<*>"}:
                places.setdefault(masked, []).append((doc, at))
    leaves, groups = {}, []
    for line in sorted(places, key=lambda m: min(places[m])):
        own = leaves.setdefault((len(line), line[:3]), [])
        agree = [sum(t in (None, x) for t, x in zip(template, line)) for template, _ in own]
        fits = [i for i, (template, _) in enumerate(own) if agree[i] >= similar * len(line) and sum(t == x for t, x in zip(template, line)) >= constant * len(line)]
        if fits:
            template, group = own[max(fits, key=lambda i: (agree[i], -i))]
            template[:] = [t if t == x else None for t, x in zip(template, line)]
        else:
            group = []
            own.append((list(line), group))
            groups.append(group)
        group += places[line]
    return {p for g in groups if len({d for d, _ in g}) > 1 for p in g if p != min(g)}


def test_templates_generalise(spark, documents):
    """The third line is too far from the first and the second, but fits what they have in common; later ones wear the template down no further than half of its tokens."""
    base = "the page was opened by one of our guests in a hurry".split()

    def line(*other):
        return " ".join(f"other{k}{k * 'x'}" if k in other else w for k, w in enumerate(base)).translate(str.maketrans("0123456789", "abcdefghij"))

    rows = [(1, line()), (2, line(9, 10, 11)), (3, line(8, 9, 10)), (4, line(7, 8, 9)), (5, line(6, 7)), (6, line(5, 6, 7)), (7, line(4, 5)), (8, line(3, 4))]
    out = line_dedup.line_dedup(documents(rows)).filter("lines is not null").select("row.doc_id").collect()
    assert {(r.doc_id, 0) for r in out} == brute_templates(rows)
    assert (4, 0) in brute_templates(rows) and sum(a == b for a, b in zip(rows[0][1].split(), rows[3][1].split())) >= 9
    third = [rows[0], rows[1], (3, " ".join(w if k not in (8, 9, 10, 11) else f"new{'xyz'[k % 3]}" for k, w in enumerate(base)))]
    assert sum(a == b for a, b in zip(third[0][1].split(), third[2][1].split())) == 8 < 0.75 * 12
    found = {r.row.doc_id: r.text for r in line_dedup.line_dedup(documents(third)).collect()}
    assert found == {1: rows[0][1], 2: "", 3: ""} and brute_templates(third) == {(2, 0), (3, 0)}
    assert brute_templates([third[0], third[2]]) == set() == {r.row.doc_id for r in line_dedup.line_dedup(documents([third[0], third[2]])).filter("lines is not null").collect()}


def test_a_leaf_keeps_several_templates(spark, documents, monkeypatch):
    rng = random.Random(11)
    made = lambda n: ["the page was", *prose(rng, n)]
    bases = [made(n) for n in (1, 2, 5, 5, 5, 9, 9, 27, 97)] + [["the page was", *rng.choices("ab", k=9)] for _ in range(4)]
    rows = []
    for i in range(60):
        lines = []
        for base in rng.sample(bases, 6):
            line = list(base)
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(1, len(line))] = rng.choice([*prose(rng, 1), "a", "7"])
            lines.append(" ".join(line))
        rows.append((i, "\n".join([*lines, " ".join(made(9))])))
    long = prose(rng, 100)
    rows += [(100 + i, " ".join(f"w{'xyz'[i]}" if k in (20, 50, 80) else w for k, w in enumerate(long))) for i in range(3)]  # 97 of 100 tokens agree
    expected = brute_templates(rows)
    assert {(101, 0), (102, 0)} < expected
    for large in (line_dedup.LARGE, 3):
        monkeypatch.setattr(line_dedup, "LARGE", large)
        out = line_dedup.line_dedup(documents(rows)).select("row.doc_id", "lines").collect()
        assert {(r.doc_id, at) for r in out for at in r.lines or []} == expected


def test_two_templates_of_equal_share_in_a_leaf(spark, documents):
    """Each has 45 % of a leaf's lines and varies in a word; neither is a majority."""
    rng = random.Random(17)
    a, b = "we are now open for all of our {} guests again".split(), "we are now sorry that the old {} server went down".split()
    lines = [" ".join(w.replace("{}", prose(rng, 1)[0]) for w in t) for t in [a] * 45 + [b] * 45] + [" ".join(["we are now", *prose(rng, len(a) - 3)]) for _ in range(10)]
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    out = line_dedup.line_dedup(documents(rows)).filter("lines is not null")
    assert out.count() == 88 and {(r.doc_id, at) for r in out.select("row.doc_id", "lines").collect() for at in r.lines} == brute_templates(rows)


def test_founders_do_not_depend_on_the_search_by_parts(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (4, 5, 8, 13, 40):
        tokens = rng.integers(0, 3, (300, n)).astype(np.uint64)
        tokens[:, :3] = 7
        whole = line_dedup.founders(tokens).tolist()
        with monkeypatch.context() as m:
            m.setattr(line_dedup, "LARGE", 1)
            assert line_dedup.founders(tokens).tolist() == whole


def test_kept_digest_of_op5(spark):
    out = substring_dedup.op5_substring_dedup(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert all(len(r.kept_sha256) == len(hashlib.sha256().hexdigest()) for r in out.limit(3).collect())


def test_only_tables_that_results_read_stay(spark, documents, tmp_path, monkeypatch):
    from spanloom.llm import shared

    rng = random.Random(3)
    rows = [(i, " ".join(prose(rng, 60) if i % 3 else rng.choices(["a", "b"], k=50)) + "\nthe same line on every page") for i in range(30)] + [(90, "x y z " * 30), (91, "x y z " * 30)]
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    for made, stay in ((near_dedup.near_classes, {"rows", "classes"}), (line_dedup.line_dedup, {"gone"}), (substring_dedup.substring_dedup, {"gone"})):
        before = set(tmp_path.iterdir())
        out = made(documents(rows))
        assert {p.name.rsplit("-", 1)[0] for p in set(tmp_path.iterdir()) - before} == stay
        assert out.count() == len(rows)


def test_many_rows_of_one_id_and_text(spark):
    """10,000 equal rows and ids whose rows differ in another column: one stays, the same on every partitioning."""
    text = " ".join(prose(random.Random(4), 40))
    rows = [(1, text, "same", "s", 1)] * 10_000 + [(2, text + " and more of it", x, "s", 1) for x in "abc"] + [(3, "other words here", "z", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [sorted(map(tuple, near_dedup.one_of_each(df.repartition(n)).collect())) for n in (1, 7)]
    assert out[0] == out[1] and [r[0] for r in out[0]] == [1, 3]
    twice = df.filter("doc_id = 2")
    assert near_dedup.one_of_each(twice).collect() == near_dedup.one_of_each(twice.repartition(3)).collect() and near_dedup.one_of_each(twice).count() == 1


def test_pair_recall_on_whole_documents(spark):
    """All pairs of the 1,000 documents of a test table that are alike by 0.8, found through a list of the texts of every shingle; how many share a class, and whether every class holds together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    weights = {r.doc_id: weighted(r.text) for r in docs.collect()}
    holders, common = {}, Counter()
    for i, shingles in weights.items():
        for s, n in shingles.items():
            holders.setdefault(s, []).append((i, n))
    for own in holders.values():
        for a, (i, n) in enumerate(own):
            for j, m in own[:a]:
                common[i, j] += min(n, m)
    total = {i: sum(w.values()) for i, w in weights.items()}
    alike = [(i, j) for (i, j), both in common.items() if both >= 0.8 * (total[i] + total[j] - both)]
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert len(alike) > 50 and sum(found[i] == found[j] for i, j in alike) >= 0.999 * len(alike)
    parent = {i: i for i in weights}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in alike:
        parent[root(i)] = root(j)
    assert len({(found[i], root(i)) for i in weights if total[i]}) == len({found[i] for i in weights if total[i]})  # no class joins what no links join
