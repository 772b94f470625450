"""The registered queries on a small folder of tables, against brute force on the columns of their contracts."""

import base64
import hashlib
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from test_dedup import WORD, brute_classes, brute_templates, brute_windows, prose
from test_models_and_mix import bad, brute_spans, good, naive_score
from tokenizers import Tokenizer

from spanloom.llm import quality_gam, registry, words

sha = lambda data: hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    shared = prose(rng, 60)
    rows = []
    for i in range(120):
        lines = [good(rng) if i % 3 else bad(rng), " ".join(prose(rng, 20)), f"Order {i} of a user was shipped on day {i} by our own carrier from here"]
        if i % 4 == 0:
            lines.append(" ".join(prose(rng, 5) + shared[i // 8 : i // 8 + 45] + prose(rng, 5)))
        if i % 10 == 0:
            lines.append(f"password = 'aB3{i:04}xYz901Qw' and 0123456789abcdef{i:02x} \u00e9 AKIAABCDEFGH1234{i:04}")
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[3][1] + " and more" * (i % 2)) for i in range(6)] + [(300, None), (301, ""), (302, " \n "), (303, "hi <|endoftext|> there"), (304, "x y z " * 60_000), (305, "w" * 300_000)]
    path = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, "en", "abc"[i % 3], None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def result(spark, folder, name):
    return registry.QUERIES[name](spark, folder[0]).collect()


def test_op2(spark, folder):
    rows = folder[1]
    out = result(spark, folder, "op2_near_dedup")
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in out) == brute_classes(rows)
    kept = [r.class_id for r in out if r.kept]
    assert len(kept) == len(set(kept)) == len({r.class_id for r in out})


def test_op4(spark, folder):
    path, rows = folder
    out = {r.doc_id: r for r in result(spark, folder, "op4_quality_gam")}
    assert len(out) == len(rows)
    labels = spark.read.parquet(f"{path}/labels.parquet").filter(~quality_gam.held_out())
    model = quality_gam.fit(spark.read.parquet(f"{path}/documents.parquet"), labels, "quality")
    for i, text in rows:
        r = out[i]
        data = words.np.frombuffer((text or "").encode(), words.np.uint8)
        expected = naive_score(model, quality_gam.features(data, words.np.array([0, len(data)]))[0])
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and abs(r.score - expected) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_op5(spark, folder):
    expected = sorted((doc, n, gone, sha(text)) for doc, n, gone, text in brute_windows(folder[1]))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in result(spark, folder, "op5_substring_dedup")) == expected
    assert any(gone for _, _, gone, _ in expected)


def test_op6(spark, folder):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    expected = []
    for i, t in folder[1]:
        if i == 305:
            continue  # one word of 300,000 letters takes the library minutes
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    out = {r.doc_id: r for r in result(spark, folder, "op6_byte_bpe")}
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in out.items() if i != 305) == expected
    assert out[305].decoded_sha256 == sha("w" * 300_000)


def test_op7(spark, folder):
    rows = folder[1]
    gone, expected = brute_templates(rows), []
    for i, t in rows:
        lines = (t or "").split("\n") if t else []
        expected.append((i, len(lines), sum((i, n) in gone for n in range(len(lines))), sha("\n".join(x for n, x in enumerate(lines) if (i, n) not in gone))))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in result(spark, folder, "op7_line_dedup")) == expected
    assert len(gone) > 100


def test_op8(spark, folder):
    library, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in folder[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in result(spark, folder, "op8_token_files")) == expected


def test_op10(spark, folder):
    for r in result(spark, folder, "op10_secret_scan"):
        base = brute_spans(dict(folder[1])[r.doc_id] or "")
        kinds = [s.split(":")[0] for s in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(",".join(base)) and [s for s in r.spans.split(",") if s and not s.startswith("markov")] == base


def test_digests_hold_for_words_of_any_text(spark, folder):
    assert {r.doc_id for r in result(spark, folder, "op5_substring_dedup") if r.n_words == 0} == {i for i, t in folder[1] if not WORD.findall(t or "")}
