"""BPE against the tiktoken library, token files against the tokenizers library and a full round trip."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from spanloom.llm import byte_bpe, token_files

PIECES = [" ", "  ", "\n", "\t", " \n", "a", "The", "é", "É", "ß", "'s", "'", "'ll", "12", "3", ".", "!!", "…", " ", "　", "中文", "😀", "ñ", "×", "|", "\x1c", "\x85", "é", "<", "it's", "I'M", "\r\n", "\x00", "aaaaaaaaaaaa", "<|endoftext|>", "Σ", "İ"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)] + ["", "x" * 50_000, "ab" * 20_000, "word, " * 20_000]


def test_bpe_equals_the_library_and_round_trips(spark, documents):
    ranks, pattern = byte_bpe.multilingual_50k()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    rows = list(enumerate(texts(800, 1))) + [(9000, None), (None, "a b"), (3, "again")]
    encoded = byte_bpe.encode_texts(documents(rows), ranks, pattern)
    found = sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str)
    assert found == sorted(((i, other.encode_ordinary(t or "")) for i, t in rows), key=str)
    back = byte_bpe.decode_texts(encoded, ranks, pattern)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    digests = byte_bpe.round_trip(documents(rows), ranks, pattern)
    assert sum(r.n_tokens for r in digests.collect()) == sum(len(ids) for _, ids in found)
    assert byte_bpe.round_trip(documents([]), ranks, pattern).count() == 0


def test_rank_queue_and_both_paths_agree():
    queue = byte_bpe.RankQueue(50_000)
    rng = random.Random(2)
    held = sorted((rng.randrange(50_000), i) for i in range(500))
    for rank, position in rng.sample(held, len(held)):
        queue.push(rank, position)
    assert [(r := queue.first(), queue.pop(r)) for _ in held] == held and queue.first() == -1
    bpe = byte_bpe.coder(*byte_bpe.multilingual_50k())
    pieces = ["".join(rng.choices("abcde thé", k=rng.randint(1, 60))).encode() for _ in range(500)]
    assert bpe.encode_pieces(pieces) == [np.array(bpe.encode_piece(p), np.int32).tobytes() for p in pieces]


def test_token_files(spark, documents, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(100 - i, t) for i, t in enumerate(texts(60, 3))] + [(500, None), (7, "twice"), (7, "again")]
    folder = str(tmp_path / "files")
    manifest = token_files.write_token_files(documents(rows), folder, path, 1, shards=3)
    tokenizer = Tokenizer.from_file(path)
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    expected, start = [], 0
    for i, t in ordered:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    read = token_files.read_token_files(manifest, folder)
    assert read.rdd.getNumPartitions() == manifest.count() > 1
    assert [tuple(r) for r in read.orderBy("start").collect()] == expected
    first = token_files.Shard(folder, manifest.orderBy("base").first()["shard"], 2)
    assert first.document(0)[-1] == 1
    empty = token_files.write_token_files(documents([]), str(tmp_path / "none"), path, 1)
    assert token_files.read_token_files(empty, str(tmp_path / "none")).count() == 0


def test_word_encoder_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = token_files.encoder(path), Tokenizer.from_file(path)
    special = ["hi <|endoftext|> there", "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|>", "A<|endoftext|>B", "<|endoftext|>\u0338x", "<|endoftext|", "é<|startoftext|>é", "<<|endoftext|>>"]
    assert library.encode(special[0], add_special_tokens=False).ids == [1883, 49407, 997]
    rng = random.Random(6)
    mixed = ["".join(rng.choices([*PIECES, *special], k=rng.randint(0, 8))) for _ in range(400)]
    for t in special + mixed + texts(1500, 5):
        data = np.frombuffer(t.encode(), np.uint8)
        ids, bounds = encoder.chunk(data, np.array([0, len(data)]))
        assert ids[bounds[0] : bounds[1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
    halves = np.frombuffer(b"<|endoftext|>", np.uint8)  # a special string over two texts is none
    ids, bounds = encoder.chunk(halves, np.array([0, 5, 13]))
    assert ids.tolist() == sum((library.encode(t, add_special_tokens=False).ids for t in ("<|end", "oftext|>")), [])


def test_foreign_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="one by one"):
        token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
