"""Token ids as flat unsigned integer files with 64-bit document offsets, and their reader.

Layout of a data set, one shard for each range of ids, shards and documents in ascending order of id (null ids first):
  shard-NNNNN.bin   token ids, little-endian unsigned, 16 bits if the vocabulary fits, else 32
  shard-NNNNN.idx   n + 1 offsets in tokens from the start of the shard, little-endian unsigned 64 bits
  shard-NNNNN.ids   n ids, little-endian signed 64 bits, then n bytes: 1 where the id is null
The manifest (a DataFrame of one row for each shard) adds the base of each shard: the prefix sum of the tokens before it.
Ranges keep equal ids in one shard. Each file is written under a name of its own attempt and then renamed, so a task that
runs again after a lost executor replaces what it wrote before. Readers map the files into memory where the store is
a file system, and read ranges of them elsewhere.

Words are encoded once for each chunk and kept in a bounded cache: white space and the boundaries between ASCII or Latin-1 letters and other ASCII
characters (apart from the apostrophe) always part tokens here, and ASCII letters are lowered by the tokenizer anyway. That holds for files with the
normaliser and splitter below only; any other file is refused.

Defined cases: strings of the file's special tokens in a text become the special ids, as the library has it by default; a null or empty text has the end id only; texts of any length are encoded whole; repeated ids each keep a document,
in the order of their texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.piece_cache import PieceCache, distinct, gather
from spanloom.llm.shared import shared_dir, written
from spanloom.llm.words import chunks
from spanloom.session import qualified

CHUNK_BYTES = 8 << 20
READ_TOKENS = 1 << 20
TOGETHER = 4096
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_TAIL = np.zeros(256, dtype=bool)  # second byte of a Latin-1 letter
_TAIL[0x80:0xC0] = True
_TAIL[[0x97, 0xB7]] = False
_SIGN = np.zeros(256, dtype=bool)  # ASCII characters that are neither letter, blank, apostrophe nor control
_SIGN[0x21:0x7F] = True
_SIGN &= ~_ALPHA
_SIGN[0x27] = False
#: A sign that can take a combining mark in NFC is no safe boundary before other bytes; only letters may follow a cut.


# What a tokenizer file must say about normalising and splitting for the cuts above to be safe.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"


def special_tokens(tokenizer_file: str) -> list[str]:
    """The special strings of a tokenizer file; fails if the file is not one that WordEncoder can cut."""
    with open(tokenizer_file, encoding="utf-8") as lines:
        spec = json.load(lines)
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    cut, model = parts[0], spec.get("model", {})
    same = (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and (cut.get("pattern"), cut.get("behavior"), cut.get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", END_OF_WORD, None)
    )
    added = spec.get("added_tokens", [])
    if not same or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added):
        raise ValueError(f"{tokenizer_file}: words cannot be encoded one by one under this normaliser, splitter, model or these added tokens")
    return [t["content"] for t in added]


class WordEncoder:
    """Encodes chunks of texts with a tokenizers file, word by word."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.special = [t.encode() for t in sorted(special_tokens(tokenizer_file), key=len, reverse=True)]
        self._special = re.compile(b"|".join(map(re.escape, self.special))) if self.special else None
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.size = self.tokenizer.get_vocab_size()
        self.cache = PieceCache(self._encode)

        self._last = np.zeros(self.size, dtype=bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self._last[i] = token.endswith(END_OF_WORD)

    def _encode(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Letters-only pieces are one word each: they are encoded many in a text and parted after each word's last id."""
        out: list[bytes] = [b""] * len(pieces)
        words = [i for i, p in enumerate(pieces) if _WORD.fullmatch(p)]
        alone = sorted(set(range(len(pieces))).difference(words))
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8") for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=np.int32).tobytes()
        for a in range(0, len(words), TOGETHER):
            part = words[a : a + TOGETHER]
            (e,) = self.tokenizer.encode_batch_fast([b" ".join([pieces[i] for i in part]).decode("utf-8")], add_special_tokens=False)
            ids = np.array(e.ids, dtype=np.int32)
            ends = np.flatnonzero(self._last[ids]) + 1
            assert len(ends) == len(part), "a word without an end"
            packed, stops = ids.tobytes(), (ends * 4).tolist()
            for i, b, c in zip(part, [0, *stops[:-1]], stops, strict=True):
                out[i] = packed[b:c]
        return out

    def _specials(self, data: np.ndarray, text_ptr: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens stand; none runs from one text into another."""
        raw = data.tobytes()
        if not any(t in raw for t in self.special):
            return []
        bounds = text_ptr.tolist()
        return [m.span() for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in self._special.finditer(raw, a, b)]

    def chunk(self, data: np.ndarray, text_ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and each text's bounds among them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(text_ptr), np.int64)
        blank = _BLANK[data]
        tail = np.zeros(n, dtype=bool)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_TAIL[data[lead + 1]]]
        tail[lead + 1] = True
        head = np.zeros(n, dtype=bool)
        head[lead] = True
        sign, alpha = _SIGN[data], _ALPHA[data]
        begin = np.ones(n + 1, dtype=bool)
        begin[1:-1] = blank[:-1] | ((alpha[:-1] | tail[:-1]) & sign[1:]) | (sign[:-1] & (alpha[1:] | head[1:]))
        begin[text_ptr] = True
        lowered = _LOWER[data]
        for a, b in self._specials(data, text_ptr):
            begin[a:b] = False
            begin[[a, b]] = True
            lowered[a:b] = data[a:b]
        keep = ~blank
        place = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(keep, out=place[1:])
        starts = np.flatnonzero(begin[:-1] & keep)
        bounds = np.append(place[starts], place[-1])
        codes, pieces = distinct(lowered[keep], bounds)
        ids, ends = gather(codes, self.cache(pieces))
        return ids, ends[np.searchsorted(starts, text_ptr)]


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder in its full form, scheme included, which is the same for every executor."""
    return fs.FileSystem.from_uri(folder)


MANIFEST = "shard string, width int, first_id long, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the files below folder and returns the manifest, with the base of each shard."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (store, root), attempt = encoder(tokenizer_file), _store(folder), uuid.uuid4().hex
        kind = np.dtype("<u2") if max(coder.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        store.create_dir(root, recursive=True)
        name = f"shard-{TaskContext.get().partitionId():05d}"
        lengths, ids_of, nulls = [], [], []
        with store.open_output_stream(f"{root}/{attempt}.bin") as out:
            for batch in batches:
                for rows, data, ptr in chunks(batch, text_column, CHUNK_BYTES):
                    ids, bounds = coder.chunk(data, ptr)
                    flat = np.insert(ids, bounds[1:], end_id).astype(kind)
                    out.write(flat.tobytes())
                    lengths.append(np.diff(bounds) + 1)
                    column = rows.column(id_column).cast(pa.int64())
                    nulls.append(column.is_null().to_numpy(zero_copy_only=False))
                    ids_of.append(column.fill_null(0).to_numpy(zero_copy_only=False))
        sizes = np.concatenate([np.zeros(0, np.int64), *lengths])
        if not len(sizes):
            store.delete_file(f"{root}/{attempt}.bin")
            return
        with store.open_output_stream(f"{root}/{attempt}.idx") as out:
            out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
        with store.open_output_stream(f"{root}/{attempt}.ids") as out:
            out.write(np.concatenate(ids_of).astype("<i8").tobytes() + np.concatenate(nulls).astype(np.uint8).tobytes())
        for end in ("bin", "idx", "ids"):
            store.move(f"{root}/{attempt}.{end}", f"{root}/{name}.{end}")
        first = None if nulls[0][0] else int(ids_of[0][0])
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([kind.itemsize], pa.int32()), pa.array([first], pa.int64()), pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], names=["shard", "width", "first_id", "n_docs", "n_tokens"])

    ordered = docs.select(id_column, text_column).repartitionByRange(shards, id_column).sortWithinPartitions(id_column, text_column)
    manifest = written(ordered.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


class Shard:
    """One shard, mapped into memory where its store is a file system."""

    def __init__(self, folder: str, name: str, width: int):
        self.store, root = _store(folder)
        self.path, self.kind = f"{root}/{name}", np.dtype(f"<u{width}")
        self.offsets = self._read("idx", np.dtype("<u8")).astype(np.int64)
        n = len(self.offsets) - 1
        raw = self._read("ids", np.dtype("u1"))
        self.ids, self.null = np.frombuffer(raw[: 8 * n].tobytes(), dtype="<i8"), np.frombuffer(raw[8 * n :].tobytes(), dtype=bool)
        self.local = isinstance(self.store, fs.LocalFileSystem)
        if self.local:
            self.tokens = np.memmap(f"{self.path}.bin", dtype=self.kind, mode="r")

    def _read(self, end: str, kind: np.dtype) -> np.ndarray:
        with self.store.open_input_stream(f"{self.path}.{end}") as lines:
            return np.frombuffer(lines.read(), dtype=kind)

    def span(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b of the shard."""
        if self.local:
            return self.tokens[a:b]
        with self.store.open_input_file(f"{self.path}.bin") as whole:
            return np.frombuffer(whole.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), dtype=self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.offsets[i]), int(self.offsets[i + 1]))


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32 of the ids as 32-bit integers; from the files."""
    folder = qualified(manifest.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                shard = Shard(folder, row.shard, row.width)
                offsets, n = shard.offsets, len(shard.offsets) - 1
                i = 0
                while i < n:
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + READ_TOKENS, side="right")) - 1)
                    j = min(j, n)
                    wide = shard.span(int(offsets[i]), int(offsets[j])).astype("<u4").tobytes()
                    cuts = ((offsets[i : j + 1] - offsets[i]) * 4).tolist()
                    view = memoryview(wide)
                    yield pd.DataFrame({
                        "doc_id": pd.array(np.where(shard.null[i:j], None, shard.ids[i:j].astype(object)), dtype="Int64"),
                        "start": row.base + offsets[i:j],
                        "n_tokens": np.diff(offsets[i : j + 1]),
                        "ids_crc32": [zlib.crc32(view[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                    })
                    i = j

    spread = manifest.select("shard", "width", "base").repartitionByRange(max(1, manifest.count()), "shard")  # a task for each shard
    return spread.mapInPandas(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(manifest, folder)


QUERIES = {"op8_token_files": op8_token_files}
ORACLES: dict = {}
