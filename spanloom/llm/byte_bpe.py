"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of token ids. The queue has a bucket for each merge rank; a bucket holds the list positions
whose pair has that rank, smallest first. Three levels of 64-way bitmaps mark the buckets in use, so find-first-set
names the next rank in three steps whatever the length. A popped position whose pair has changed since is stale and skipped.
A merge touches two neighbours, so a pre-token of n bytes costs O(n) queue operations: very long pre-tokens are safe.

Texts are cut into pre-tokens with array operations where they hold only ASCII and Latin-1 letters; any other text, and any
word with an apostrophe, goes through the pattern itself. Distinct pre-tokens of a chunk are encoded once, with a bounded cache.

Defined cases: a null or empty text has no tokens; special-token strings are ordinary text; text of any length is encoded
whole; repeated rows each give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.piece_cache import PieceCache, distinct, gather
from spanloom.llm.words import chunks

CHUNK_BYTES = 4 << 20
#: Pre-tokens of up to SHORT bytes are merged together, BATCH at once; buckets of up to FEW positions without arrays.
SHORT, BATCH, FEW = 64, 200_000, 6
NONE = (1 << 31) - 1
#: Code points that the pattern's \s matches (fixed values; stated so that every regex engine agrees).
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def portable(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out, inside and outside of sets."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


class RankQueue:
    """Buckets by merge rank under a three-level bitmap."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low, self.mid, self.top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.mark(rank)
        heappush(bucket, position)

    def mark(self, rank: int) -> None:
        word = rank >> 6
        if not self.low[word]:
            if not self.mid[word >> 6]:
                self.top |= 1 << (word >> 6)
            self.mid[word >> 6] |= 1 << (word & 63)
        self.low[word] |= 1 << (rank & 63)

    def first(self) -> int:
        """Lowest rank in use; -1 if none."""
        top = self.top
        if not top:
            return -1
        i = (top & -top).bit_length() - 1
        mid = self.mid[i]
        i = (i << 6) + (mid & -mid).bit_length() - 1
        low = self.low[i]
        return (i << 6) + (low & -low).bit_length() - 1

    def pop(self, rank: int) -> int:
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.clear(rank)
        return position

    def clear(self, rank: int) -> None:
        word = rank >> 6
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.mid[word >> 6] ^= 1 << (word & 63)
            if not self.mid[word >> 6]:
                self.top ^= 1 << (word >> 6)


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 token, space, rank in each line)."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(portable(pattern))
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self._pair_keys = np.array(sorted(self.pairs), dtype=np.int64)
        self._pair_ranks = np.array([self.pairs[k] for k in self._pair_keys.tolist()], dtype=np.int64)
        self._byte_ids = np.array(self.byte_ids, dtype=np.int64)
        self.queue = RankQueue(len(self.tokens))
        self.cache = PieceCache(self.encode_pieces)
        lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self._token_len, self._token_at = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self._token_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ids = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, queue = self.pairs.get, self.queue
        push, first, pop = queue.push, queue.first, queue.pop
        at = [-1] * n  # rank of the pair that starts here; -1: none
        for i in range(n - 1):
            rank = pairs(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                at[i] = rank
                push(rank, i)
        while (rank := first()) >= 0:
            i = pop(rank)
            if at[i] != rank:
                continue  # stale
            gone = after[i]
            ids[i], at[gone] = rank, -1
            ids[gone] = -1
            j = after[i] = after[gone]
            at[i] = -1
            if j < n:
                before[j] = i
                new = pairs(rank << 32 | ids[j])
                if new is not None:
                    at[i] = new
                    push(new, i)
            h = before[i]
            if h >= 0:
                new = pairs(ids[h] << 32 | rank)
                at[h] = -1 if new is None else new
                if new is not None:
                    push(new, h)
        return [t for t in ids if t >= 0]

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, packed. Short ones share one queue; a long one has it for itself."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.int32(whole).tobytes()
            elif len(piece) <= SHORT:
                short.append(i)
            else:
                out[i] = np.array(self.encode_piece(piece), dtype=np.int32).tobytes()
        for a in range(0, len(short), BATCH):
            part = short[a : a + BATCH]
            for i, ids in zip(part, self._encode_together([pieces[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where there is none."""
        at = np.minimum(self._pair_keys.searchsorted(keys), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == keys, self._pair_ranks[at], -1)

    def _encode_together(self, pieces: list[bytes]) -> list[bytes]:
        """The linked lists of all pieces under one queue. In a step each piece merges its first position of the rank."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        own = np.repeat(np.arange(len(pieces)), sizes)
        ids = np.append(self._byte_ids[data], NONE)  # position n stands for no neighbour
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - sizes] = n, n
        at = np.append(self._lookup(ids[:-1] << 32 | ids[after[:-1]]), -1)
        buckets: list[list] = self.queue.buckets
        mark, first, clear = self.queue.mark, self.queue.first, self.queue.clear
        pairs = self.pairs.get

        def push_all(where: np.ndarray, ranks: np.ndarray) -> None:
            if not len(where):
                return
            order = np.argsort(ranks, kind="stable")
            where, ranks = where[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            where, stops = where.tolist(), [*cuts[1:].tolist(), len(ranks)]
            for a, b, rank in zip(cuts.tolist(), stops, ranks[cuts].tolist(), strict=True):
                if not buckets[rank]:
                    mark(rank)
                buckets[rank] += where[a:b]

        start = np.flatnonzero(at >= 0)
        push_all(start, at[start])
        while (rank := first()) >= 0:
            bucket = buckets[rank]
            if len(bucket) <= FEW:
                bucket.sort()
                clear(rank)
                buckets[rank] = []
                last, later = -1, []
                for i in bucket:
                    if at[i] != rank:
                        continue  # stale
                    if (o := own[i]) == last:
                        later.append(i)
                        continue
                    last = o
                    gone = after[i]
                    j, h = after[gone], before[i]
                    ids[i], at[gone], ids[gone], after[i], before[j] = rank, -1, NONE, j, i
                    right = pairs(rank << 32 | int(ids[j]), -1)
                    left = pairs(int(ids[h]) << 32 | rank, -1)
                    at[i], at[h] = right, left
                    for new, p in ((right, i), (left, int(h))):
                        if new >= 0:
                            if not buckets[new]:
                                mark(new)
                            buckets[new].append(p)
                if later:
                    if not buckets[rank]:
                        mark(rank)
                    buckets[rank] += later
                continue
            i = np.sort(np.array(bucket))
            clear(rank)
            buckets[rank] = []
            i = i[at[i] == rank]
            if not len(i):
                continue
            o = own[i]
            lead = np.append(True, o[1:] != o[:-1])
            later = i[~lead]
            i = i[lead]
            gone = after[i]
            j, h = after[gone], before[i]
            ids[i], at[gone], ids[gone], after[i], before[j] = rank, -1, NONE, j, i
            new = self._lookup(np.concatenate([rank << 32 | ids[j], ids[h] << 32 | rank]))
            at[i], at[h] = new[: len(i)], new[len(i) :]
            at[n] = -1
            some = new >= 0
            push_all(np.concatenate([np.concatenate([i, h])[some], later]), np.concatenate([new[some], np.full(len(later), rank)]))
        alive = ids[:-1] != NONE
        kept, counts = ids[:-1][alive].astype(np.int32), np.bincount(own[alive], minlength=len(pieces))
        packed, stops = kept.tobytes(), (np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def bounds(self, data: np.ndarray, text_ptr: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens begin, with the end."""
        n = len(data)
        if not n:
            return np.zeros(1, np.int64)
        kind = _KIND[data]
        latin = np.zeros(n, dtype=bool)  # both bytes of a Latin-1 letter
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_LATIN_TAIL[data[lead + 1]]]
        latin[lead] = latin[lead + 1] = True
        kind[latin] = LETTER
        begin = np.ones(n + 1, dtype=bool)
        begin[1:-1] = kind[1:] != kind[:-1]
        edges = text_ptr[text_ptr < n]
        begin[edges] = True
        owner_edge = np.zeros(n + 1, dtype=bool)
        owner_edge[text_ptr] = True
        # White space: the last of a run stands apart, and goes with the word if it is a blank.
        space = kind == WHITE
        last = np.flatnonzero(space & np.append(~space[1:], True) & ~owner_edge[1:])
        begin[last] = True
        blank = last[data[last] == 0x20]
        begin[blank + 1] = False
        # Words with an apostrophe, and texts with other characters, go through the pattern.
        hard = kind == OTHER
        odd = np.unique(np.searchsorted(text_ptr, np.flatnonzero(hard), side="right") - 1)
        for t in odd:
            self._by_pattern(data, int(text_ptr[t]), int(text_ptr[t + 1]), begin)
        if (quotes := np.flatnonzero(data == 0x27)).size:
            words = np.flatnonzero(space | owner_edge[:-1])
            done = set(odd.tolist())
            for q in quotes:
                t = int(np.searchsorted(text_ptr, q, side="right")) - 1
                if t not in done:
                    a = max(int(text_ptr[t]), int(words[np.searchsorted(words, q, side="right") - 1]))
                    if data[a] != 0x20 and space[a]:
                        a += 1
                    elif data[a] == 0x20 and a > text_ptr[t] and space[a - 1] and not begin[a]:
                        begin[a] = True
                    stop = np.searchsorted(words, q, side="right")
                    b = int(words[stop]) if stop < len(words) else n
                    self._by_pattern(data, a, min(b, int(text_ptr[t + 1])), begin)
        return np.flatnonzero(begin)

    def _by_pattern(self, data: np.ndarray, a: int, b: int, begin: np.ndarray) -> None:
        begin[a + 1 : b] = False
        at = a
        for match in self.pattern.finditer(data[a:b].tobytes().decode("utf-8")):
            begin[at] = True
            at += len(match[0].encode("utf-8"))

    def encode_chunk(self, data: np.ndarray, text_ptr: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Codes of all pre-tokens, ids of the distinct ones, and each text's bounds among the pre-tokens."""
        bounds = self.bounds(data, text_ptr)
        codes, pieces = distinct(data, bounds)
        return codes, self.cache(pieces), np.searchsorted(bounds, text_ptr)

    def encode(self, text: str | None) -> list[int]:
        data = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
        codes, blobs, _ = self.encode_chunk(data, np.array([0, len(data)]))
        return gather(codes, blobs)[0].tolist()

    def decode_ids(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        sizes = self._token_len[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        return self._token_bytes[np.repeat(self._token_at[ids] - (ends - sizes), sizes) + np.arange(total)]

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.decode_ids(np.asarray(ids, dtype=np.int64)).tobytes()


LETTER, DIGIT, MARK, WHITE, OTHER = range(5)
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[0x21:0x7F] = MARK
_KIND[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = MARK
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = WHITE
_KIND[0x30:0x3A] = DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_LATIN_TAIL = np.zeros(256, dtype=bool)
_LATIN_TAIL[0x80:0xC0] = True
_LATIN_TAIL[[0x97, 0xB7]] = False


@lru_cache(maxsize=4)
def coder(rank_file: str, pattern: str) -> ByteBPE:
    """One for each worker process."""
    return ByteBPE(rank_file, pattern)


def _encoded(docs: DataFrame, rank_file: str, pattern: str, id_column: str, text_column: str, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_file, pattern)
        for batch in batches:
            for rows, data, ptr in chunks(batch, text_column, CHUNK_BYTES):
                codes, blobs, texts = bpe.encode_chunk(data, ptr)
                yield pa.RecordBatch.from_arrays([rows.column(id_column), *row(bpe, codes, blobs, texts)], names=[id_column, *(c.split()[0] for c in schema.split(","))])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {schema}")


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and ids array<int> of each whole text."""

    def row(bpe, codes, blobs, texts):
        ids, bounds = gather(codes, blobs)
        return [pa.ListArray.from_arrays(pa.array(bounds[texts].astype(np.int32)), pa.array(ids))]

    return _encoded(docs, rank_file, pattern, id_column, text_column, "ids array<int>", row)


def decode_texts(encoded: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id and decoded binary of each list of ids; a null list decodes to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_file, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array([bpe.decode(x or []) for x in batch.column(ids_column).to_pylist()], pa.binary())], names=[id_column, "decoded"])

    kind = dict(encoded.dtypes)[id_column]
    return encoded.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes decoded from them: id, n_tokens, ids_sha256, decoded_sha256."""

    def row(bpe, codes, blobs, texts):
        ids, bounds = gather(codes, blobs)
        numbers = [",".join(map(str, np.frombuffer(b, np.int32).tolist())) for b in blobs]
        n, of_ids, of_bytes = [], [], []
        for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True):
            n.append(int(bounds[b] - bounds[a]))
            of_ids.append(hashlib.sha256(",".join(map(numbers.__getitem__, codes[a:b].tolist())).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(bpe.decode_ids(ids[bounds[a] : bounds[b]])).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    return _encoded(docs, rank_file, pattern, id_column, text_column, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def multilingual_50k() -> tuple[str, str]:
    """Rank file and pattern of the public many-language vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *multilingual_50k())


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES: dict = {}
