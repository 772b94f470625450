"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]; in UTF-8 those bytes never occur inside another
character, so byte runs and character runs are the same words. Hashes depend on the bytes alone, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; bounds the memory of a task whatever the batch size.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply rounds)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LENGTH, _FIRST, _SECOND = U(0xA24BAED4963EE407), U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def _at_place(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each value at each place, as good as drawn for the pair."""
    return mix(values * _FIRST ^ mix(place.astype(U) + _SECOND))


#: The numbers of all bytes at the first places of a range; later places are worked out.
PLACES = 16
_BYTES = np.stack([_at_place(np.arange(1, 257, dtype=U), np.full(256, i)) for i in range(PLACES)])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of every member of every range, and its place in the range."""
    ends = np.cumsum(sizes)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return np.repeat(starts, sizes) + place, place


def list_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of values[s:e] for each range: the sum of numbers drawn for each value and place. Costs what all ranges hold together: for ranges that do not overlap.

    Unlike powers of a base modulo 2**64, for which pairs of long sequences are known to collide, no structure of the sequences carries over.
    """
    size = ends - starts
    at, place = _spread(starts, size)
    total = np.concatenate([[U(0)], np.cumsum(_at_place(values[at] + U(seed), place))])
    stop = np.cumsum(size)
    return mix(total[stop] - total[stop - size] + size.astype(U) * _LENGTH)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of values[s:e] for each range, which may overlap: that of its first and last runs of the largest power of two that fits, which cover it.

    Runs of each power of two are hashed from two of the one below, so that the cost is that of all values for each power.
    """
    size = ends - starts
    out = np.full(len(starts), mix(np.array([seed], dtype=U))[0], dtype=U)
    run, length, longest = mix(values + U(seed)), 1, int(size.max(initial=0))
    while length <= longest:
        own = np.flatnonzero((size >= length) & (size < 2 * length))
        out[own] = mix(run[starts[own]] * _FIRST + mix(run[ends[own] - length] + size[own].astype(U) * _LENGTH))
        if 2 * length <= longest:
            run = mix(run[:-length] * _FIRST + mix(run[length:] + _SECOND))
        length *= 2
    return out


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[s:e] for each range of bytes, in ascending order and apart. Memory is bounded by CHUNK_BYTES or the longest range, whatever the text."""
    if len(data) > CHUNK_BYTES and len(starts) > 1:
        out, i = np.zeros(len(starts), dtype=U), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
            a, b = int(starts[i]), int(ends[j - 1])
            out[i:j] = byte_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a)
            i = j
        return out
    size, out = ends - starts, np.zeros(len(starts), dtype=U)
    own, first = np.arange(len(starts)), starts
    for place in range(PLACES):  # of all ranges at once, as far as they go
        more = size[own] > place
        own, first = own[more], first[more]
        if not len(own):
            break
        out[own] += _BYTES[place][data[first + place]]
    long = np.flatnonzero(size > PLACES)
    if len(long):
        rest = size[long] - PLACES
        at, place = _spread(starts[long] + PLACES, rest)
        total = np.concatenate([[U(0)], np.cumsum(_at_place(data[at].astype(U) + U(1), place + PLACES))])
        stop = np.cumsum(rest)
        out[long] += total[stop] - total[stop - rest]
    return mix(out + size.astype(U) * _LENGTH)


@dataclass
class Words:
    """The words of some texts: words of text i are [ptr[i], ptr[i+1]); start and end are byte offsets into data."""

    data: np.ndarray
    text_ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in slices of about limit bytes; a longer text is a slice of its own."""
    data, ptr = text_column(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ptr, ptr[row] + limit, side="right")) - 1)
        stop = min(stop, batch.num_rows)
        yield batch.slice(row, stop - row), data[ptr[row] : ptr[stop]], ptr[row : stop + 1] - ptr[row]
        row = stop


def joined(words: "Words", keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts that are kept, joined by one space within a text: bytes, and the bounds of each text in them."""
    start, end, owner = words.start, words.end, words.owner()
    if keep is not None:
        start, end, owner = start[keep], end[keep], owner[keep]
    more = np.zeros(len(start), dtype=bool)  # another word of the text follows, so there is a blank to take along
    more[:-1] = owner[1:] == owner[:-1]
    data = words.data.copy()
    data[end[more]] = 0x20
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[start] += 1
    edge[end + more] -= 1
    sizes = np.concatenate([[0], np.cumsum(end - start + more)])
    return data[np.cumsum(edge[:-1], dtype=np.int8) > 0], sizes[np.searchsorted(owner, np.arange(len(words.ptr)))]


def pieces_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[s:e] for each range, as a binary column; ranges may overlap."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)] if at[-1] else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(taken))]).cast(pa.binary())


def split_words(data: np.ndarray, text_ptr: np.ndarray) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = text_ptr[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    return Words(data, text_ptr, start, end, np.searchsorted(start, text_ptr, side="left"))
