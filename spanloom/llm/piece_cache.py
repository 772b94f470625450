"""Distinct byte pieces of a chunk, and a bounded cache of what a tokenizer makes of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

#: Entries of one generation; a worker keeps two generations at most.
GENERATION = 300_000


class PieceCache:
    """piece -> token ids packed as int32 bytes. When a generation is full the older one goes; pieces in use move on."""

    def __init__(self, encode: Callable[[Sequence[bytes]], Sequence[bytes]]):
        self._encode, self._new, self._old = encode, {}, {}

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        new, old, out, missing = self._new, self._old, [], []
        for i, piece in enumerate(pieces):
            ids = new.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    missing.append(i)
                else:
                    new[piece] = ids
            out.append(ids)
        if missing:
            for i, ids in zip(missing, self._encode([pieces[i] for i in missing]), strict=True):
                out[i] = new[pieces[i]] = ids
        if len(new) > GENERATION:
            self._old, self._new = new, {}
        return out


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes and distinct values of the pieces data[bounds[i]:bounds[i+1]], which tile data."""
    if len(bounds) < 2:
        return np.zeros(0, np.int64), []
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces.dictionary.to_pylist()


def gather(codes: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces in order, and the bounds of each piece in them."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    flat, at = np.frombuffer(b"".join(blobs), dtype=np.int32), np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.concatenate([[0], np.cumsum(sizes[codes])])
    return flat[np.repeat(at[codes] - bounds[:-1], sizes[codes]) + np.arange(bounds[-1])], bounds
