"""Words of a block of texts as numbers: where they lie, and which of them are equal."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from tarnwork.llm.common import mix

_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)  # the first n of eight bytes


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of bytes that ``inside`` (by byte) marks; no run leaves its text."""
    marked = np.concatenate([[False], inside[data], [False]])
    edges = np.flatnonzero(marked[1:] != marked[:-1])  # where runs begin and end, in turn
    starts, ends = edges[0::2], edges[1::2]
    cut = np.unique(offsets[1:-1])
    joined = cut[marked[cut] & marked[cut + 1]]  # texts that meet inside a run
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    upto = np.searchsorted(starts, offsets)
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(upto))


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(first 8 bytes, next 8 bytes, length up to 17, the words of 17) of every span; of those, the first is a digest."""
    size = end - start
    padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(24, np.uint8)]), 8)
    head = padded[start].view("<u8").ravel() & _LOW[np.minimum(size, 8)]
    rest = padded[start + 8].view("<u8").ravel() & _LOW[np.clip(size - 8, 0, 8)]
    long, longer = np.flatnonzero(size > 16), []
    if len(long):
        raw = data.tobytes()
        longer = [raw[a:b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        head[long] = [xxhash.xxh3_64_intdigest(w) for w in longer]
        rest[long] = 0
    return head, rest, np.minimum(size, 17).astype(np.uint64), longer


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, the same in every block."""
    head, rest, size, _ = _keys(data, start, end)
    return mix(head ^ mix(rest ^ mix(size)))


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of every span, first span of every code, hash of every code): equal bytes, equal code; compared whole."""
    head, rest, size, longer = _keys(data, start, end)
    hashed = mix(head ^ mix(rest ^ mix(size)))
    numbers: dict[bytes, int] = {}
    size[size == 17] += np.array([numbers.setdefault(w, len(numbers)) for w in longer], dtype=np.uint64)  # tells longer words apart
    codes, _ = pd.factorize(hashed)
    first = np.zeros(int(codes.max()) + 1 if len(codes) else 0, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    at = first[codes]
    if not ((head[at] == head) & (rest[at] == rest) & (size[at] == size)).all():  # two words of one hash
        _, first, codes = np.unique(np.stack([head, rest, size], axis=1), axis=0, return_index=True, return_inverse=True)
        codes = codes.ravel()
    return codes.astype(np.int64), first, hashed[first]


def taken(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The spans as strings."""
    upto = np.concatenate([[0], np.cumsum(end - start)])
    place = np.repeat(start - upto[:-1], end - start) + np.arange(upto[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data[place]))
