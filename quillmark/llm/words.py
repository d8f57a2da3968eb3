"""Whole-batch word work on Arrow string buffers with numpy: splitting at ASCII white space, word ids, word hashes.

All functions take a contiguous run of texts as bytes plus row offsets, so no per-word Python runs; only distinct words
of a batch are touched one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes that are no digit, ASCII letter or part of a character beyond ASCII.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Bytes of text handled at once.
BLOCK_BYTES = 4 << 20


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `most` bytes: (first row, row after the last, bytes, offsets from 0)."""
    flat, offsets = raw(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split(flat: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words up to each row bound (rows + 1 values). `between` says of each byte whether it
    separates words."""
    inside = ~between[flat]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(flat)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def dictionary(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the distinct words by number."""
    if not len(starts):
        return np.zeros(0, np.int32), []
    packed = flat[~SPACE[flat]]
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


_HASHES: dict[bytes, int] = {}


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if len(_HASHES) > 1_000_000:
        _HASHES.clear()
    get, out = _HASHES.get, np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


#: Words of more bytes are hashed one by one.
LONG = 256


def hashed(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process, eight bytes of all words at a time: no dictionary, no cache."""
    size = ends - starts
    padded = np.zeros(len(flat) + 8, np.uint8)
    padded[: len(flat)] = flat
    eight = np.ndarray((len(flat) + 1,), np.uint64, padded, strides=(1,))
    out = size.astype(np.uint64)
    now = np.flatnonzero(size <= LONG)
    at = 0
    while len(now):
        left = np.minimum(size[now] - at, 8).astype(np.uint64)
        part = eight[starts[now] + at] << ((np.uint64(8) - left) * np.uint64(8))  # little-endian: bytes past the word are shifted out
        out[now] = mix((out[now] ^ mix(part * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(at + 1))
        at += 8
        now = now[size[now] > at]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(flat[starts[i] : ends[i]].tobytes())
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def windows(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which `width` values of one row begin, and the hash of each such window of 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    good = np.ones(n, bool)
    for k in range(1, width):  # a window must not cross a row bound
        cut = bounds[1:-1] - k
        good[cut[(cut >= 0) & (cut < n)]] = False
    h = np.full(n, 0x51ED270B, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n])
    at = np.flatnonzero(good)
    return at, h[at]
