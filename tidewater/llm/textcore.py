"""Vectorised word and window hashing over Arrow string buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, the same as the
pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8. Every function works on whole texts;
memory follows one slice of documents (`SLICE` bytes, or one longer document).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers of the polynomial hashes.
M_BYTE, M_WORD, M_WORD2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Words of more bytes are hashed by blake2b: texts of that length can be made on which a polynomial modulo 2^64 collides.
LONG_WORD = 1024
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay within `size`, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        _powers.clear()
        up, down = np.full(n, M_BYTE, U64), np.full(n, pow(M_BYTE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers[n] = np.cumprod(up), np.cumprod(down)
    return _powers[n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    up, down = _table(SLICE + 1)
    lo, n = 0, len(starts)
    while lo < n:
        base = int(starts[lo])
        hi = int(np.searchsorted(ends, base + SLICE, "right"))
        if hi <= lo:  # one word longer than a slice
            lo += 1
            continue
        part = data[base : int(ends[hi - 1])].astype(U64)
        part += U64(1)
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(M_WORD))
        lo = hi
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), U64)[0]
    return out


def window_hashes(words: np.ndarray, width: int, mult: int = M_WORD) -> np.ndarray:
    """Hash of the `width` words from each index; the last width-1 indices have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= U64(mult)
        out += words[k : k + n]
    return mix(out ^ U64(width * 0x9E3779B1))


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word its text's index, from the first-word table."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Kept words of each text joined by one space, as a string array."""
    n_rows = len(first) - 1
    mask = np.zeros(len(data) + 2, np.int32)
    mask[starts[keep]] += 1
    kept_idx = np.flatnonzero(keep)
    rows = row_of(first)[kept_idx]
    is_last = np.ones(len(kept_idx), bool)
    is_last[:-1] = rows[1:] != rows[:-1]
    stop = ends[kept_idx] + ~is_last  # the byte after a word stands for the space
    np.subtract.at(mask, stop, 1)
    inside = np.cumsum(mask[: len(data)]) > 0
    out = np.where(SPACE[data], np.uint8(32), data)[inside]
    size = (ends - starts)[kept_idx] + ~is_last
    lengths = np.bincount(rows, weights=size, minlength=n_rows).astype(np.int64)
    offsets = np.zeros(n_rows + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), n_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())
