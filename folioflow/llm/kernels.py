"""Vectorised text kernels over the UTF-8 buffers of Arrow string columns.

Every function works on whole texts. Batches are cut into chunks of a quarter megabyte of text so that
the numpy temporaries of a Python worker stay bounded whatever the batch size is; one text longer
than the chunk makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
# Arrow's own allocators keep what is freed; the system's gives it back. Left alone it would raise the size from which it does so, and keep one heap a thread.
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):
    for _option, _value in ((-3, 4 << 20), (-1, 8 << 20), (-8, 1)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
        _libc.mallopt(_option, _value)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pows: dict[str, np.ndarray] = {}

#: Byte classes. Continuation bytes of UTF-8 count as word bytes in each.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, from 0; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text each, with their buffers."""
    for batch in batches:
        i, n = 0, batch.num_rows
        if not n:
            continue
        data, off = buffers(batch.column(batch.schema.get_field_index(column)))
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    release()


def release() -> None:
    """Gives freed memory back to the system: Spark keeps idle workers, and they count against the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pows or len(_pows["p"]) < n + 1:
        m = max(n + 1, CHUNK_BYTES + 1)
        for k, base in (("p", _P), ("q", _PINV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _pows[k] = np.cumprod(x, dtype=np.uint64)
    return _pows["p"], _pows["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of word bytes; and the n + 1 offsets of each text's words."""
    m = word[data]
    if not m.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = m[cut]
    last[cut - 1] = m[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


#: The first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes.

    Every block of eight bytes is mixed with its number in the span before blocks are summed up, so that no structure of the text
    carries over to the sum, as it would to a polynomial modulo a power of two.
    """
    size = ends - starts
    blocks = (size + 7) >> 3
    total = np.concatenate([[0], np.cumsum(blocks)])
    span = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(int(total[-1])) - total[span]
    at = starts[span] + 8 * number
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    block = eight[at] & _FIRST[np.minimum(ends[span] - at, 8)]
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(mix(block + (number + 1).astype(np.uint64) * _P), dtype=np.uint64, out=sums[1:])
    return mix((sums[total[1:]] - sums[total[:-1]]) * _PINV + size.astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the n + 1 offsets of each text's words."""
    if lower:
        data = LOWER[data]
    starts, ends, woff = spans(data, off, word)
    return span_hash(data, starts, ends), woff


def shingles(wh: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; the last k - 1 run over the end and are void.

    A difference of prefix sums of a polynomial, so long runs cost no more than short ones. Its terms are mixed hashes and k is far
    below the thousand terms from which sequences exist that such a sum cannot tell apart.
    """
    n = len(wh)
    out = np.zeros(n, np.uint64)
    if n >= k:
        p, q = _power(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(wh * p[:n], dtype=np.uint64, out=sums[1:])
        out[: n - k + 1] = mix((sums[k:] - sums[: n - k + 1]) * q[: n - k + 1])
    return out


def shingle_set(wh: np.ndarray, sh: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct shingles of one text, from its slices of words() and shingles(); fewer than k words are one shingle."""
    n = len(wh)
    if not n:
        return np.zeros(0, np.uint64)
    if n < k:
        h = np.uint64(n)
        for x in wh:
            h = np.uint64((int(h) * 0x100000001B3 + int(x)) & 0xFFFFFFFFFFFFFFFF)
        return mix(np.array([h ^ np.uint64(0x5BD1E995)], np.uint64))
    return np.unique(sh[: n - k + 1])
