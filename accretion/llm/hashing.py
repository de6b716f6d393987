"""Hashes of substrings and word windows with numpy.

A polynomial over 64-bit words with wrap-around: prefix sums of x[i] * BASE^i, differences of which, times BASE^-i, hash
any stretch of x. The result passes a finaliser, so that all of its bits can be used.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None

#: Odd multipliers; BASES[1] serves as an independent check of BASES[0].
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def freed(result):
    """result, after the memory that its making needed has gone back to the system: a worker keeps what it doesn't return."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return result


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    n_ = 1 << max(16, (n - 1).bit_length())
    return (_powers if n_ <= 1 << 20 else _powers.__wrapped__)(base, n_)[:n]  # long ones aren't kept


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser: every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(x: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Prefix sums c with c[0] = 0, for stretch()."""
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(base, len(x)) if len(x) else c[:0], out=c[1:])
    return c


def stretch(c: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of x[start:end] for each pair."""
    inv = powers(inverse(base), len(c))
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64))


def windows(c: np.ndarray, length: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every x[i:i+length]."""
    n = len(c) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((c[length:] - c[:n]) * powers(inverse(base), n))


def spans_of_words(data: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't white space; edges: offsets that no run crosses."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACES[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    if edges is not None:
        inner = edges[(edges > 0) & (edges < len(data))]
        begins[inner] |= word[inner]
        stops[inner - 1] |= word[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def hashes_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0], step: int = 1 << 17) -> np.ndarray:
    """Hash of each data[start:end]; so many words at a time, to bound memory."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], ends[i : i + step]
        c = prefix(data[s[0] : e[-1]].astype(np.uint64) + np.uint64(1), base)
        out[i : i + step] = stretch(c, s - s[0], e - s[0], base)
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls, not copied if it is in one piece; offsets start at 0."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.cast(pa.large_string()).chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column, step: int = 1 << 20):
    """text_buffers() of some rows at a time, of about step bytes together: numpy's temporary arrays are many times a text's size."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1))
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
