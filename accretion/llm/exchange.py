"""Which hashes occur in more than one block of a corpus: a compact exchange between blocks and ranges of hashes.

The rows of a table are dealt into blocks of bounded size by a hash. Each block sends every distinct hash that it holds
once, sorted and delta-coded, in one cell for each range of hashes; a range sees each block's hashes at most once, so
that a hash which a third of all rows share is no larger than any other. The range answers each cell with one or two
bits a hash, in the order sent; the block, which makes the same hashes again from the same rows, reads them off.
Nothing is ever collected: a cell is bounded by a block, a range by its share of all hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H

CELLS = "rng int, block long, blob binary"
CELL_SCHEMA = pa.schema([("rng", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])


def n_blocks(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def n_ranges(entries: float, each: int = 4_000_000, least: int = 24) -> int:
    """So many that a range holds about each entries."""
    return max(least, math.ceil(entries / each))


def block_of(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("long")


# -- coding -----------------------------------------------------------------------------------------------------------


def planes(x: np.ndarray) -> bytes:
    """The values byte by byte, all first bytes before all second ones: zeros lie together and vanish in compression."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(blob, kind, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """(values, where the next begin)."""
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(raw.T).view(kind).reshape(n), at + n * size


def sealed(low: np.ndarray, *values: np.ndarray) -> bytes:
    """Ascending uint32 or uint64 values as differences, then other columns."""
    head = np.int64(len(low)).tobytes()
    return head + planes(np.diff(low, prepend=low.dtype.type(0))) + b"".join(planes(v) for v in values)


def opened(blob, kind, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    d, at = unplanes(blob, kind, n, 8)
    out = [np.cumsum(d, dtype=kind)]
    for k in kinds:
        v, at = unplanes(blob, k, n, at)
        out.append(v)
    return out


def in_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit hash, from its upper half; ascending with it."""
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def short(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range in the upper and the hash's lower half in the lower 32 bits: enough to find candidates, since ranges grow with the corpus."""
    return (in_range(h, ranges) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def runs(rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values of ascending rng, where each begins and the last one ends)."""
    first = np.flatnonzero(np.r_[len(rng) > 0, rng[1:] != rng[:-1]])
    return rng[first], np.r_[first, len(rng)]


def cells(block: int, rng: np.ndarray, seal: Callable[[slice], bytes]) -> pa.Table:
    """A row for each range that ascending rng has: work and rows don't grow with the number of all ranges."""
    full, at = runs(rng)
    blobs = [seal(slice(a, b)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.table([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block, np.int64)), pa.array(blobs, pa.binary())], schema=CELL_SCHEMA)


def short_cells(block: int, keys: np.ndarray) -> pa.Table:
    """Cells of ascending distinct short() values."""
    return cells(block, keys >> np.uint64(32), lambda s: sealed((keys[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def answers(table: pa.Table, rng: np.ndarray, each: int = 1) -> np.ndarray:
    """The bits that the ranges gave back for what a block sent, as (len(rng), each) booleans."""
    out = np.zeros((len(rng), each), bool)
    known = table.column("rng").to_numpy().astype(rng.dtype)
    begin, end = np.searchsorted(rng, known), np.searchsorted(rng, known, side="right")
    for a, b, blob in zip(begin.tolist(), end.tolist(), table.column("blob"), strict=True):
        n = b - a
        out[a:b] = np.unpackbits(np.frombuffer(blob.as_buffer(), np.uint8), count=n * each).astype(bool).reshape(n, each)
    return out


# -- the ranges' side ---------------------------------------------------------------------------------------------------


def repeated(a: np.ndarray) -> np.ndarray:
    """The distinct values of a that occur more than once; ascending."""
    a = np.sort(a)
    twice = a[1:][a[1:] == a[:-1]]
    return twice[np.r_[True, twice[1:] != twice[:-1]]] if len(twice) else twice


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each x is in ascending of."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def answered(sent: DataFrame, judge: Callable[[list], list[np.ndarray]]) -> DataFrame:
    """judge gets the blobs of one range and gives flags for each, in order."""

    def one(t: pa.Table) -> pa.Table:
        flags = judge([b.as_buffer() for b in t.column("blob")])
        return H.freed(pa.table([t.column("rng"), t.column("block"), pa.array([bits(f) for f in flags], pa.binary())], schema=CELL_SCHEMA))

    return sent.groupBy("rng").applyInArrow(one, CELLS)


def judge_short(blobs: list) -> list[np.ndarray]:
    """For short_cells(): whether another block has the same hash."""
    lows = [opened(b, np.uint32)[0] for b in blobs]
    twice = repeated(np.concatenate(lows))
    return [member(x, twice) for x in lows]
