"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a value between them that differs from either in at most r. So every
distinct fingerprint emits all values within r bits (2,081 for r = 2), and fingerprints that meet in a value are linked;
by the triangle inequality each such link is within 2r bits, which is verified again. A meeting value's fingerprints
are all within its ball, so a group has at most that many members and is linked as a star; no pairs are listed.

Almost no value meets another, so values aren't shuffled as rows: exchange.py finds those whose hash a second block
has, in about two bytes each, and only (value, fingerprint) rows that may meet are shuffled, one for each block.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null doc_id gets its
component like any row, but is no component's id unless all its ids are null; rows that repeat a doc_id are rows of their
own; texts may be of any length; columns of other names are ignored, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import hashing as H
from .components import connected_components
from .store import written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Distinct fingerprints of a block; values of a range.
BLOCK_FINGERPRINTS, RANGE_VALUES = 4096, 8_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's shingles of words; letters A-Z count as a-z."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)].view(np.uint8)
        votes += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = []
            for data, offsets in H.pieces(b.column("text")):
                data = data.tobytes()
                fps += [fingerprint(data[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            fps = np.array(fps, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> np.ndarray:
    """What to flip to reach every value within so many bits."""
    return np.array([sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(64), n)], np.uint64)


def _keys(fps: np.ndarray, flips: np.ndarray, ranges: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values, their short() hashes, their fingerprints), for some fingerprints at a time."""
    for i in range(0, len(fps), 128):
        values = (fps[i : i + 128, None] ^ flips[None, :]).ravel()
        yield values, X.short(H.mix(values), ranges), np.repeat(fps[i : i + 128], len(flips))


def _sorted_keys(fps: np.ndarray, flips: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, and those of them that the block has more than once."""
    keys = np.empty(len(fps) * len(flips), np.uint64)
    at = 0
    for _, k, _ in _keys(fps, flips, ranges):
        keys[at : at + len(k)] = k
        at += len(k)
    keys.sort()
    same = keys[1:] == keys[:-1]
    twice = keys[1:][same]
    return keys[np.r_[True, ~same]] if same.any() else keys, np.unique(twice)


def links_within(fps: DataFrame, count: int, radius: int) -> DataFrame:
    """(a, b): stars over the distinct fp of fps that link every two within radius (even) bits, as far as components go."""
    if radius % 2:
        raise ValueError("the radius is halved, so it must be even")
    flips = ball(radius // 2)
    blocks, ranges = X.n_blocks(count, BLOCK_FINGERPRINTS), X.n_ranges(count * len(flips), RANGE_VALUES)
    # a task for each block: its few bytes of fingerprints become thousands of times as many values
    by_block = fps.select(X.block_of(blocks, "fp").alias("block"), "fp").repartition(blocks, "block").groupBy("block")
    own = lambda t: np.unique(t.column("fp").to_numpy().view(np.uint64))

    def emit(t: pa.Table) -> pa.Table:
        return X.short_cells(t.column("block")[0].as_py(), _sorted_keys(own(t), flips, ranges)[0])

    def meet(t: pa.Table, replies: pa.Table) -> pa.Table:
        rows = {"kind": [], "a": [], "b": []}
        if t.num_rows:
            mine = own(t)
            keys, twice = _sorted_keys(mine, flips, ranges)
            met = np.union1d(keys[X.answers(replies, keys >> np.uint64(32))[:, 0]], twice)
            del keys
            values, members = [], []
            for v, k, f in _keys(mine, flips, ranges):
                hit = X.member(k, met)
                values.append(v[hit])
                members.append(f[hit])
            v, f = np.concatenate(values), np.concatenate(members)
            order = np.lexsort((f, v))
            v, f = v[order], f[order]
            first = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
            stars = np.unique(np.stack([f[first][np.cumsum(first) - 1][~first], f[~first]], axis=1), axis=0)
            rows["kind"] = np.repeat(np.array([0, 1], np.int32), [first.sum(), len(stars)])
            rows["a"] = np.concatenate([v[first], stars[:, 0]]).view(np.int64)
            rows["b"] = np.concatenate([f[first], stars[:, 1]]).view(np.int64)
        return pa.table(rows, schema=pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))

    replies = X.answered(by_block.applyInArrow(emit, X.CELLS), X.judge_short)
    rows = written(by_block.cogroup(replies.groupBy("block")).applyInArrow(meet, "kind int, a long, b long"), "met")
    groups = rows.where("kind = 0").groupBy("a").agg(F.collect_set("b").alias("all")).where(F.size("all") > 1)
    across = groups.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return rows.where("kind = 1").select("a", "b").unionByName(across).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id that links of radius bits reach."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links_within(fps, fps.count(), radius))
    rooted = fps.join(roots, fps.fp == roots.id, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
