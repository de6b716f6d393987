"""Suffix-array dedup: a depth-limited radix sort of suffixes, most significant digits first.

Only the first `depth` bytes of a suffix count, so a full suffix array isn't needed: groups of suffixes that are equal
through that depth are exactly the repeated windows. Passes go from the most significant digit on: after each, suffixes
are known to be equal through some prefix, and only those in groups of two or more go on to the next digit.

First digit. It has depth - spread bytes, and is sorted for one suffix in many: of the stretches of that size within a
window of `depth` bytes, the one with the smallest hash (the leftmost of equals) is the window's anchor; neighbouring
windows mostly have one anchor in common, and equal windows have equal anchors. One entry for each anchor goes to the
range of its hash, with a hash of all bytes that its windows cover. An anchor that occurs nowhere else ends there: none
of its windows is repeated. Where also the whole stretch is found again, all of its windows are repeated.

Further digits. Suffixes of anchors that occur with different stretches, at the edges of repeats, are sorted one by one:
each pass refines the groups by the next `digit` bytes, until they are equal through the full depth or alone. A stretch
that is repeated whole takes part once in each block.

A pass deals suffixes to ranges of hashes of their prefixes (equality is all that groups need, not the bytes' order), and
ranges sort them; entries go through exchange.py, so no group of equal suffixes, however large, meets in one task.

Defined results: null texts have no bytes; rows that repeat one id are different documents; a text may be of any length,
as it is worked through in segments of `segment` windows, which only moves some windows from the first digit to the
next; columns of other names are ignored, so none can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import hashing as H

DEPTH = 400
#: Windows that share an anchor at most, less one: the first digit has DEPTH - SPREAD bytes, the next ones DIGIT each.
SPREAD, DIGIT = 128, 64
BLOCK_BYTES = 1 << 20
#: Windows of one segment; with positions in 20 bits, several segments are worked on together.
SEGMENT, BATCH, PLACE_BITS = 1 << 17, 1 << 18, 20
#: Entries of a range: of anchors, and of suffixes if all of them went on to further digits.
RANGE_ANCHORS, RANGE_SUFFIXES = 500_000, 4_000_000
#: Bytes hashed, and entries sorted, at a time.
STEP, SORTED = 1 << 19, 1 << 18
RESULT = "doc_id long, n_bytes long, n_spans long, kept binary"


def prefixes(depth: int, spread: int, digit: int) -> list[int]:
    """Through how many bytes suffixes are sorted after each digit: 400, 128 and 64 give 272, 336 and 400."""
    return [*range(depth - spread, depth, digit), depth]


def batches(offsets: np.ndarray, depth: int, segment: int):
    """Lists of (start, end) of segments in the block's bytes, about BATCH bytes together; texts shorter than depth have none."""
    some, size = [], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for at in range(a, b - depth + 1, segment):
            end = min(b, at + segment + depth - 1)
            if some and size + end - at > BATCH:
                yield some
                some, size = [], 0
            some.append((at, end))
            size += end - at
    if some:
        yield some


class Part:
    """The anchors of some segments: for each, its windows lo..hi (in the block's bytes) and the hashes."""

    def __init__(self, data: np.ndarray, segments: list, depth: int, spread: int):
        x = np.concatenate([data[a:b] for a, b in segments]) if len(segments) > 1 else data[segments[0][0] : segments[0][1]]
        lengths = np.array([b - a for a, b in segments])
        begins = np.cumsum(lengths) - lengths
        self.depth, digit = depth, depth - spread
        self.c = H.prefix(x.astype(np.uint64) + np.uint64(1))
        h = H.windows(self.c, digit)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= spread + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if rest := spread + 1 - width:
            low = np.minimum(low[:-rest], low[rest:])
        anchor = (low & mask).astype(np.int64)
        segment = np.repeat(np.arange(len(segments)), lengths)[: len(anchor)]
        valid = np.arange(len(anchor)) + depth <= (begins + lengths)[segment]
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (segment[1:] != segment[:-1])
        last = valid.copy()
        last[:-1] &= new[1:] | ~valid[1:]
        self.lo, self.hi = np.flatnonzero(new), np.flatnonzero(last)
        # mixed again: smallest hashes of windows are small numbers, nearly all of which one range would get
        self.anchor = H.mix(h[anchor[self.lo]])
        self.span = H.stretch(self.c, self.lo, self.hi + depth)
        self.shift = (np.array([a for a, _ in segments]) - begins)[segment[self.lo]]

    def suffixes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the block, check) of each window of the anchors chosen; ascending."""
        lo, n = self.lo[which], self.hi[which] - self.lo[which] + 1
        at = np.repeat(lo + self.shift[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return at, np.repeat((H.mix(self.anchor[which]) >> np.uint64(32)).astype(np.uint32), n)


def pairs(a: np.ndarray, b: np.ndarray):
    """Distinct (a, b), ascending; how often; and the pair of each row."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return x[new], y[new], np.bincount(group, minlength=int(new.sum())), group


def runs(x: np.ndarray) -> np.ndarray:
    """For each of ascending x, how many are equal to it."""
    if not len(x):
        return np.zeros(0, np.int64)
    group = np.cumsum(np.r_[True, x[1:] != x[:-1]]) - 1
    return np.bincount(group)[group]


class Block:
    """The suffixes of a block's texts, and what passes leave of them."""

    def __init__(self, texts, depth: int, spread: int, digit: int, segment: int):
        self.data, self.offsets = H.text_buffers(texts)
        self.depth, self.spread, self.segment = depth, spread, segment
        self.lengths = prefixes(depth, spread, digit)

    def parts(self):
        for some in batches(self.offsets, self.depth, self.segment):
            yield Part(self.data, some, self.depth, self.spread)

    def anchors(self, ranges: int):
        """Distinct (anchor, stretch), how often, and the pair of each anchor; and where the stretches lie."""
        found = [(p.anchor, p.span, p.lo + p.shift, p.hi + p.shift) for p in self.parts()]
        a, s, lo, hi = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return *pairs(X.short(a, ranges), s), np.stack([lo, hi])

    def first_digit(self, ranges: int, replies: pa.Table):
        """((2, n) stretches [from, to) that are repeated whole, places of the suffixes that go on, their checks)."""
        a, s, n, group, ends = self.anchors(ranges)
        got = X.answers(replies, a >> np.uint64(32), 2)
        whole, mixed = got[:, 1] | (n > 1), got[:, 0] | (runs(a) > 1)
        stretches = ends[:, whole[group]] + np.array([[0], [self.depth]])
        # of stretches that are repeated whole, the first shows its windows to others of the same anchor
        first = np.zeros(len(group), bool)
        first[np.unique(group, return_index=True)[1]] = True
        look = mixed[group] & (~whole[group] | first)
        at, check, some = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], 0
        for p in self.parts() if look.any() else ():
            own = look[some : some + len(p.lo)]
            some += len(p.lo)
            if own.any():
                x, y = p.suffixes(own)
                at.append(x)
                check.append(y)
        return stretches, np.concatenate(at), np.concatenate(check)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hash of the first length bytes of the suffix at each of ascending places."""
        out = np.empty(len(at), np.uint64)
        for a in range(0, len(self.data), STEP):
            lo, hi = np.searchsorted(at, [a, a + STEP])
            if lo < hi:
                c = H.prefix(self.data[a : a + STEP + length].astype(np.uint64) + np.uint64(1))
                out[lo:hi] = H.stretch(c, at[lo:hi] - a, at[lo:hi] - a + length)
        return out

    def refined(self, ranges: tuple[int, int], replies: list[pa.Table], last: bool):
        """(stretches, places of the suffixes in groups of two or more, (hash, check) of the digit that replies don't cover).

        replies: those of the digits so far. last: the digits are through.
        """
        stretches, at, check = self.first_digit(ranges[0], replies[0])
        for k, length in enumerate(self.lengths[1:], 1):
            if k == len(replies) and not last:
                return stretches, at, pairs(self.hashes(at, length), check)[:2]
            h, _, n, group = pairs(self.hashes(at, length), check)
            go_on = (X.answers(replies[k], X.in_range(h, ranges[1]))[:, 0] | (n > 1))[group]
            at, check = at[go_on], check[go_on]
        return stretches, at, None

    def gone(self, stretches: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each byte is covered."""
        steps = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(steps, np.concatenate([stretches[0], at]), 1)
        np.add.at(steps, np.concatenate([stretches[1], at + self.depth]), -1)
        return np.cumsum(steps[:-1], dtype=np.int32) > 0


def judge_anchors(blobs: list) -> list[np.ndarray]:
    """Two flags for each (anchor, stretch): whether the anchor has other stretches, too, and whether another block has the pair."""
    got = [X.opened(b, np.uint32, np.uint64) for b in blobs]
    a, s = (np.concatenate(x) for x in zip(*got, strict=True))
    x, _, n, group = pairs(a, s)
    flags = np.stack([(runs(x) > 1)[group], n[group] > 1], axis=1)
    return np.split(flags, np.cumsum([len(g[0]) for g in got])[:-1])


def judge_suffixes(blobs: list) -> list[np.ndarray]:
    """Whether another block has the same (hash, check). Blobs are ascending, so about SORTED entries of all are sorted at a time."""
    got = [X.opened(b, np.uint64, np.uint32) for b in blobs]
    flags = [np.zeros(len(h), bool) for h, _ in got]
    slices = max(1, sum(map(len, flags)) // SORTED)
    low, high = min(int(h[0]) for h, _ in got), max(int(h[-1]) for h, _ in got)
    edges = np.array([low + (high - low) * i // slices for i in range(slices)], np.uint64)
    cut = [np.r_[np.searchsorted(h, edges), len(h)] for h, _ in got]
    for i in range(slices):
        sub = [slice(c[i], c[i + 1]) for c in cut]
        h, check = (np.concatenate([g[j][s] for g, s in zip(got, sub, strict=True)]) for j in (0, 1))
        _, _, n, group = pairs(h, check)
        for f, s, own in zip(flags, sub, np.split(n[group] > 1, np.cumsum([s.stop - s.start for s in sub])[:-1]), strict=True):
            f[s] = own
    return flags


def suffix_dedup(docs: DataFrame, depth: int = DEPTH, spread: int = SPREAD, digit: int = DIGIT, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """Remove every byte that a window of depth bytes covers which starts at least twice in the corpus.

    Returns doc_id, n_bytes, n_spans (maximal removed runs), kept (the remaining bytes) for every row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, ranges = X.n_blocks(total, block_bytes), (X.n_ranges(total / (spread / 2), RANGE_ANCHORS), X.n_ranges(total, RANGE_SUFFIXES))
    docs = docs.select(X.block_of(blocks, "doc_id", "text").alias("block"), "doc_id", "text")
    by_block = docs.groupBy("block")
    block = lambda t: Block(t.column("text"), depth, spread, digit, segment)
    levels = lambda replies, n: [replies.filter(pa.array(replies.column("level").to_numpy() == k)) for k in range(n)]

    def first(t: pa.Table) -> pa.Table:
        a, s, *_ = block(t).anchors(ranges[0])
        low = (a & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return H.freed(X.cells(t.column("block")[0].as_py(), a >> np.uint64(32), lambda c: X.sealed(low[c], s[c])))

    def further(k: int):
        def send(t: pa.Table, replies: pa.Table) -> pa.Table:
            if not t.num_rows:
                return X.CELL_SCHEMA.empty_table()
            h, check = block(t).refined(ranges, levels(replies, k), last=False)[2]
            return H.freed(X.cells(t.column("block")[0].as_py(), X.in_range(h, ranges[1]), lambda c: X.sealed(h[c], check[c])))

        return send

    def keep(t: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"doc_id": t.column("doc_id").to_pylist(), "n_bytes": [], "n_spans": [], "kept": []}
        if t.num_rows:
            b = block(t)
            gone = b.gone(*b.refined(ranges, levels(replies, len(b.lengths)), last=True)[:2])
            for x, y in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
                g = gone[x:y]
                out["n_bytes"].append(y - x)
                out["n_spans"].append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(y > x and g[0]))
                out["kept"].append(b.data[x:y][~g].tobytes())
        return H.freed(pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])))

    replies = X.answered(by_block.applyInArrow(first, X.CELLS), judge_anchors).withColumn("level", F.lit(0))
    for k in range(1, len(prefixes(depth, spread, digit))):
        sent = by_block.cogroup(replies.groupBy("block")).applyInArrow(further(k), X.CELLS)
        replies = replies.unionByName(X.answered(sent, judge_suffixes).withColumn("level", F.lit(k)))
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(keep, RESULT)


def digest(result: DataFrame) -> DataFrame:
    removed = F.col("n_bytes") - F.octet_length("kept")
    return result.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], depth: int = DEPTH) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each (doc_id, text), by the definition."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen: dict[bytes, int] = {}
    for _, t in texts:
        for i in range(len(t) - depth + 1):
            k = hashlib.blake2b(t[i : i + depth], digest_size=12).digest()
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - depth + 1):
            if seen[hashlib.blake2b(t[i : i + depth], digest_size=12).digest()] > 1:
                gone[i : i + depth] = True
        edges = np.diff(np.r_[0, gone.astype(np.int8)])
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


ORACLE = f"""
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - {DEPTH - 2})) AS i FROM d),
    g AS (SELECT doc_id, i, md5_number(b[i:i + {DEPTH - 1}]) AS k FROM p),
    h AS (SELECT doc_id, i FROM g JOIN (SELECT k FROM g GROUP BY k HAVING count(*) > 1) USING (k)),
    n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {DEPTH} THEN 0 ELSE 1 END AS new FROM h),
    m AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
    r AS (SELECT doc_id, run, min(i) AS a, max(i) + {DEPTH - 1} AS z FROM m GROUP BY ALL),
    s AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM r GROUP BY doc_id),
    k AS (SELECT doc_id, b, n_spans, n_removed, CASE WHEN a IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(a) + 1),
            lambda j: b[CASE WHEN j = 0 THEN 1 ELSE z[j] + 1 END : CASE WHEN j = len(a) THEN octet_length(b) ELSE a[j + 1] - 1 END]), lambda x, y: x || y) END AS kept
          FROM d LEFT JOIN s USING (doc_id))
    SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(kept) AS kept_sha256 FROM k"""
