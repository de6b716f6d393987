"""Substring dedup by level-wise doubling over windows of words.

A window of n words can only be repeated where both its first and its last ceil(n/2) words are. So windows of a short
length are looked up first, and only those repeated elsewhere are extended to twice the length (less what the halves
overlap), level after level, as long as candidates survive: a block none of whose windows did sends nothing more. The
last level has the threshold's length and also knows the smallest document of each window. Levels go through exchange.py:
each block of documents sends a window's hash once, however many documents share it.

Defined results: null texts have no words; a document without id loses nothing and counts for nobody; rows with one id
are one document to each other, so neither loses words to the other; words stay as they are; a text may be of any
length; columns of other names are ignored, so none can clash.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import hashing as H

#: The threshold, and the longest that the first level's windows may be.
WINDOW, SHORTEST = 13, 4
BLOCK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths, each at least half of the next: 13 gives 4, 7 and 13."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Words:
    """The words of a block's documents, and hashes of their windows."""

    def __init__(self, texts):
        self.data, self.offsets = H.text_buffers(texts)
        self.starts, self.ends = H.spans_of_words(self.data, self.offsets[1:-1])
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.prefixes: dict[int, np.ndarray] = {}

    def windows(self, length: int, base: int = H.BASES[0]) -> np.ndarray:
        if base not in self.prefixes:
            self.prefixes[base] = H.prefix(H.hashes_of_words(self.data, self.starts, self.ends, base), base)
        c = self.prefixes[base]
        n = len(c) - length
        return H.mix((c[length:] - c[:n]) * H.powers(H.inverse(base), n)) if n > 0 else np.zeros(0, np.uint64)

    def whole(self, length: int) -> np.ndarray:
        """Whether the window from each word ends in the same document."""
        n = len(self.doc) - length + 1
        return self.doc[length - 1 :] == self.doc[:n] if n > 0 else np.zeros(0, bool)

    def candidates(self, lengths: list[int], ranges: int, replies: list[pa.Table]) -> np.ndarray:
        """Positions of windows of the level that replies (of all shorter ones) don't cover, of which both halves are repeated."""
        ok = self.whole(lengths[0])
        for shorter, longer, own in zip(lengths, lengths[1:], replies, strict=False):
            keys = X.short(self.windows(shorter)[ok], ranges)
            distinct, group, counts = np.unique(keys, return_inverse=True, return_counts=True)
            alive = np.zeros(len(ok), bool)
            alive[ok] = (X.answers(own, distinct >> np.uint64(32))[:, 0] | (counts > 1))[group]
            ok = self.whole(longer)
            ok &= alive[: len(ok)] & alive[longer - shorter : longer - shorter + len(ok)]
        return np.flatnonzero(ok)


def least(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, check, smallest doc) of each distinct pair, ascending; and the pair of each row."""
    order = np.lexsort((doc, check, h))
    new = np.ones(len(order), bool)
    a, b = h[order], check[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return a[new], b[new], doc[order][new], group


def last_level(words: Words, ids: np.ndarray, lengths: list[int], ranges: int, replies: list[pa.Table]):
    """(positions, and what least() gives) of the windows that the last level looks up."""
    at = words.candidates(lengths, ranges, replies)
    h = words.windows(lengths[-1])[at]
    words.prefixes.clear()
    check = (words.windows(lengths[-1], H.BASES[1])[at] >> np.uint64(32)).astype(np.uint32)
    return at, *least(h, check, ids[words.doc[at]])


def ids_of(t: pa.Table) -> np.ndarray:
    return t.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()


def judge_least(blobs: list) -> list[np.ndarray]:
    """Whether another block has the same window in a document with a smaller id than any of this block's."""
    got = [X.opened(b, np.uint64, np.uint32, np.int64) for b in blobs]
    h, check, doc = (np.concatenate(x) for x in zip(*got, strict=True))
    _, _, smallest, group = least(h, check, doc)
    return np.split(smallest[group] < doc, np.cumsum([len(g[0]) for g in got])[:-1])


def substring_dedup(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove every word that a window covers which also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_text for every row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, ranges, lengths = X.n_blocks(total, block_bytes), X.n_ranges(total / 6), levels(window, shortest)
    docs = docs.select(X.block_of(blocks, "doc_id", "text").alias("block"), "doc_id", "text")
    by_block = docs.groupBy("block")
    split = lambda replies, n: [replies.filter(pa.array(replies.column("level").to_numpy() == k)) for k in range(n)]

    def sent(k: int, t: pa.Table, replies: list[pa.Table]) -> pa.Table:
        """Cells of level k."""
        words, block = Words(t.column("text")), t.column("block")[0].as_py()
        if k + 1 < len(lengths):
            at = words.candidates(lengths[: k + 1], ranges, replies)
            return H.freed(X.short_cells(block, np.unique(X.short(words.windows(lengths[k])[at], ranges))))
        _, h, check, doc, _ = last_level(words, ids_of(t), lengths, ranges, replies)
        return H.freed(X.cells(block, X.in_range(h, ranges), lambda s: X.sealed(h[s], check[s], doc[s])))

    def longer(k: int):
        return lambda t, replies: sent(k, t, split(replies, k)) if t.num_rows else X.CELL_SCHEMA.empty_table()

    def keep(t: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"doc_id": t.column("doc_id").to_pylist(), "n_words": [], "n_removed": [], "kept_text": []}
        if t.num_rows:
            words, ids, got = Words(t.column("text")), ids_of(t), split(replies, len(lengths))
            at, h, _, doc, group = last_level(words, ids, lengths, ranges, got)
            smaller = X.answers(got[-1], X.in_range(h, ranges))[:, 0]
            own = ids[words.doc[at]]
            gone = at[(own != NO_ID) & (smaller[group] | (doc[group] < own))]
            steps = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(steps, gone, 1)
            np.add.at(steps, gone + window, -1)
            stay = np.cumsum(steps[:-1]) == 0
            first_word = np.searchsorted(words.doc, np.arange(t.num_rows + 1))
            kept = np.r_[0, np.cumsum(stay)]
            for i, (a, b) in enumerate(zip(first_word[:-1], first_word[1:], strict=True)):
                own_words = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
                n = int(kept[b] - kept[a])
                if n < b - a:
                    own_words = compress(own_words, stay[a:b].tolist())
                out["kept_text"].append(b" ".join(own_words).decode())
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(b - a) - n)
        return H.freed(pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])))

    replies = None
    for k in range(len(lengths)):
        cells = by_block.applyInArrow(lambda t: sent(0, t, []), X.CELLS) if replies is None else by_block.cogroup(replies.groupBy("block")).applyInArrow(longer(k), X.CELLS)
        answers = X.answered(cells, judge_least if k + 1 == len(lengths) else X.judge_short).withColumn("level", F.lit(k))
        replies = answers if replies is None else replies.unionByName(answers)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(keep, RESULT)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> dict:
    """{doc_id: (n_words, n_removed, sha256)} of (doc_id, text) rows with distinct ids, by the definition."""
    words = {d: (t or "").encode().split() for d, t in rows}
    firsts: dict[tuple, int] = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            firsts[key] = min(d, firsts.get(key, d))
    out = {}
    for d, w in words.items():
        stay = [True] * len(w)
        for i in range(len(w) - window + 1):
            if firsts[tuple(w[i : i + window])] < d:
                stay[i : i + window] = [False] * window
        out[d] = (len(w), stay.count(False), hashlib.sha256(b" ".join(compress(w, stay))).hexdigest())
    return out


ORACLE = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM p JOIN d USING (doc_id)),
    f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range({WINDOW})) AS i FROM g JOIN f USING (k) WHERE first < doc_id),
    s AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM s ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)"""
